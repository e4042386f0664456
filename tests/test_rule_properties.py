"""Property tests: notebook text (S9) and output normalisation (O1) keep
their rules on generated inputs."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docweave.operators.output import normalize_output
from docweave.operators.structured import notebook_text

SETTINGS = dict(max_examples=10, deadline=None, derandomize=True,
                suppress_health_check=[HealthCheck.function_scoped_fixture])

_piece = st.sampled_from(["x = 1", "\n", "  ", "# T", "é\n", "", "\t", "print()\n", " a "])
_source = st.one_of(st.lists(_piece, max_size=4), st.lists(_piece, max_size=3).map("".join), st.none())


def _cell(kind, source):
    return {"cell_type": kind} if source is None else {"cell_type": kind, "source": source}


_notebook = st.one_of(
    st.lists(st.builds(_cell, st.sampled_from(["code", "markdown", "raw"]), _source), max_size=6)
    .map(lambda cells: {"cells": cells}),
    st.just({"metadata": {}}))


@settings(**SETTINGS)
@given(docs=st.lists(_notebook.map(json.dumps), min_size=1, max_size=30))
def test_notebook_text_property(spark, docs):
    """A notebook reads as its cells, each read on its own and the silent ones left out."""
    rows = []
    for i, d in enumerate(docs):
        cells = json.loads(d).get("cells", [])
        rows += [(i, -1, d)] + [(i, k, json.dumps({"cells": [c]})) for k, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "id int, k int, n string")
    got = {(r.id, r.k): r.t for r in df.select("id", "k", notebook_text("n").alias("t")).collect()}
    for i, d in enumerate(docs):
        alone = [got[i, k] for k in range(len(got)) if (i, k) in got]
        assert got[i, -1] == "\n\n".join(t for t in alone if t), d


_value = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.sampled_from(["", "é", "a b"])),
                      lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.sampled_from("kéz"), v, max_size=3)),
                      max_leaves=6)
_blank = st.sampled_from(["", " ", "\n", "\t \n", "\xa0"])
_fence = st.sampled_from([("", ""), ("```", "\n```"), ("```json\n", "\n```"), ("```json ", "```")])


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(_value, _blank, _fence, st.sampled_from(["json", "txt", "md"])), min_size=1, max_size=40))
def test_normalize_output_property(spark, rows):
    """Blanks around a reply go; a JSON reply also loses its fence and is laid out anew."""
    inner = [o + json.dumps(v, ensure_ascii=False) + c for v, _, (o, c), _ in rows]
    broken = [(0, "{" + "no json", "json"), (1, " ```json\n{bad\n``` ", "json"), (2, "``` open", "json")]
    df = spark.createDataFrame([(i, b + t + b, f) for i, (t, (_, b, _, f)) in enumerate(zip(inner, rows))]
                               + [(-1 - i, t, f) for i, t, f in broken], "id int, c string, f string")
    got = {r.id: r.o for r in df.select("id", normalize_output("c", "f").alias("o")).collect()}
    for i, (v, _, _, f) in enumerate(rows):
        assert got[i] == (json.dumps(v, indent=2, ensure_ascii=False) + "\n" if f == "json" else inner[i])
    assert [got[-1], got[-2], got[-3]] == ["{no json", "{bad", "``` open"]


@settings(**SETTINGS)
@given(names=st.lists(st.text(alphabet=st.sampled_from(list("ab.X_- é")), min_size=1, max_size=8),
                      min_size=1, max_size=40))
def test_suffix_and_stem_follow_pathlib(spark, names):
    from pathlib import PurePosixPath

    from docweave.sources.formats import file_name, stem, suffix
    df = spark.createDataFrame([(i, "dir/" + n) for i, n in enumerate(names)], "id int, p string")
    rows = df.select("id", file_name("p").alias("n")).select(
        "id", "n", suffix("n").alias("s"), stem("n").alias("t")).collect()
    for r in rows:
        p = PurePosixPath("dir/" + names[r.id])
        if p.name != names[r.id]:  # pathlib normalises names like "." or "a/": not file names
            continue
        assert (r.s, r.t) == (p.suffix, p.stem), names[r.id]


_names = st.sampled_from(["a", "b", "item", "x-y"])
_texts = st.sampled_from(["", " ", "v", " t e ", "é", "&amp;", "\n  ", "1 &lt; 2"])
_attrs = st.dictionaries(st.sampled_from(["id", "k", "z"]), st.sampled_from(["1", "v w", "é", "&quot;q&quot;"]),
                         max_size=2)


def _render(tree):
    tag, attrs, text, kids, tail = tree
    a = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return f"<{tag}{a}>{text}{''.join(_render(k) for k in kids)}</{tag}>{tail}"


_tree = st.recursive(st.tuples(_names, _attrs, _texts, st.just([]), _texts),
                     lambda kids: st.tuples(_names, _attrs, _texts, st.lists(kids, max_size=3), _texts),
                     max_leaves=8)
_xml_doc = st.one_of(_tree.map(lambda t: _render((t[0], t[1], t[2], t[3], ""))),
                     st.sampled_from(["<a><b></a>", "plain", "<a>"]))


@settings(**SETTINGS)
@given(docs=st.lists(_xml_doc, min_size=1, max_size=30))
def test_xml_outline_property(spark, docs):
    """Lines stand two spaces deeper than their parent's; tags nest; texts are the elements' own."""
    from xml.etree import ElementTree

    from docweave.operators.structured import xml_outline
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, x string")
    for r in df.select("id", xml_outline("x").alias("o")).collect():
        try:
            tree = ElementTree.fromstring(docs[r.id])
        except ElementTree.ParseError:
            assert r.o == docs[r.id]
            continue
        open_, tags, texts = [], [], []
        for line in r.o.split("\n"):
            bare = line.lstrip(" ")
            depth = (len(line) - len(bare)) // 2
            if bare.startswith("</"):
                assert open_.pop() == bare[2:-1] and depth == len(open_)
            elif bare.startswith("<"):
                assert depth == len(open_)
                tags.append(bare[1:].rstrip(">").split(" ")[0])
                open_.append(tags[-1])
            else:
                assert depth == len(open_)
                texts.append((open_[-1], bare))
        assert not open_ and tags == [e.tag for e in tree.iter()]
        assert texts == [(e.tag, e.text.strip()) for e in tree.iter() if e.text and not e.text.isspace()]
