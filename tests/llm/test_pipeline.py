"""Each stage on a small copy of the tables; run() against plain stages on a
fixture with nulls, repeated, long and clashing rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docweave.llm import bpe, mixing, quality
from docweave.llm.common import stash
from tests.llm.test_mixing import plain_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stash(stage(spark, docs, SF), name)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= seen and ids
        if name == "quality":
            assert not ids & bad
        if name == "mixing":
            assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
        else:
            assert docs.count() <= before.count()
        seen = ids
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("n_tokens <> size(ids)").count() == 0
    empty = stash(docs.where("false"), "empty")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


# --- run() as a whole, against five plain stages ---

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows, labels):
    marked = {}
    for key, y in labels:
        if y in (0, 1) and key is not None and zlib.crc32(str(key).encode()) % 3 != 1:
            marked[key] = min(y, marked.get(key, y))
    got = sorted((r["doc_id"], marked[r["doc_id"]], quality.features(r["text"])) for r in rows if r["doc_id"] in marked)
    share = sum(y == 0 for y in marked.values()) / len(marked)
    m = quality.fit(np.array([x for _, _, x in got]), np.array([y for _, y, _ in got]), share)
    score = lambda t: ((np.array(quality.features(t)) - m["mean"]) / m["scale"]) @ m["w"] - m["threshold"]
    return [r for r in rows if score(r["text"]) >= 0]


def plain_lines(rows, codes):
    """``codes``: what orders rows that share a key."""
    places = {}
    for r in rows:
        if r["doc_id"] is not None:
            for i, t in enumerate((r["text"] or "").split("\n")):
                places[r["doc_id"], codes.get(r["text"], 0), i] = frozenset(WORD.findall(t))
    gone, seen = set(), []
    for place in sorted(places):
        s = places[place]
        if s:
            if any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                gone.add(place)
            seen.append(s)
    out = []
    for r in rows:
        text = r["text"]
        cut = [i for i, _ in enumerate((text or "").split("\n")) if (r["doc_id"], codes.get(text, 0), i) in gone] if r["doc_id"] is not None else []
        if cut:
            text = "\n".join(t for i, t in enumerate(text.split("\n")) if i not in cut)
            if not WORD.search(text):
                continue
            r = r | {"text": text, "n_chars": len(text)}
        out.append(r)
    return out


def plain_near(rows):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    root = {k: k for k, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and root[a] < root[b]:
                    root[b], changed = root[a], True
    return [r for r in rows if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]]


def plain_mix(rows, hashes):
    """Every document here is a large one of its source."""
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets, out = plain_targets(sizes), []
    for s in sizes:
        units = collections.Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in rows if r["source"] == s)
        t, left, copies = targets[s], sizes[s], {}
        order = sorted((z * n, hashes[k], z, (k is not None, k or 0)) for (k, z), n in units.items() if z)
        for m, _, z, (named, k) in reversed(order):
            k = k if named else None
            miss = lambda c: round(max(0, t - c * m - 2 * (left - m)) + max(0, c * m - t), 6)
            copies[k, z] = c = min(range(3), key=lambda c: (miss(c), round(abs(c - t / left), 9), c))
            t, left = t - c * m, left - m
        out += [r for r in rows if r["source"] == s for _ in range(copies.get((r["doc_id"], len(WORD.findall(r["text"] or ""))), 1))]
    return out


CLASH = ("removed_lines", "n_shingles", "component_id", "kept", "rate", "size", "target", "copies", "taken", "source_size", "__score", "__copy", "ids", "id", "n")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(55)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(500)]
    sentence = lambda n: " ".join(rng.choice(vocabulary, n)).capitalize() + "."
    shared = [sentence(12) for _ in range(4)]
    rows = []
    for i in range(90):
        lines = [sentence(int(rng.integers(6, 20))) for _ in range(int(rng.integers(2, 6)))]
        if i % 4 == 0:
            lines.insert(1, shared[i % 3])
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    for i in range(8):  # near copies of documents, one word changed
        words = rows[i][1].split(" ")
        words[3] = "changed"
        rows.append((200 + i, " ".join(words), "en", "s1"))
    rows += [(300 + i, "%% $$ 0000 ## " * 30, "xx", "s2") for i in range(25)]  # junk
    rows += [(400, rows[5][1], "en", "s0"), (5, rows[5][1], "en", "s2"), (6, "another text under the same key, " + sentence(20), "en", "s0"),
             (500, None, None, "s0"), (501, "", "en", None), (None, "no key at all here, but words. " + sentence(15), "en", "s1"),
             (502, "  \n\t", "en", "s0"), (503, " ".join(rng.choice(vocabulary, 700)) + ".", "en", "s0"), (504, sentence(30), "en", None)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).withColumn("n_chars", F.char_length("text").cast("long")).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    labels = [(i, 1) for i in range(60)] + [(300 + i, 0) for i in range(20)] + [(None, 0), (61, None), (5, 1), (9999, 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, labels


def show(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_run_is_the_five_plain_stages(spark, tables, monkeypatch):
    monkeypatch.setattr(mixing, "LARGE", 1 << 40)  # every document is settled on its own
    folder, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    one = lambda df, c: {r[0]: r[1] for r in df.select("doc_id" if c == "h" else "text", c).distinct().collect()}

    def codes(df):
        return one(df.withColumn("c", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))), "c")

    now = docs
    for name, stage in P.STAGES[:-1]:
        if name == "quality":
            rows = plain_quality(rows, labels)
        elif name == "line_dedup":
            rows = plain_lines(rows, codes(now))
        elif name == "near_dedup":
            rows = plain_near(rows)
        else:
            rows = plain_mix(rows, one(now.withColumn("h", F.xxhash64("doc_id")), "h"))
        now = stash(stage(spark, now, folder), name)
        got = [r.asDict() for r in now.collect()]
        assert now.columns == columns and show(got, columns) == show(rows, columns), name
        assert len(got) > 20
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in rows:
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = coder.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], r["source"], len(ids), ids, hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in P.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
