"""The training-data operators against plain versions, on small tables with
nulls, empty and long texts, ties, repeated rows and clashing column names."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import bpe, components, language_model, lines, minhash, mixing, quality, secrets, substrings, topk, vectors

WORDS = [f"w{i}" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, text_of(rng, 60) + "\n" + text_of(rng, 30), f"s{i % 3}") for i in range(30)]
    base = rows[0][1].split(" ")
    for k in range(6):  # near copies, one word changed
        copy = list(base)
        copy[5 + k] = "changed"
        rows.append((100 + k, " ".join(copy), "s1"))
    rows += [(200, rows[1][1], None), (200, rows[1][1], None), (201, None, "s0"), (202, "", "s0"), (None, "no key here", "s2"),
             (203, "x " * 30_000, "s2"), (204, " \t\r\n", "s0"), (205, "one", "s1"), (206, "One", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "n", "doc", "ids", "score", "size", "kept", "spans", "k")})


def empty(docs):
    return docs.where("false")


def test_bpe_words_are_those_of_the_pattern():
    import regex
    rng = np.random.default_rng(2)
    pattern, words = regex.compile(bpe.PATTERN), bpe._Words()
    points = [*range(0x20, 0x7F)] * 3 + [9, 10, 13, 0x0B, 0x1C, 0x1F, 0x85, 0xA0, 0x2028, 0x3000] * 9 + list(range(0xA0, 0x600)) + \
        [0x660, 0xBD, 0xB2, 0x2160, 0x3007, 0x4E00, 0x9FFF, 0xAC00, 0x1F600, 0x1D7CE, 0x10FFFF, 0x200B, 0x300, 0xE000, 0x1E900]
    for _ in range(400):
        text = "".join(chr(points[k]) for k in rng.integers(0, len(points), 60)) + " I'll 've'd  '  \n"
        assert words.findall(text) == pattern.findall(text)


def test_bpe_matches_the_tokenizers_library_and_round_trips(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_path())
    odd = ["a<|endoftext|>b  c\n\n d", "x" * 700, "é" * 300 + "日本語   ½ ٣", "can't we'll I'M", "\x1c\x85\xa0​", "", None]
    spark = docs.sparkSession
    df = spark.createDataFrame(list(enumerate(odd)), "i int, text string").unionByName(
        docs.select(F.lit(99).alias("i"), "text"))
    for r in bpe.decode(bpe.encode(df)).collect():
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == plain.encode(r.text, add_special_tokens=False).ids
            assert r.decoded == r.text
    both = bpe.round_trip(df.withColumn("ids", F.lit("clash")))
    assert both.columns == [c for c in df.columns if c != "text"] + ["ids", "decoded"]
    two = bpe.decode(bpe.encode(df)).select(*both.columns)
    assert sorted(both.collect(), key=repr) == sorted(two.collect(), key=repr)
    assert bpe.encode(docs).columns[-1] == "ids" and bpe.encode(empty(docs)).count() == 0
    bad = spark.createDataFrame([([1, None, 999_999],)], "ids array<int>")
    assert bpe.decode(bad).first().decoded == '"'


def test_words_of_every_code_point_are_cut_alike():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path())
    for at in range(0, 0x3000, 64):
        text = " ".join(f"a{chr(c)}b1{chr(c)}" for c in range(at, at + 64))
        assert np.frombuffer(own.encode(text), np.int32).tolist() == plain.encode(text, add_special_tokens=False).ids


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else set(zip(*[w[i:] for i in range(width)]))


def components_of(sets, percent=80):
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, width):
    rows = minhash.near_duplicates(docs, width=width).collect()
    assert len(rows) == docs.count()
    sets = {r.doc_id: shingles(r.text, width) for r in rows if r.doc_id is not None}
    want = components_of(sets)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_overlaps_of_blocks():
    rng = np.random.default_rng(1)
    left, right = ([set(rng.integers(0, 60, 25).tolist()) for _ in range(9)] for _ in "ab")
    assert minhash._overlaps(left, right).tolist() == [[len(a & b) for b in right] for a in left]


def test_lines(docs):
    seen, gone = [], set()
    rows = [r for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None and r.text]
    for r in sorted(rows, key=lambda r: r.doc_id):
        for k, line in enumerate(r.text.split("\n")):
            w = set(line.encode().split())
            if w and any(5 * len(w & x) >= 4 * len(w | x) for x in seen):
                gone.add((r.doc_id, k))
            if w:
                seen.append(w)
    got = {(r.doc, r.line) for r in lines.repeated_lines(docs).collect()}
    assert got == gone and gone
    cut = {r.doc_id: r for r in lines.dedup(docs).collect()}
    assert cut[201].text is None and cut[202].text == "" and cut[200].text == "" and cut[200].removed_lines == [0, 1]
    assert lines.dedup(docs).count() == docs.count() and lines.dedup(empty(docs)).count() == 0


def test_lines_of_rows_that_share_a_key(spark):
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (1, "u v w x y z"), (2, "k l m n o p\nu v w x y z"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed_lines", F.lit("clash"))
    got = sorted((tuple(r) for r in lines.dedup(df).collect()), key=repr)
    assert got == sorted([(0, "a b c d e f", []), (1, "", [0]), (1, "u v w x y z", []), (1, "u v w x y z", []),
                          (2, "k l m n o p", [1]), (None, "a b c d e f", [])], key=repr)


def test_lines_in_groups_of_near_copies(spark):
    """Groups in which later lines are alike to some of the earlier ones only."""
    rng = np.random.default_rng(17)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(int(rng.integers(5, 30)))]
        for _ in range(60):
            words = [w if rng.random() > 0.09 else f"z{rng.integers(0, 40)}" for w in base]
            rows.append((len(rows), " ".join(words)))
    sets = [set(t.split()) for _, t in rows]
    want = {i for i, y in enumerate(sets) for x in sets[:i] if 100 * len(x & y) >= 80 * len(x | y)}
    got = {r.doc for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 50 < len(want) < 350


def test_substrings_resist_shifts(docs):
    spark = docs.sparkSession
    rng = np.random.default_rng(5)
    passage = text_of(rng, 120)
    df = spark.createDataFrame([(1, text_of(rng, 50) + " " + passage), (2, "ins " + text_of(rng, 33) + " " + passage + " " + text_of(rng, 20)),
                                (3, text_of(rng, 90)), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.dedup(df).collect()}
    assert got[1].spans is None and got[3].spans is None and got[4].text is None and got[5].text == ""
    assert got[2].firsts == [1] and len(got[2].text) < 0.6 * len(df.where("doc_id = 2").first().text)
    assert substrings.dedup(docs).count() == docs.count() and substrings.dedup(empty(docs)).count() == 0
    for n in (0, 1, 7, 5_000):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        ends = substrings.boundaries(data)
        assert ends == sorted(set(ends)) and (not n or ends[-1] == n)


def _repeated(texts, width=50):
    """Byte spans of the words that lie in a window of ``width`` words with an
    earlier copy (in an earlier text, or before it in its own)."""
    first, spans = {}, {}
    for i, t in sorted(texts.items()):
        at = [m.span() for m in re.finditer(rb"[^ \t-\r]+", t.encode())]
        words = t.encode().split()
        for s in range(len(words) - width + 1):
            f = first.setdefault(tuple(words[s:s + width]), (i, s))
            if f[0] < i or s >= f[1] + width:
                a, b = at[s][0], at[s + width - 1][1]
                mine = spans.setdefault(i, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = b
                else:
                    mine.append([a, b])
    return spans


def test_substrings_find_every_passage_of_50_words(spark):
    rng = np.random.default_rng(15)
    common = "the of and to in a is that for it was on are as with his they at be this".split()
    texts, n = {}, 0
    for words in [51] * 60 + [50] * 20 + [49] * 20:
        passage = " ".join(rng.choice(common, words))
        for _ in range(2):
            texts[n] = f"{text_of(rng, 30)} s{n} {passage} e{n} {text_of(rng, 30)}"
            n += 1
    letters = " ".join(rng.choice(list("abcdefgh"), 51))
    own = text_of(rng, 60)
    texts |= {n: f"x {letters} y", n + 1: f"é z {letters}", n + 2: f"{own} between {own}", n + 3: "a " * 200, n + 4: "b\n" * 49}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [[s["start"], s["end"]] for s in r.spans] for r in substrings.dedup(df).where("spans IS NOT NULL").collect()}
    assert got == _repeated(texts)
    assert sum(i < 160 for i in got) == 80 and not any(160 <= i < 200 for i in got) and {n + 1, n + 2, n + 3} <= set(got)


def test_substrings_halves_tell_windows_apart_before_they_are_expanded():
    rng = np.random.default_rng(21)
    known = substrings._Words()
    for words in (1, 2, 7, 8, 9, 20, 50, 51):
        for n in (0, 1, words - 1, words, words + 1, 3 * words):
            same = [b"x%d" % k for k in rng.integers(0, 1_000, n)]
            found = []
            for before, after in ((5, 0), (90, 40), (0, 90)):  # equal windows have equal halves, wherever they stand
                text = [b"a%d" % k for k in rng.integers(0, 1_000, before)] + same + [b"b%d" % k for k in rng.integers(0, 1_000, after)]
                of, places, d = substrings.halves(substrings.hashes(b" ".join(text), known), words)
                assert len(of) == max(0, len(text) - words + 1) and set(places) == set(of) and len(d) == len(places)
                digest = dict(zip(places.tolist(), d.tolist()))
                found.append([digest[p] for p in of[before:before + n - words + 1].tolist()] if n >= words else [])
            assert found[0] == found[1] == found[2]
    # a phrase that many texts hold, in places of its own: nothing around it repeats, so no window is expanded
    phrase = b"the same eight words or ten of them here"
    seen = [set(substrings.halves(substrings.hashes(b" ".join(b"%d.%d" % (t, k) for k in range(60)) + b" " + phrase + b" " + b" ".join(
        b"%d-%d" % (t, k) for k in range(60)), known))[2].tolist()) for t in range(20)]
    assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_vectors_links_across_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 8))
    v = np.concatenate([v, v[:60] + 0.05 * rng.normal(size=(60, 8)), v[:5]])
    rows = [(i, x.tolist(), i % 2 if i < 200 else 0) for i, x in enumerate(v)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, v[0].tolist(), None), (904, [1.0, None], 0), (905, [1.0], 0)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:len(v)]])
    m = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(m, False)
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.minimum(root, np.where(m, root[None, :], len(v)).min(1))
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (m[i].sum(), root[i], root[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "ROW_BLOCK", 20)
    x = np.random.default_rng(4).integers(-4, 5, size=(90, 20)).astype(float)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(500, None), (None, x[0].tolist()), (501, [1.0])], "vec_id long, v array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(rows, rows.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 90, 10):
        s = x @ x[q]
        assert got[q] == [(j, int(s[j])) for j in sorted(set(range(90)) - {q}, key=lambda j: (-s[j], j))[:5]]


def test_quality_ranks_held_out_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, text_of(rng, 40) if i % 4 else " ".join(w + "###" for w in rng.choice(WORDS, 40)), int(i % 4 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = quality.score(df, model).collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in got)
    none = quality.train(df.select("doc_id", "text"), df.where("false").select("doc_id", "quality"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000)], "doc_id long, text string")
    assert [r.score for r in quality.score(odd, none).collect()] == [0.5] * 3
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())


def test_mixing_meets_its_targets(spark, docs):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, "w " * int(rng.integers(1, 80)), [None, "a", "b", "c"][i % 4]) for i in range(2_000)],
                               "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    total = sum(r.size for r in rows)
    size, goal, taken = (collections.Counter() for _ in range(3))
    for r in rows:
        size[r.source] += r.size
        goal[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    assert math.isclose(sum(goal.values()), 1.5 * total, rel_tol=1e-9)
    assert all(goal[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - goal[s]) < 0.01 * goal[s] for s in goal)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df).collect()), key=repr)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty(docs)).count() == 0


def test_secrets(spark, docs):
    texts = ["token = 'abcdefgh1'", "é password:short, Secret: \"longenough\" x", "AKIA" + "A1" * 8, "k" + "0f" * 20 + "z", None, "",
             "password: token: abcdefgh1234", "secret=" + "a1" * 20, "plain words only here", "q " * 20_000 + "api_key=zzzzzzzz"]
    found = secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"),
                         {(a, b): (1.0 if chr(b).isdigit() else -1.0) for a in range(128) for b in range(128)}).collect()
    base = [(0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
            (1, re.compile("AKIA[A-Z0-9]+")), (2, re.compile("[0-9a-f]+"))]
    least = {0: 8, 1: 16, 2: 32}
    for r in found:
        want = sorted((m.start(), k, m.end()) for k, p in base for m in p.finditer(r.text or "") if len(m[2] if k == 0 else m[0]) >= least[k])
        assert [tuple(s) for s in r.secrets if s["kind"] < 3] == want
    random = spark.createDataFrame([("id 83kf92mz01qpx74nb6vt55 end", ), ("some_ordinary_identifier_word", )], "text string")
    rng = np.random.default_rng(9)
    labelled = spark.createDataFrame([("token=" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 40)), ) for _ in range(400)]
                                     + [("some_ordinary_identifier_name another_plain_word", )], "text string")
    got = [len(r.secrets) for r in secrets.scan(random, secrets.train(labelled), threshold=5.0).collect()]
    assert got == [1, 0]
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(empty(docs)).count() == 0


def test_secrets_recall_does_not_fall_with_unlabelled_strings(spark):
    rng = np.random.default_rng(10)
    letters, syllables = list("abcdefghijklmnopqrstuvwxyz0123456789"), [a + b for a in "bdfgklmnprstv" for b in ("a", "en", "i", "or", "u")]
    random = lambda n: "".join(rng.choice(letters, n))
    words = ["".join(rng.choice(syllables, 6)) for _ in range(1_000)]
    plain = [" ".join(rng.choice(words, 10)) for _ in range(2_000)]
    labelled = [f"token = '{random(40)}'" for _ in range(1_000)]
    fresh = [random(n) for n in (24, 40) for _ in range(200)]
    names = ["_".join(rng.choice(words, 2)) for _ in range(200)]
    judged = spark.createDataFrame([(s,) for s in fresh + names], "text string")
    for unlabelled in (0, 12_000):
        rows = plain + labelled + ["x" + random(31) for _ in range(unlabelled)]
        ratios = secrets.train(spark.createDataFrame([(t,) for t in rows], "text string"))
        got = [len(r.secrets) for r in secrets.scan(judged, ratios).collect()]
        assert sum(got[:400]) >= 392 and sum(got[400:]) <= 2, (unlabelled, sum(got[:200]), sum(got[200:400]), sum(got[400:]))


def test_language_model(docs):
    held = F.col("doc_id") % 5 == 2
    rows = language_model.score(docs, held_out=held).collect()
    assert len(rows) == docs.count()
    tokens = {(r.doc_id): (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    counts = collections.Counter(t for r in docs.collect() if not (r.doc_id is not None and r.doc_id % 5 == 2)
                                 for t in (r.text or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[t] > 0 for t in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert language_model.score(empty(docs)).count() == 0


def test_language_model_has_a_restaurant_for_every_previous_word(spark):
    # each word once: every seating is a table of one, so the model has a closed form
    n = 5_000
    learnt = " ".join(f"p{i} q{i}" for i in range(n))
    rows = [(0, learnt, False)] + [(1 + i, f"p{i} q{i}", True) for i in range(0, n, 50)] + [(10_000, "p7 q8", True), (10_001, "new q8", True), (10_002, None, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in language_model.score(df, held_out=F.col("held")).collect()}
    d, known = 0.95, 2 * n + 1  # the discounts at their bound; words with the end
    base = 1 / (known + 1)
    root = ((1 - d) + (1 + d * known) * base) / (1 + known)  # of each known word: one customer, one table
    void = (1 + d * known) * base / (1 + known)
    after = lambda p, met=True, same=False: ((1 - d) * same + (1 + d * met) * p) / (1 + met)
    first = lambda i: after(root, same=i == 0)  # the start's restaurant has p0 alone
    end = lambda i: after(root, same=i == n - 1)
    for i in range(0, n, 50):
        assert math.isclose(got[1 + i], sum(map(math.log10, (first(i), after(root, same=True), end(i)))), rel_tol=1e-9), i
    assert math.isclose(got[10_000], sum(map(math.log10, (first(7), after(root), end(8)))), rel_tol=1e-9)
    assert math.isclose(got[10_001], sum(map(math.log10, (after(void), after(root, met=False), end(8)))), rel_tol=1e-9)
    assert math.isclose(got[10_002], math.log10(after(root)), rel_tol=1e-9)


def test_seating_opens_between_one_and_all_tables():
    rng = np.random.default_rng(0)
    c = np.array([1, 2, 50, 5_000])
    t = language_model.seat(c, np.full(4, 0.01), np.full(4, 10.0), 0.5, 1.0, rng)
    assert t[0] == 1 and (t >= 1).all() and (t <= c).all() and t[3] > t[2] >= 1
