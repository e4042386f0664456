"""op13 against every window of every item, in plain Python."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s:s + 10]), set()).update([] if item is None else [str(item)])
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(g) for g in windows}:
            for s in range(len(w) - m + 1):
                if (g := tuple(w[s:s + m])) in windows:
                    hit.update(range(s, s + m))
                    found |= windows[g]
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((key, len(w), len(hit), spans, sorted(found)))
    return sorted(out, key=repr)


def got(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clash = {c: F.lit("clash") for c in ("item", "fp", "window", "key", "words", "found", "items", "row", "m", "set")}
    rows = decontaminate.contamination(d.withColumns(clash), i.withColumns(clash)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, [[s.start, s.stop] for s in r.spans], r["items"]) for r in rows), key=repr)


def tables(seed=13):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "日本", "A1"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(25)]
    items += [(3, items[4][1]), (100, items[4][1]), (None, text(20)), (101, None), (102, ""), (103, "?!"), (104, "w1"), (105, "w2 w3"), (106, "w1 " * 30)]
    docs = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 4))):  # pieces of items, of whole windows and of less
            w = items[int(rng.integers(0, 25))][1].split()
            s = int(rng.integers(0, len(w)))
            parts += [" ".join(w[s:s + int(rng.integers(1, 25))]), text(int(rng.integers(0, 12)))]
        docs.append((i, ", ".join(parts)))
    docs += [(200, docs[0][1]), (200, docs[0][1]), (200, "other w1"), (201, None), (202, ""), (203, " \n"), (None, items[0][1].upper()),
             (204, "w1 " * 5_000 + items[27][1]), (205, items[7][1].replace(" ", "\x00-\t"))]
    return docs, items


def test_every_window_is_found_and_nothing_else(spark):
    docs, items = tables()
    assert got(spark, docs, items) == plain(docs, items)


def test_a_filter_that_lets_much_through_changes_nothing(spark, monkeypatch):
    docs, items = tables(5)
    monkeypatch.setattr(decontaminate, "_passes", lambda bits, h: np.ones(len(h), bool))
    assert got(spark, docs, items) == plain(docs, items)


def test_spans_of_ten_shared_words_share_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b, shared = (rng.integers(0, 50, n, dtype=np.uint64) for n in (30, 30, 10))
        x, y = np.concatenate([a[:7], shared, a[7:]]), np.concatenate([b[:19], shared, b[19:]])
        (fx, px), (fy, py) = decontaminate._winnow(x), decontaminate._winnow(y)
        assert fx[7] == fy[19] and px[7] - 7 == py[19] - 19


def test_empty_tables(spark):
    docs, items = tables()
    assert got(spark, [], items) == []
    assert got(spark, docs, []) == plain(docs, [])


def test_query_columns(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = sorted((tuple(r) for r in decontaminate.op13_decontaminate(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted(((k, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for k, n, h, _, i in plain(docs, items)), key=repr)
