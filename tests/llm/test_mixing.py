"""op7 against the targets by water-filling, and its takings against the targets."""

import collections

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Level by level: who reaches the cap stops, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def taken(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumns({c: F.lit("clash") for c in ("m", "z", "k", "h", "target", "rate")})
    got = mixing.mix(df, size=F.col("n")).collect()
    assert len(got) == len(rows)
    sums, sizes, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        sums[r.source] += r.taken
        sizes[r.source] += r.size
        targets[r.source] = r.target
    want = plain_targets(sizes)
    assert all(abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    assert {r.source: r.source_size for r in got} == dict(sizes)
    return sums, targets


def test_targets_and_takings_of_many_sources(spark):
    rng = np.random.default_rng(70)
    rows = [(i, [None, "a", "b", "c", "é", "z"][int(rng.integers(0, 6)) if i % 3 else 1], int(rng.integers(0, 300))) for i in range(3000)]
    sums, targets = taken(spark, rows)
    assert all(abs(sums[s] - t) <= 0.01 * t for s, t in targets.items())


def test_one_document_of_four_tenths_of_its_source(spark):
    rows = [(0, "a", 4_000)] + [(i, "a", 100) for i in range(1, 61)] + [(100 + i, "b", 100) for i in range(500)] + [(700 + i, "c", 50) for i in range(100)]
    sums, targets = taken(spark, rows)
    assert all(abs(sums[s] - t) <= 100 for s, t in targets.items())


def test_sources_of_a_few_documents(spark):
    """No choice of whole copies comes nearer."""
    rng = np.random.default_rng(7)
    rows = [(k, f"s{k // 4}", int(rng.integers(1, 1000))) for k in range(40)] + [(1000 + i, "t", 10) for i in range(3000)] + [(5000, "zero", 0)]
    sums, targets = taken(spark, rows)
    for s in {r[1] for r in rows if r[1].startswith("s")}:
        sizes = [r[2] for r in rows if r[1] == s]
        assert abs(sums[s] - targets[s]) <= max(sizes) / 2 + 1
    assert sums["zero"] == 0


def test_rows_that_share_a_key(spark):
    rows = [(1, "a", 500)] * 3 + [(1, "a", 20), (None, "a", 400), (None, "a", 400)] + [(10 + i, "a", 5) for i in range(200)]
    sums, targets = taken(spark, rows)
    assert abs(sums["a"] - targets["a"]) <= 0.02 * targets["a"]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    by = collections.defaultdict(set)
    for r in mixing.mix(df, size=F.col("n")).collect():
        by[r.doc_id, r.size].add(r.copies)
    assert all(len(c) == 1 for c in by.values())
