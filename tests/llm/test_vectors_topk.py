"""op2 and op8 on tiny, huge and odd vectors; how much op8's bounds prune."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def near(spark, rows):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_near_duplicates_at_any_scale(spark):
    rows = []
    for n, scale in enumerate((1.0, 1e-200, 1e-300, 5e-324, 1e200, 1e308)):
        rows += [(10 * n, [scale, 0.0], n), (10 * n + 1, [0.0, scale], n), (10 * n + 2, [scale, 0.0], n)]
        if scale > 1e-310:
            rows += [(10 * n + 3, [scale, scale * 0.1], n), (10 * n + 4, [scale, scale * 0.3], n), (10 * n + 5, [-scale, 0.0], n)]
    rows += [(100, [1e-200, 0.0], 9), (101, [0.0, 1e-200], 9), (102, [1e200, 1e190], 9), (103, [1e300, 0.0], 9)]
    got = near(spark, rows)
    for n in range(6):
        assert got[10 * n][0] == (2 if 10 * n + 3 in got else 1) and got[10 * n + 1] == (0, 10 * n + 1, True)
        if 10 * n + 4 in got:
            assert got[10 * n + 3][1] == 10 * n and got[10 * n + 4][0] == 1 - 1 + int(np.dot([1, .1], [1, .3]) / math.hypot(1, .1) / math.hypot(1, .3) >= 0.98)
    assert got[101] == (0, 101, True) and got[100] == (2, 100, True) and got[103][1] == 100


def test_near_duplicates_odd_rows_and_clashes(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1),
            (7, [1.0, 0.0], None), (8, [], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "rep", "cell", "n_links", "kept", "component_id", "node")})
    out = vectors.near_duplicates(df)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None, True)], key=repr)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def best(rows, k, every):
    """Every pair, in fractions."""
    once = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        w = [math.floor(Fraction(x) * 256) for x in v]
        once[i] = min(once.get(i, w), w)
    out = []
    for q in sorted(once):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(once[q], w)), i) for i, w in once.items() if i != q and len(w) == len(once[q]))
            out += [(q, n + 1, i, -s if abs(s) < 2**63 else None) for n, (s, i) in enumerate(found[:k])]
    return out


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk, "RESOLUTIONS", (0, 2, 5))


def test_top_k_is_that_of_every_pair(spark, small_blocks):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * (1 if i % 3 else 0.01)).tolist()) for i in range(120)]
    rows += [(130, rows[3][1]), (131, rows[3][1]), (132, [0.0] * 8), (133, [-1.0] * 8), (140, [1e12, -1e12] + [0.1] * 6), (141, [1e12] * 8),
             (142, [3e38, -3e38] * 4), (143, [-1e300] * 8), (150, [1e17] * 8), (151, [0.5] * 8), (160, [float("inf")] * 8), (170, [1e306] * 8), (180, None),
             (190, [1.0, None] * 4), (200, []), (210, [1.0, 2.0]), (220, [3.0, -1.0]), (None, [1.0] * 8), (0, [9.0] * 8), (0, rows[0][1]), (230, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised("embedding").alias("v")).withColumns(
        {c: F.lit("clash") for c in ("block", "a", "b", "dim", "score", "rank")})
    got = topk.top_k(df, df.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == best(rows, 5, 10)
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0


def test_query_quantises_and_asks_every_50th(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) - 0.2).astype(np.float32).tolist()) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in topk.op8_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == best(rows, 5, 50) and len(got) == 15


def test_bounds_prune_a_clustered_table():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 64))
    v = np.floor(256 * (centres[rng.integers(0, 40, 4_096)] + 0.2 * rng.normal(size=(4_096, 64))))
    ids, exact = np.arange(len(v)), []
    found = topk.block_top(v[::64], ids[::64], v, ids, 5, topk.fit_turn(v), exact)
    want = [(q, int(x), int(s)) for q in ids[::64] for s, x in sorted(((float(v[q] @ v[x]), -x) for x in ids if x != q), reverse=True)[:5] for x in [-x]]
    assert [(int(a), int(b), c) for a, b, c in found] == want
    taken, pairs = exact[0]
    assert taken < 0.05 * pairs  # the rest was decided by segment statistics
