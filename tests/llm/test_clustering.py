"""op12 against Lloyd's rounds in full, in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import clustering

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, dims, k, rounds):
    kept = [(i, [math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in v], v) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    centroids = [r[1] for r in sorted(kept, key=code)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v, _ in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v, _), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for i, v, _ in kept:
        d, c = nearest(v)
        out.append((i, c, d if d < 2**63 else None))
    return sorted(out, key=repr), centroids


def got(spark, rows, **kw):
    found, centroids = clustering.cluster(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance").collect()), key=repr), centroids


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 6)) * 0.4
    out = [(i, (centres[i % 5] + rng.normal(size=6) * 0.15).tolist()) for i in range(400)]
    out += [(1000, out[0][1]), (1000, out[0][1]), (1001, [0.0] * 6), (1002, [-0.0001] * 6), (1003, None), (1004, []), (1005, [1.0] * 5),
            (1006, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1007, [float("nan")] + [0.0] * 5), (1008, [float("inf")] + [0.0] * 5), (None, [0.25] * 6)]
    return out


def test_clusters_are_those_of_full_rounds(spark, rows):
    for k, rounds in ((8, 10), (3, 4), (1, 2), (5, 0)):
        assert got(spark, rows, dims=6, k=k, rounds=rounds) == plain(rows, 6, k, rounds)


def test_ties_and_repeated_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)] + [(7, [1.0, 0.0])] * 40
    assert got(spark, rows, dims=2, k=6, rounds=5) == plain(rows, 2, 6, 5)
    assert got(spark, rows[:3], dims=2, k=8, rounds=3) == plain(rows[:3], 2, 8, 3)  # fewer vectors than clusters


def test_components_of_any_size_are_exact(spark, rows):
    huge = rows[:60] + [(5000, [1e12, -1e12, 0.0, 0.0, 0.0, 1.0]), (5001, [3e38] * 6), (5002, [-1e305] + [0.0] * 5), (5003, [1e-300] * 6), (5004, [2e9] * 6)]
    found, centroids = got(spark, huge, dims=6, k=4, rounds=6)
    assert (found, centroids) == plain(huge, 6, 4, 6)
    assert any(d is None for _, _, d in found)  # above a long


def test_only_expired_gaps_are_rescanned():
    rng = np.random.default_rng(2)
    v = (np.concatenate([rng.normal(size=(300, 4)) * 0.1 + c for c in np.eye(4) * 3]) * 1024).astype(np.int64)
    c = v[[0, 300, 600, 900]].copy()
    first = clustering._round(v, c, [0.0] * 4, None)
    heaps = (first["sizes"], first["gaps"], first["places"])
    assert first["rescanned"] == 1200
    still = clustering._round(v, c, [0.0] * 4, heaps)
    assert still["rescanned"] == 0 and still["moves"] == [] and still["gaps"] == first["gaps"]
    moved = c + 3
    drift = [float(np.sqrt(((moved - c) ** 2).sum(1))[0]) * 2] * 4
    after = clustering._round(v, moved, drift, heaps)
    assert after["rescanned"] < 100
    far = clustering._round(v, c[::-1].copy(), [1e6] * 4, heaps)
    assert far["rescanned"] == 1200 and far["sizes"] == first["sizes"][::-1]


def test_query_columns_and_empty_table(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, (v * 11)[:64]) for i, v in rows[:50]], SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("id", "v", "block", "cluster", "distance", "x", "ids")})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = clustering.op12_clusters(spark, str(tmp_path)).toPandas()
    want, centroids = plain([(i, (v * 11)[:64]) for i, v in rows[:50]], 64, 8, 10)
    assert sorted(zip(found.vec_id, found.cluster, found.distance)) == sorted(want)
    assert set(found.inertia) == {sum(d for _, _, d in want)}
    for r in found.itertuples():
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    df.where("false").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    none = clustering.op12_clusters(spark, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == list(found.columns)
