"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds, in exact integers.

A vector's gap is the distance to its second-nearest centroid less that to its
own.  Each cluster of a block of vectors keeps a heap of those gaps, each offset
by the drift that the cluster had accumulated when the vector came in: what its
centroid moved, plus the most that any other one moved.  Only vectors whose gap
the drift has used up are popped, rescanned against all centroids in exact
arithmetic, and pushed into the heap of their cluster; where a heap's top still
holds, the whole heap does, unseen.

Vectors are written once, in blocks, as a table bucketed by block; a round
shuffles only the heaps (about a fiftieth of the vectors) to them and writes the
next heaps, with the sums that its moved vectors change.  The driver holds the
centroids and their sums.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import discard, map_arrow, read, stash
from docweave.sources.layout import save_bucketed
from docweave.sources.scratch import scratch_dir

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
_LONG = (1 << 63) - 1
#: Sums travel in pieces of so many bits, so that they are exact at any size.
_PIECE = 60

_STATE = ("block long, sizes array<int>, gaps array<double>, places array<int>, rescanned int, "
          "moves array<struct<cluster: int, part: int, piece: int, v: long>>")


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64 where all fit 2**31, Python integers otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)  # exact: a power of two
    if (np.abs(scaled) < 1 << 31).all():
        return scaled.astype(np.int64)
    whole = [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the fastest type in which squared distances are exact."""
    top = max([1, *(int(np.abs(a).max()) for a in arrays if a.size)])
    need = 4 * top * top * max(a.shape[-1] for a in arrays)
    kind = np.float64 if need < 1 << 53 else np.int64 if need < 1 << 62 else object
    return [a.astype(kind) for a in arrays]


def _scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, gap): ties go to the smaller number; gaps are rounded down."""
    a, c = _exact(v, centroids)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    own = d.argmin(1)
    if d.shape[1] == 1:
        return own, np.full(len(v), np.inf)
    try:
        near = np.sqrt(np.partition(d.astype(np.float64), 1, axis=1)[:, :2])
    except OverflowError:  # beyond doubles: rescanned each round
        return own, np.full(len(v), -np.inf)
    return own, near[:, 1] - near[:, 0] - 1e-9 * (near[:, 0] + near[:, 1])


def _holds(key: float, offset: float) -> bool:
    return key > offset + 1e-12 * abs(offset)


def _pieces(total: int) -> Iterator[tuple[int, int]]:
    sign, total, i = (-1 if total < 0 else 1), abs(total), 0
    while total:
        yield i, sign * (total & ((1 << _PIECE) - 1))
        total, i = total >> _PIECE, i + 1


def _moves(v: np.ndarray, old: np.ndarray, new: np.ndarray) -> list[dict]:
    """What moved vectors change: per cluster, their number (part -1) and the sum of each component."""
    out = []
    moved = old != new
    for c in set(old[moved].tolist()) | set(new[moved].tolist()) - {-1}:
        if c < 0:
            continue
        came, left = moved & (new == c), moved & (old == c)
        totals = [int(came.sum()) - int(left.sum()), *(v[came].sum(0) - v[left].sum(0)).tolist()]
        out += [{"cluster": c, "part": part - 1, "piece": i, "v": p} for part, t in enumerate(totals) for i, p in _pieces(int(t))]
    return out


def _round(v: np.ndarray, centroids: np.ndarray, offsets: list[float], heaps: tuple | None) -> dict:
    """One block's heaps after a round: ``heaps`` are (sizes, gaps, places), or
    None where no vector has a cluster yet."""
    k = len(centroids)
    if heaps is None:
        own, gap = _scan(v, centroids)
        new: list[list] = [[] for _ in range(k)]
        for c, g, i in zip(own.tolist(), gap.tolist(), range(len(v))):
            new[c].append((g + offsets[c], i))
        for h in new:
            heapq.heapify(h)
        popped, moves = len(v), _moves(v, np.full(len(v), -1), own)
    else:
        sizes, gaps, places = heaps
        ends = np.cumsum(sizes)
        new, at, old = [], [], []
        for c in range(k):
            h = list(zip(gaps[ends[c] - sizes[c]:ends[c]], places[ends[c] - sizes[c]:ends[c]]))
            while h and not _holds(h[0][0], offsets[c]):
                at.append(heapq.heappop(h)[1])
                old.append(c)
            new.append(h)
        popped, moves = len(at), []
        if at:
            rows = v[at]
            own, gap = _scan(rows, centroids)
            for c, g, i in zip(own.tolist(), gap.tolist(), at):
                heapq.heappush(new[c], (g + offsets[c], i))
            moves = _moves(rows, np.array(old), own)
    return {"sizes": [len(h) for h in new], "gaps": [g for h in new for g, _ in h], "places": [i for h in new for _, i in h],
            "rescanned": popped, "moves": moves}


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    x = batch.column(batch.schema.get_field_index("x"))
    for i in range(batch.num_rows):
        yield i, _integers(np.asarray(x[i].values, dtype=np.float64).reshape(-1, dims))


def _next(blocks: DataFrame, state: DataFrame | None, centroids: list[list[int]], offsets: list[float], dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, dtype=object)
        schema = None
        for batch in batches:
            names, out = batch.schema.names, []
            for i, v in _blocks(batch, dims):
                heaps = None
                if "sizes" in names:
                    heaps = tuple(batch.column(names.index(n))[i].as_py() for n in ("sizes", "gaps", "places"))
                out.append({"block": batch.column(names.index("block"))[i].as_py()} | _round(v, c, offsets, heaps))
            schema = schema or pa.schema([("block", pa.int64()), ("sizes", pa.list_(pa.int32())), ("gaps", pa.list_(pa.float64())),
                                          ("places", pa.list_(pa.int32())), ("rescanned", pa.int32()),
                                          ("moves", pa.list_(pa.struct([("cluster", pa.int32()), ("part", pa.int32()),
                                                                        ("piece", pa.int32()), ("v", pa.int64())])))])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = blocks.select("block", "x")
    if state is not None:  # the heaps are the side that is hashed: the vectors are neither moved nor sorted
        rows = rows.join(state.select("block", "sizes", "gaps", "places").hint("shuffle_hash"), "block")
    return stash(map_arrow(rows, run, _STATE), "heaps")


def _distances(blocks: DataFrame, state: DataFrame, centroids: list[list[int]], dims: int, key: str) -> DataFrame:
    """(key, cluster, distance): squared, null above a long."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.array(centroids, dtype=object)
        for batch in batches:
            names = batch.schema.names
            for i, v in _blocks(batch, dims):
                sizes, places = (np.array(batch.column(names.index(n))[i].as_py(), np.int64) for n in ("sizes", "places"))
                own = np.empty(len(v), np.int64)
                own[places] = np.repeat(np.arange(len(sizes)), sizes)
                a, c = _exact(v, every)
                d = [int(x) for x in ((a - c[own]) ** 2).sum(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index("ids"))[i].values, pa.array(own, pa.int32()),
                     pa.array([x if x <= _LONG else None for x in d], pa.int64())], names=[key, "cluster", "distance"])

    rows = blocks.join(state.select("block", "sizes", "places").hint("shuffle_hash"), "block")
    return map_arrow(rows.select("block", "ids", "x", "sizes", "places"), run, f"`{key}` {kind}, cluster int, distance long")


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMENSIONS,
            k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance) of every vector, the final centroids).

    Vectors have exactly ``dims`` components, none null or non-finite; others
    take no part.  The first centroids are the ``k`` vectors (all, if fewer)
    with the smallest sha256 of '3:<key>'; vectors that share a key go by their
    components, those without a key come last, and both take part like others.
    Equal vectors are vectors of their own.  A distance above a long is null.
    An empty table has no rows and no centroids.  Further columns are not
    looked at.
    """
    spark = df.sparkSession
    items = F.col(vector).cast("array<double>")
    fine = (F.size(items) == dims) & F.forall(items, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(fine).select(F.col(key).alias("id"), items.alias("v"))
    code = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(code.asc_nulls_last(), "v").limit(k).collect()
    kind = df.schema[key].dataType.simpleString()
    if not first:
        return kept.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    centroids = [[int(x) for x in _integers(np.array([r["v"]]))[0]] for r in first]
    k = len(centroids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, n], batch.column(0)),
                                                  pa.ListArray.from_arrays([0, n * dims], batch.column(1).flatten())], names=["ids", "x"])

    name, buckets = f"docweave_blocks_{uuid.uuid4().hex[:12]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = map_arrow(kept, pack, f"ids array<{kind}>, x array<double>").withColumn("block", F.monotonically_increasing_id())
    blocks = save_bucketed(packed.repartition(buckets, "block"), name, scratch_dir(spark, "blocks"), buckets, "block")
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    offsets, state = [0.0] * k, None
    try:
        for n in range(rounds + 1):
            before, state = state, _next(blocks, state, centroids, offsets, dims)
            discard(before)
            changes = (state.select(F.explode("moves").alias("m")).groupBy("m.cluster", "m.part", "m.piece")
                       .agg(F.sum(F.col("m.v").cast("decimal(38,0)")).alias("v")).collect())  # k * (dims + 1) rows, times pieces
            for r in changes:
                v = int(r["v"]) << (_PIECE * r["piece"])
                if r["part"] < 0:
                    counts[r["cluster"]] += v
                else:
                    sums[r["cluster"]][r["part"]] += v
            moved = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)]
            if n == rounds or moved == centroids:  # nothing more can change
                break
            drift = [_root(sum((a - b) ** 2 for a, b in zip(moved[c], centroids[c]))) for c in range(k)]
            offsets = [o + drift[c] + max([0.0, *(d for j, d in enumerate(drift) if j != c)]) for c, o in enumerate(offsets)]
            centroids = moved
        out = stash(_distances(blocks, state, centroids, dims, key), "clusters")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    discard(state)
    return out, centroids


def _root(squared: int) -> float:
    """Square root, rounded up; infinite where doubles end."""
    try:
        return math.sqrt(squared) * (1 + 1e-12)
    except OverflowError:
        return math.inf


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia (null where
    they hold a distance that is null, or exceed a long), centroid_sha256."""
    rows, centroids = cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if not centroids:
        return rows.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    found = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                        F.count(F.lit(1)).alias("n"), F.count("distance").alias("m")).collect()  # a row a cluster
    own = {r["cluster"]: int(r["s"]) for r in found if r["n"] == r["m"] and r["s"] <= _LONG}
    total = sum(own.values()) if len(own) == len(found) else None
    coded = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))
    return rows.select("vec_id", "cluster", "distance", at([own.get(c) for c in range(len(centroids))], "long").alias("cluster_inertia"),
                       F.lit(total if total is not None and total <= _LONG else None).cast("long").alias("inertia"),
                       at(coded, "string").alias("centroid_sha256"))


def _oracle() -> str:
    """Lloyd's rounds in full, each against all centroids."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {CLUSTERS}))"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'c': c}}) AS m FROM (
    SELECT r, c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{n} k) GROUP BY r)""")
        if n < ROUNDS:
            parts.append(f"""s{n} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (
    SELECT c, j, sum(e) AS s, count(*) AS n FROM (
      SELECT m.c AS c, unnest(x) AS e, unnest(range({DIMENSIONS})) AS j FROM v JOIN a{n} USING (r)) GROUP BY c, j) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, CAST(coalesce(s.x, k.x) AS BIGINT[]) AS x FROM c{n} k LEFT JOIN s{n} s USING (c))""")
    last = ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM v JOIN a{last} USING (r) JOIN c{last} k ON k.c = m.c"""


ORACLE = _oracle()
