"""Exact top-k inner products, pruned by segment statistics.

A vector, turned so that its leading components hold most of its length, is cut
into segments: the leading components, one each, and the rest as one.  Per segment
it keeps the mean and the deviation (norm of what the mean leaves).  |q - x|^2 is
at least the sum over segments of n (mean_q - mean_x)^2 + (dev_q - dev_x)^2, so
with the norms, which the turn keeps, an inner product is at most the sum of
n mean_q mean_x + dev_q dev_x: a product of two short vectors.  Resolutions go from
one segment to many; what survives them all gets its exact product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.common import read, stash

QUERY_BLOCK = 1_024
ROW_BLOCK = 4_096
#: Leading components that are segments of their own, coarse to fine.
RESOLUTIONS = (2, 16, 40, 56)
#: Vectors that the turn is fitted on, at most; it only decides how much is pruned.
SAMPLE = 4_096
_LONG = (1 << 63) - 1


def quantised(vector: str, factor: int = 256):
    """floor(factor * x) of each component, or null unless all of them are finite."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(factor)))
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # doubles from 2**53 on are whole, and may exceed what floor returns
    return F.when(fine, F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)))


def fit_turn(v: np.ndarray) -> np.ndarray:
    """An orthogonal matrix: the directions of largest second moment first."""
    scale = np.abs(v).max(initial=0) or 1.0
    return np.linalg.eigh((v / scale).T @ (v / scale))[1][:, ::-1]


def _segments(v: np.ndarray, lead: int) -> np.ndarray:
    """Rows whose product bounds the inner product from above: the leading
    components, then sqrt(n) times the mean of the rest, and its deviation."""
    lead = min(lead, v.shape[1])
    rest = v[:, lead:]
    if not rest.shape[1]:
        return v
    mean = rest.mean(1)
    return np.column_stack([v[:, :lead], np.sqrt(rest.shape[1]) * mean, np.linalg.norm(rest - mean[:, None], axis=1)])


def _pruned(q: np.ndarray, x: np.ndarray, allowed: np.ndarray, k: int, turn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of what survives every resolution."""
    (tq, tx) = (q, x) if turn is None else (q @ turn, x @ turn)
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1).max(initial=0))
    floor, alive = np.full(len(q), -np.inf), allowed.copy()
    for lead in RESOLUTIONS:
        bound = _segments(tq, lead) @ _segments(tx, lead).T + slack
        bound[~alive] = -np.inf
        if x.shape[0] > k:  # the most promising rows' exact products raise the floor
            first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            known = np.einsum("qd,qkd->qk", q, x[first])
            known[~np.take_along_axis(alive, first, 1)] = -np.inf
            floor = np.maximum(floor, known.min(1))
        alive &= bound >= floor[:, None]
        if lead >= q.shape[1]:
            break
    i, j = np.nonzero(alive)
    scores = np.concatenate([np.einsum("nd,nd->n", q[i[s:s + 65_536]], x[j[s:s + 65_536]]) for s in range(0, max(1, len(i)), 65_536)])
    return i, j, scores


def _whole(a: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(a)


def block_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int,
              turn: np.ndarray | None = None, exact: list | None = None):
    """The k best rows of a block for each query: (query id, row id, score).
    ``exact`` collects how many exact products were taken, of how many pairs."""
    order = np.argsort(x_ids, kind="stable")
    x, x_ids = x[order], x_ids[order]
    # products of these are whole numbers below 2**53; others are taken in Python's integers
    most = np.sqrt(2.0 ** 53 / x.shape[1])
    plain_q, plain_x = np.abs(q).max(1) < most, np.abs(x).max(1) < most
    allowed = x_ids[None, :] != q_ids[:, None]
    found: list = [[] for _ in q]
    at_q, at_x = np.flatnonzero(plain_q), np.flatnonzero(plain_x)
    if len(at_q) and len(at_x):
        i, j, scores = _pruned(q[at_q], x[at_x], allowed[np.ix_(at_q, at_x)], k, turn)
        if exact is not None:
            exact.append((len(i), len(at_q) * len(at_x)))
        for n, row, score in zip(at_q[i].tolist(), at_x[j].tolist(), scores.tolist()):
            found[n].append((-int(score), row))
    whole_x = None
    for n in range(len(q)):
        rows = np.flatnonzero(~plain_x) if plain_q[n] else np.arange(len(x))
        if len(rows):
            whole_x = _whole(x) if whole_x is None else whole_x
            found[n] += [(-s, r) for s, r in zip((whole_x[rows] @ _whole(q[n])).tolist(), rows.tolist()) if allowed[n, r]]
    return [(q_ids[n], x_ids[row], -score) for n in range(len(q)) for score, row in sorted(found[n])[:k]]


def _beyond(score: int) -> tuple[int, int | None, str | None]:
    """(1, 0 or -1 as a score is above, in or below the longs; the long; digits
    that sort like the number)."""
    if abs(score) <= _LONG:
        return 0, score, None
    digits = f"{len(str(abs(score))):04d}{abs(score)}"
    return (1, None, digits) if score > 0 else (-1, None, digits.translate(str.maketrans("0123456789", "9876543210")))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products.

    ``rows`` and ``queries``: (vec_id long, v array<double> of whole numbers).
    Null ids or vectors take no part; rows that repeat a vec_id count once, with
    the smallest vector; ties go to the smaller vec_id; a row with the query's
    own vec_id is left out, and so are rows of another length.  Products are
    exact at any size and ranked as such; a score that is no long is null.
    Further columns are not looked at; empty tables have no rows.  Both sides are
    cut into blocks of bounded size, and each pair of blocks is one task's work;
    it returns k rows a query.
    """
    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        once = stash(df.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")), name)
        n = max(1, -(-once.count() // size))
        return once.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n

    (left, n_left), (right, n_right) = blocks(queries, QUERY_BLOCK, "queries"), blocks(rows, ROW_BLOCK, "rows")
    sample = [r["v"] for r in right.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    turns = {d: fit_turn(np.array([v for v in sample if len(v) == d])) for d in {len(v) for v in sample}}
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = left.select("vec_id", "v", F.col("block").alias("a"), spread(n_right).alias("b"), F.lit(True).alias("is_query")).unionByName(
        right.select("vec_id", "v", spread(n_left).alias("a"), F.col("block").alias("b"), F.lit(False).alias("is_query"))
    ).withColumn("dim", F.size("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["is_query"].to_numpy(bool)
        found = []
        if ask.any() and not ask.all():
            v, ids = np.stack(pdf["v"].to_list()), pdf["vec_id"].to_numpy(np.int64)
            found = block_top(v[ask], ids[ask], v[~ask], ids[~ask], k, turns.get(v.shape[1]))
        scores = [_beyond(score) for _, _, score in found]
        return pd.DataFrame({"query_id": pd.array([a for a, _, _ in found], "int64"), "vec_id": pd.array([b for _, b, _ in found], "int64"),
                             "beyond": pd.array([s[0] for s in scores], "int32"), "score": pd.array([s[1] for s in scores], "Int64"),
                             "digits": pd.Series([s[2] for s in scores], dtype=object)})

    found = both.groupBy("a", "b", "dim").applyInPandas(run, "query_id long, vec_id long, beyond int, score long, digits string")
    place = W.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), F.desc("digits"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every 50th vector, all rows searched: query_id, rank,
    vec_id, score (null where it is no long)."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("v"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


#: Every pair, where all products are longs.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
