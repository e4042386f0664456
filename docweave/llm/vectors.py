"""Embedding near-duplicates: spherical k-means cells, blocked cosine products
within cells, one representative per group.

Cells lose no pair.  A linked pair lies at most ``gap`` apart on the unit
sphere; if its two ends belong to cells i and j, each is within ``gap`` of the
plane between the two centres.  So a vector also visits every cell of a smaller
number whose plane is that near, and meets there what it could be linked with.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import map_arrow, read, replace_column, slices, stash
from docweave.llm.components import connected_components

COSINE = 0.98
#: Vectors that the centres are fitted on, at most, and centres, at most.
SAMPLE = 16_384
MAX_CELLS = 1_024
#: One cell per so many vectors; vectors of one block.
PER_CELL = 8_192
BLOCK = 1_024


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, its largest component between 0.5 and 1:
    exact, and no square under- or overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres; an empty cell keeps its centre."""
    u = _unit(v)
    centres = u[np.random.default_rng(seed).permutation(len(u))[:k]].copy()
    for _ in range(rounds):
        own = (u @ centres.T).argmax(1)
        for c in range(len(centres)):
            total = u[own == c].sum(0)
            if (norm := np.linalg.norm(total)) > 1e-12:
                centres[c] = total / norm
    return centres


def _cells(v: np.ndarray, centres: np.ndarray, gap: float) -> list[np.ndarray]:
    """Own cell first, then the cells of smaller number that a vector visits."""
    dots = _unit(v) @ centres.T
    own = dots.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    lead = dots[np.arange(len(v)), own][:, None] - dots
    near = (lead <= gap * apart[own] + 1e-9) & (np.arange(len(centres)) < own[:, None])
    return [np.concatenate(([o], np.flatnonzero(row))).astype(np.int32) for o, row in zip(own, near)]


def _assign(df: DataFrame, fitted: dict[int, np.ndarray], gap: float) -> DataFrame:
    """Add ``cells`` from ``v``; a length without centres has one cell."""
    def run(batches):
        for batch in slices(batches, "v"):
            rows = batch.column(batch.schema.get_field_index("v")).to_pylist()
            out: list = [None] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                if dim not in fitted:
                    for i in at:
                        out[i] = [0]
                    continue
                for i, c in zip(at, _cells(np.array([rows[i] for i in at]), fitted[dim], gap)):
                    out[i] = c.tolist()
            yield replace_column(batch, "cells", pa.array(out, pa.list_(pa.int32())))

    return map_arrow(df, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", cells array<int>")


def block_links(a: np.ndarray, b: np.ndarray | None, cosine: float) -> np.ndarray:
    """Which rows of a are linked with which of b (b None: of a itself)."""
    a, b = _scaled(a), None if b is None else _scaled(b)
    u = np.linalg.norm(a, axis=1)
    if b is None:
        m = (a @ a.T) >= cosine * np.outer(u, u)
        np.fill_diagonal(m, False)
        return m | m.T
    return (a @ b.T) >= cosine * np.outer(u, np.linalg.norm(b, axis=1))


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest id reachable within the block from each left and right row."""
    low_l, low_r = left.copy(), right.copy()
    big = np.iinfo(np.int64).max
    while True:
        new_r = np.minimum(low_r, np.where(links, low_l[:, None], big).min(0, initial=big))
        new_l = np.minimum(low_l, np.where(links, new_r[None, :], big).min(1, initial=big))
        if (new_l == low_l).all() and (new_r == low_r).all():
            return np.concatenate([new_l, new_r])
        low_l, low_r = new_l, new_r


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """``df`` with n_links, component_id and kept.

    Rows are compared if their labels are equal and not null.  Vectors that are
    null, empty, zero, or hold null or non-finite items have no link and are
    their own component; so are rows without a key (component null, kept).
    Rows that repeat a key are one vector if equal; unequal ones are one node
    whose links add up.  Only vectors of equal length are compared.  Equal
    vectors collapse into one class before any product, and a block pair
    returns counts and a spanning forest, never its pairs.
    """
    items = F.col(vector).cast("array<double>")
    fine = F.forall(items, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(items, lambda x: x != 0)
    valid = df.where(fine & F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), items.alias("v")).distinct()
    member = stash(valid.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    classes = stash(member.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                            F.first("v").alias("v")), "classes")
    gap = math.sqrt(2 - 2 * cosine)
    dims = [(r["d"], r["n"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "d").limit(16).collect()]
    fitted = {}
    for dim, n in dims:  # centres of the commonest lengths, from a bounded sample by hash
        k = min(MAX_CELLS, -(-n // PER_CELL))
        if k > 1:
            rows = classes.where(F.size("v") == dim).orderBy("h1", "h2", "label").limit(SAMPLE).select("v").collect()
            fitted[dim] = spherical_kmeans(np.array([r["v"] for r in rows]), k)
    placed = _assign(classes.select("label", "rep", "copies", "v", "h1"), fitted, gap)
    placed = stash(placed.select("label", "rep", "copies", "v", "h1", F.posexplode("cells").alias("visit", "cell"))
                   .withColumn("dim", F.size("v")).withColumn("visit", F.col("visit") > 0), "cells")
    group = ["label", "dim", "cell"]
    sizes = stash(placed.groupBy(*group).agg(F.sum((~F.col("visit")).cast("int")).alias("own"),
                                             F.sum(F.col("visit").cast("int")).alias("guests")), "sizes")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(BLOCK))).cast("int")
    dealt = placed.join(sizes, group)
    own = (dealt.where("NOT visit").withColumn("n_own", blocks("own")).withColumn("block", F.pmod("h1", F.col("n_own")).cast("int")))
    guests = dealt.where("visit").withColumn("block", F.pmod("h1", blocks("guests")).cast("int"))
    columns = [*group, "rep", "copies", "v"]
    # pairs of own blocks (a <= b), and own blocks (a) with blocks of guests (b)
    among = own.select(*columns, "block", F.explode(F.sequence(F.lit(0), F.col("n_own") - 1)).alias("other")).select(
        *columns, F.lit(False).alias("guest"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        (F.col("block") <= F.col("other")).alias("left"))
    hosts = own.where("guests > 0").select(*columns, "block", F.explode(F.sequence(F.lit(0), blocks("guests") - 1)).alias("b")).select(
        *columns, F.lit(True).alias("guest"), F.col("block").alias("a"), "b", F.lit(True).alias("left"))
    visitors = guests.withColumn("n_own", blocks("own")).select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("n_own") - 1)).alias("a"), "block").select(
        *columns, F.lit(True).alias("guest"), "a", F.col("block").alias("b"), F.lit(False).alias("left"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["left"].to_numpy(bool)
        ids, copies, v = pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), np.stack(pdf["v"].to_list())
        if pdf["guest"].iloc[0] or pdf["a"].iloc[0] != pdf["b"].iloc[0]:
            l, r = np.flatnonzero(left), np.flatnonzero(~left)
            m = block_links(v[l], v[r], cosine)
            at, counts = np.concatenate([l, r]), np.concatenate([m @ copies[r], m.T @ copies[l]])
            root = forest(m, ids[l], ids[r])
        else:
            m = block_links(v, None, cosine)
            at, counts, root = np.arange(len(ids)), m @ copies, forest(m, ids, ids)[:len(ids)]
        hit = counts > 0
        return pd.DataFrame({"rep": ids[at][hit], "links": counts[hit], "root": root[hit]}).astype("int64")

    found = stash(among.unionByName(hosts).unionByName(visitors).groupBy(*group, "guest", "a", "b")
                  .applyInPandas(run, "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # copies of one vector are linked with one another: the class is one node, named by its smallest key
    same_key = member.join(classes.select("label", "h1", "h2", "rep", "copies"), ["label", "h1", "h2"])
    extra = same_key.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(extra))
    per_id = (same_key.join(counts, "rep", "left").groupBy("id")
              .agg(F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    result = stash(per_id.join(parts, F.col("id") == F.col("node"), "left")
                   .select(F.col("id").alias("__id"), F.col("n_links").alias("__n"),
                           F.coalesce("component", "id").alias("__c")), "result")
    rest = [c for c in df.columns if c not in ("n_links", "component_id", "kept")]
    return (df.join(result, F.col(key).cast("long") == F.col("__id"), "left")
            .select(*rest, F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("__c", F.col(key)).cast("long").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")
