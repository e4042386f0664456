"""Mixing sources to target weights by entropy balancing.

Documents carry a rate (expected copies).  Among all rates that give every
margin (source) its target number of words, the ones closest to "every word
once" in relative entropy are exp(sum of the margins' multipliers); the
multipliers minimise a convex dual, which Newton steps solve over the table of
margin cells.  Rates are rounded to whole copies by a hash of the document's
key, with the phase per source that comes nearest to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.common import WORD, read, stash

#: Candidate phases of the rounding; the best one per source is taken.
PHASES = 64
#: A document of at least this part of its source's words is settled on its own.
LARGE = 128


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of (source, source_size): sources in code-point order, null last,
    weigh ``weights`` in turn and share ``share`` of all words; a target stops
    at ``cap`` times its source's size and the excess is shared again.

    The shared level is the largest of (total - caps before) / (weights left)
    along the sources ordered by cap per weight.  One row per source meets in
    one task here, never documents.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    order = W.orderBy("__ratio", F.col("source").asc_nulls_last())
    t = (sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
         .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
         .withColumn("__ratio", F.col("__cap") / F.col("__w"))
         .withColumn("__total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
         .withColumn("__before", F.coalesce(
             F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("__left", F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("__level", F.max((F.col("__total") - F.col("__before")) / F.col("__left"))
                     .over(W.partitionBy())))
    return t.select("source", "source_size",
                    F.least("__cap", F.col("__w") * F.greatest("__level", F.lit(0.0))).alias("target"))


def entropy_balance(cells: DataFrame, margins: dict[str, DataFrame], tolerance: float = 1e-9,
                    max_rounds: int = 200) -> DataFrame:
    """Add ``rate`` to ``cells``: a table with one row per combination of margin
    values and its ``mass`` (words).  ``margins`` maps a column of ``cells`` to
    its targets (that column, ``target``).

    Each round takes a Newton step for one margin after the other (the Hessian
    within a margin is diagonal: the words now taken), at most 1 either way,
    which keeps the exponentials finite.  Only the largest miss, relative to
    all words, comes to the driver.  Masses of 0 keep rate 1.
    """
    now = stash(cells.withColumn("__lam", F.lit(0.0)), "cells")
    for _ in range(max_rounds):
        miss = 0.0
        for column, targets in margins.items():
            taken = (now.groupBy(column).agg(F.sum(F.col("mass") * F.exp("__lam")).alias("__got"))
                     .alias("g").join(targets.alias("t"), F.expr(f"g.`{column}` <=> t.`{column}`"))
                     .select(F.col(f"g.{column}").alias("__key"), "__got", F.col("t.target").alias("__goal")))
            steps = stash(taken.withColumn("__step", F.when(F.col("__got") > 0, F.greatest(F.lit(-1.0), F.least(
                F.lit(1.0), F.col("__goal") / F.col("__got") - 1)))), "newton")
            worst = steps.where("__step IS NOT NULL").agg(
                F.max(F.abs(F.col("__got") - F.col("__goal"))).alias("d"), F.sum("__goal").alias("s")).first()
            off = (worst["d"] or 0.0) / max(worst["s"] or 0.0, 1.0)
            miss = max(miss, off)
            if off > tolerance:
                now = stash(now.join(steps.select("__key", "__step"), F.expr(f"`{column}` <=> __key"), "left")
                            .withColumn("__lam", F.col("__lam") + F.coalesce("__step", F.lit(0.0)))
                            .drop("__key", "__step"), "cells")
        if miss <= tolerance:
            break
    return now.withColumn("rate", F.exp("__lam")).drop("__lam")


def _copies(u: Column, phase: Column, rate: Column) -> Column:
    spot = u + phase / F.lit(float(PHASES))
    return F.floor(rate) + F.when(spot - F.floor(spot) < rate - F.floor(rate), 1).otherwise(0)


def _settled(base: DataFrame, key: str, source: str, targets: DataFrame, cap: float) -> DataFrame:
    """``targets`` with ``__picks``, ``__rest`` and ``__rest_target``: the copies
    of each source's large documents, and what is left of its words and target.

    A document is large from 1 / ``LARGE`` of its source on, so a source has that
    many at most.  They are settled from the largest on: as often as the rate of
    what is still open says, to the nearest whole number that leaves the rest a
    rate it can have.  The error is carried on to the smaller ones.
    """
    large = (base.select(F.col(source).alias("__of"), F.col(key).alias("k"), F.col("__size").alias("z"))
             .join(targets.select(F.col("source").alias("__s"), "source_size"), F.expr("__of <=> __s"))
             .where(F.expr(f"z > 0 AND z * {LARGE} >= source_size"))
             .groupBy("__of", "k", "z").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("__of").agg(F.sort_array(F.collect_list(F.struct((F.col("z") * F.col("n")).alias("m"), F.xxhash64("k").alias("h"), "z", "k")), asc=False).alias("__large")))
    kind = base.schema[key].dataType.simpleString()
    # t and s: target and words still open; x.m words are decided next (rounded, so that ties are ties)
    step = f"""aggregate(__large,
        struct(target as t, cast(source_size as double) as s, cast(array() as array<struct<k: {kind}, z: bigint, c: int>>) as p),
        (a, x) -> transform(
            array(array_min(transform(sequence(0, {math.ceil(cap)}), c -> struct(
                round(greatest(0D, a.t - c * x.m - {float(cap)}D * (a.s - x.m)) + greatest(0D, c * x.m - a.t), 6) as miss, round(abs(c - a.t / a.s), 9) as far, c as c))).c),
            c -> struct(a.t - c * x.m as t, a.s - x.m as s, concat(a.p, array(struct(x.k as k, x.z as z, c as c))) as p))[0])"""
    found = targets.join(large, F.expr("source <=> __of"), "left").withColumn(
        "__large", F.coalesce("__large", F.expr(f"cast(array() as array<struct<m: bigint, h: bigint, z: bigint, k: {kind}>>)")))
    return found.withColumn("__a", F.expr(step)).select(
        "source", "source_size", "target", F.col("__a.p").alias("__picks"),
        F.greatest(F.lit(0.0), F.col("__a.s")).alias("__rest"), F.greatest(F.lit(0.0), F.col("__a.t")).alias("__rest_target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None,
        weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken (copies x size).

    Null texts have size 0; a null source is a source of its own; rows with one
    key, source and size are decided alike; an empty table gives no rows.  Input columns named
    like an output column give way.  Copies are 0..ceil(rate), rate <= ``cap``.
    Documents are only scanned and pre-aggregated by source, never dealt by it:
    a source of any size is spread over all tasks.  The table of sources joins
    back by Spark's own choice (broadcast below its size threshold).
    """
    size = words(F.col("text")) if size is None else size
    outputs = ("size", "source_size", "target", "rate", "copies", "taken")
    base = docs.withColumn("__size", size.cast("long")).withColumn("__u", F.shiftrightunsigned(
        F.xxhash64(F.col(key), F.lit(7)), 11) / F.lit(float(1 << 53)))
    base = base.drop(*[c for c in outputs if c in docs.columns])
    sizes = stash(base.groupBy(F.col(source).alias("source")).agg(F.sum("__size").alias("source_size")), "sources")
    targets = _settled(base, key, source, stash(weighted_targets(sizes, weights, share, cap), "targets"), cap)
    targets = stash(targets.withColumn("__rest_target", F.least("__rest_target", F.col("__rest") * F.lit(float(cap)))), "settled")
    rates = entropy_balance(targets.select("source", F.col("__rest").alias("mass")),
                            {"source": targets.select("source", F.col("__rest_target").alias("target"))})
    plan = stash(rates.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source"))
                 .select(F.col("t.source").alias("__source"), "t.source_size", "t.target", "t.__picks", "t.__rest_target",
                         F.least(F.round("r.rate", 7), F.lit(float(cap))).alias("rate")), "rates")
    rated = base.join(plan, F.col(source).eqNullSafe(F.col("__source")))
    # a large document's copies are settled; the others' depend on the phase
    own = F.filter("__picks", lambda x: x["k"].eqNullSafe(F.col(key)) & (x["z"] == F.col("__size")))
    rated = rated.withColumn("__set", F.when((F.col("__size") > 0) & (F.col("__size") * LARGE >= F.col("source_size")), F.get(own, F.lit(0))["c"])).drop("__picks")
    open_ = F.when(F.col("__set").isNull(), F.col("__size")).otherwise(0)
    sums = [F.sum(open_ * _copies(F.col("__u"), F.lit(float(k)), F.col("rate"))).alias(f"p{k}")
            for k in range(PHASES)]
    tried = rated.groupBy("__source", "__rest_target").agg(*sums)
    miss = F.array(*[F.struct(F.abs(F.col(f"p{k}") - F.col("__rest_target")).alias("d"), F.lit(float(k)).alias("k"))
                     for k in range(PHASES)])
    best = stash(tried.select(F.col("__source").alias("__s"), F.array_min(miss)["k"].alias("__phase")), "phases")
    chosen = rated.join(best, F.col("__source").eqNullSafe(F.col("__s")))
    return (chosen.withColumn("copies", F.coalesce("__set", _copies(F.col("__u"), F.col("__phase"), F.col("rate"))).cast("int"))
            .withColumn("taken", (F.col("copies") * F.col("__size")).cast("long"))
            .withColumnRenamed("__size", "size")
            .drop("__u", "__source", "__s", "__phase", "__set", "__rest_target"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = stash(docs.select("doc_id", "source", words(F.col("text")).alias("n")), "sizes")
    return mix(sized, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")

