"""Source divergence audit by count-level bitmaps.

Per language, terms get ids, and every group (language, source) stores, for each
number of occurrences, the bitset of the terms that occur so often in it.  For
two groups, AND and popcount of a bitset of each give the joint cells: how many
terms occur a times here and b times there.  Each cell's chi-square-like term f
is worked out once and multiplied by the cell; cells with a zero follow by
complement, from the bitsets' own sizes and the number of terms.

Terms of like frequency share a slot of about ``SLOT`` terms, so that rare terms
need few levels over many words, and frequent ones many levels over few.  Slots,
and pairs of tiles of ``TILE`` groups within them, are the unit of work; what a
slot knows of a pair is one number.  Numbers are exact integers throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import map_arrow, read, slices, stash

LEAST_DOCUMENTS = 3
TOP = 200
UNIT = 1_000_000_000
SLOT = 4_096
TILE = 64
#: Terms of a class (log2 of the occurrences) up to this one are taken a slot at
#: a time, others 64 at a time.
RARE = 6
#: The groups' totals are broadcast up to this many bytes, and dealt beyond.
BROADCAST_BYTES = 16 << 20
#: Counts a worker holds before it passes them on.
HELD = 400_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, summed as far as a
    worker holds them; a row with an empty term for every group."""
    def rows(held: dict) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (n, d) in held.items():
            cols[0] += [lang] * (len(n) + 1)
            cols[1] += [source] * (len(n) + 1)
            cols[2] += [b"", *n]
            cols[3] += [0, *n.values()]
            cols[4] += [0, *(d[t] for t in n)]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in slices(batches, "text"):
            for group, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                if group not in held:
                    held[group] = Counter(), Counter()
                n, d = held[group]
                terms = text.as_py().translate(_LOWER).split()
                size -= len(n)
                n.update(terms)
                d.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    return map_arrow(docs, run, "lang string, source string, term binary, n long, d long")


def _share(count: Column, whole: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / whole), exact beyond 64 bits too."""
    small = F.lit(UNIT) * (F.least(count, F.lit(9_000_000_000)) + 1)
    large = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return 1 + F.when(count < 9_000_000_000, F.call_function("div", small, whole)).otherwise(
        F.call_function("div", large, whole.cast("decimal(20,0)")).cast("long"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Side:
    """Groups of one tile in a run of words: rows are the levels, a group's level
    0 (no bits) first."""

    def __init__(self, gid: np.ndarray, n: np.ndarray, word: np.ndarray, bits: np.ndarray, whole: dict[int, int], words: int) -> None:
        zeros = np.array(sorted(whole), np.int64)
        level = np.unique(np.stack([np.concatenate([zeros, gid]), np.concatenate([np.zeros_like(zeros), n])]), axis=1, return_inverse=True)
        (self.gid, count), at = level[0], level[1].ravel()[len(zeros):]
        self.bits = np.zeros((len(self.gid), words), np.uint64)
        self.bits[at, word] = bits
        self.size = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.p = np.array([1 + UNIT * (c + 1) // whole[g] for g, c in zip(self.gid.tolist(), count.tolist())], np.int64)
        self.start = np.flatnonzero(count == 0)
        self.end = np.append(self.start[1:], len(count))


def _between(x: _Side, y: _Side, terms: int) -> np.ndarray:
    """Sum of f(p of the x group, p of the y group) over the run's terms, per
    x group and y group."""
    out = np.zeros((len(x.start), len(y.start)), np.int64)
    zero_y = y.p[y.start]
    for i, (s, e) in enumerate(zip(x.start, x.end)):
        zero_x = x.p[s]
        if e - s > 1:
            joint = np.zeros((e - s - 1, len(y.gid)), np.int64)
            for w in np.flatnonzero(x.bits[s:e].any(0)):
                joint += np.bitwise_count(x.bits[s + 1:e, w, None] & y.bits[None, :, w])
            a, b = np.nonzero(joint)
            cells = np.zeros(len(y.gid), np.int64)
            np.add.at(cells, b, joint[a, b] * _f(x.p[s + 1 + a], y.p[b]))
            only_y = y.size - joint.sum(0)
            only_x = x.size[s + 1:e, None] - np.add.reduceat(joint, y.start, axis=1)
            out[i] += np.add.reduceat(cells, y.start) + (only_x * _f(x.p[s + 1:e, None], zero_y)).sum(0)
        else:
            only_y = y.size
        out[i] += np.add.reduceat(only_y * _f(zero_x, y.p), y.start)
        neither = terms - x.size[s:e].sum() - np.add.reduceat(only_y, y.start)
        out[i] += neither * _f(zero_x, zero_y)
    return out


def _joint(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) of the pairs of groups, one of each tile, in a slot."""
    lang, level, _, low, high = key
    groups = rows[rows["n"] == 0]
    tiles = {t: dict(zip(g["gid"].tolist(), g["whole"].tolist())) for t, g in groups.groupby("tile")}
    terms = int(groups["terms"].iloc[0])
    rows = rows[rows["n"] > 0]
    gid, n, word, bits, tile = (rows[c].to_numpy() for c in ("gid", "n", "word", "bits", "tile"))
    bits = bits.astype(np.int64).view(np.uint64)
    words = -(-terms // 64)
    runs = [(0, words)] if 0 <= level <= RARE else [(w, w + 1) for w in range(words)]
    pairs = [(low, high)] if low == high else [(low, high), (high, low)]
    total = {p: 0 for p in pairs}
    ids: dict = {t: np.array(sorted(g)) for t, g in tiles.items()}
    for first, last in runs:
        sides = {}
        for t, whole in tiles.items():
            at = (tile == t) & (word >= first) & (word < last)
            sides[t] = _Side(gid[at], n[at], word[at] - first, bits[at], whole, last - first)
        for x, y in pairs:
            total[x, y] = total[x, y] + _between(sides[x], sides[y], min(terms, 64 * last) - 64 * first)
    out = []
    for x, y in pairs:
        a, b = np.repeat(ids[x], len(ids[y])), np.tile(ids[y], len(ids[x]))
        value = np.broadcast_to(total[x, y], (len(ids[x]), len(ids[y]))).ravel()
        out.append(pd.DataFrame({"lang": lang, "a": a, "b": b, "value": value})[a != b])
    return pd.concat(out)


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
          least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has a row per group
    and other source of its language, part 'term' the terms that the group holds
    above the language's share, as far as rank ``top``.

    Null texts, languages and sources are read as ''.  Every row is a document
    of its own, repeated ones too.  A group without terms is in the pairs; where
    a language keeps no term the value is 0.  Ties go to the smaller item in
    UTF-8.  An empty table has no rows.  Further columns are not looked at.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                     F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                     F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    cells = stash(_counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "cells")
    terms = stash(cells.where(F.length("term") > 0).groupBy("lang", "term").agg(F.sum("n").alias("t_n"), F.sum("d").alias("d"))
                  .where(F.col("d") >= least).select("lang", "term", "t_n", F.floor(F.log2("t_n")).cast("int").alias("level")), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("t_n").alias("t_whole"))
    levels = terms.groupBy("lang", "level").agg(F.ceil(F.count(F.lit(1)) / SLOT).alias("slots"))
    place = Window.partitionBy("lang", "level", "slot").orderBy(F.desc("t_n"), "term")
    # dealt by slot at once: a level may hold most of a language's terms
    ids = (terms.join(levels, ["lang", "level"]).withColumn("slot", F.pmod(F.xxhash64("term"), F.col("slots"))).repartition("lang", "level", "slot")
           .withColumn("id", F.row_number().over(place) - 1).select("lang", "term", "t_n", "level", "slot", "id"))
    kept = stash(cells.where(F.length("term") > 0).drop("d").join(ids, ["lang", "term"]), "kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    groups = stash(cells.where(F.length("term") == 0).select("lang", "source").distinct()
                   .join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
                   .select("lang", "source", "v", "t_whole", (F.coalesce("held", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("whole"),
                           (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("gid"))
                   .withColumn("tile", F.floor(F.col("gid") / TILE)), "groups")

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(F.lit(63)))
    bitmaps = (kept.groupBy("lang", "source", "level", "slot", F.shiftright("id", 6).alias("word"), "n").agg(F.bit_or(one).alias("bits"))
               .join(groups, ["lang", "source"])
               .select("lang", "level", "slot", "gid", "tile", "n", "word", "bits", F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("terms")))
    # every group is in every slot with level 0; a slot without terms makes sure that each language has one
    slots = ids.groupBy("lang", "level", "slot").agg(F.count(F.lit(1)).alias("terms")).unionByName(
        groups.select("lang").distinct().select("lang", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("terms")))
    zeros = slots.join(groups, "lang").select(
        "lang", "level", "slot", "gid", "tile", F.lit(0).cast("long").alias("n"), F.lit(0).alias("word"), F.lit(0).cast("long").alias("bits"), "whole", "terms")
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    dealt = (stash(bitmaps, "bitmaps").unionByName(zeros).join(tiles, "lang")
             .withColumn("other", F.explode(F.expr("sequence(0L, last)")))
             .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("last", "other"))
    joint = (dealt.groupBy("lang", "level", "slot", "low", "high").applyInPandas(_joint, "lang string, a long, b long, value long")
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    named = lambda n: groups.select("lang", F.col("gid").alias(n), F.col("source").alias(f"{n}_source"))
    pairs = joint.join(named("a"), ["lang", "a"]).join(named("b"), ["lang", "b"]).select(
        "lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    p, q = _share(F.col("n"), F.col("whole")), _share(F.col("t_n"), F.col("v") + F.col("t_whole"))
    totals = groups.select("lang", "source", "v", "t_whole", "whole")
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    # broadcast, the cells stay where they are, and each task cuts a group to its top before they meet
    over = (kept.join(F.broadcast(totals) if size <= BROADCAST_BYTES else totals, ["lang", "source"])
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q"))
            .where("p > q").select("lang", "source", "part", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return pairs.unionByName(over)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over the whole of documents."""
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS t FROM docs),
kept AS (SELECT lang, t, count(*) AS n FROM tok GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT lang, source, t, count(*) AS n FROM tok SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
lang_n AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
grp AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(whole_g, 0) AS whole FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS whole_g FROM cnt GROUP BY lang, source) USING (lang, source) LEFT JOIN lang_n USING (lang)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(g.whole + g.v AS HUGEINT) AS p
  FROM grp g JOIN kept k USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT lang, t, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(whole + v AS HUGEINT) AS q FROM kept JOIN lang_n USING (lang)),
terms AS (
  SELECT lang, source, 'term' AS part, t AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""
