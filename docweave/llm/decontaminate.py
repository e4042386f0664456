"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is
one window).  Of the six 5-word hashes inside a window the smallest, the last of
equal ones, is its fingerprint, so the same ten words have the same fingerprint
wherever they stand: a shared span of ten words or more cannot be missed.

Fingerprints of documents pass a bit filter of bounded size, and each hit is
extended, first by the filter, to the run of windows around it.  Documents whose
runs read the same share one shape; the fingerprints of the shapes are joined
with those of the items, and the words of their windows compared in full.  Every
join has one row per key on the items' side, so a passage that many items and
documents share multiplies nothing; shapes with equal sets of hit windows share
one list of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import map_arrow, read, slices, stash

WINDOW = 10
GRAM = 5
#: The bit filter has 32 bits a hash, rounded up, and no more than this
#: many in all (8 MB); beyond, it lets more through, and the join decides.
FILTER_BITS = 1 << 26
#: Word hashes that a worker remembers.
REMEMBERED = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ODD = np.random.default_rng(13).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of ASCII letters, digits and all other characters."""
    return text.translate(_LOWER).split() if text else []


class _Hashes(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j:len(h) - k + 1 + j] * _ODD[j]
    out ^= out >> np.uint64(32)
    out *= _ODD[0]
    return out ^ (out >> np.uint64(29))


def _winnow(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, its place) of the window from every word on."""
    g = _grams(h, GRAM)
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best, place = g[:n].copy(), np.arange(n)
    for j in range(1, WINDOW - GRAM + 1):
        less = g[j:n + j] <= best
        np.copyto(best, g[j:n + j], where=less)
        np.copyto(place, np.arange(j, n + j), where=less)
    return best, place


def _read_words(batch: pa.RecordBatch, column: str, known: _Hashes) -> tuple[list[list[bytes]], np.ndarray]:
    texts = [words_of(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    n = sum(map(len, texts))
    return texts, np.fromiter((known[w] for t in texts for w in t), np.uint64, n)


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item string, window, fp long, code long, m int): the windows of every
    item, with their fingerprint, the hash of all their words, and their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches, "text", 1 << 20):
            texts, h = _read_words(batch, "text", known)
            at = 0
            for item, words in zip(batch.column(0).to_pylist(), texts):
                own, m = h[at:at + len(words)], min(len(words), WINDOW)
                at += len(words)
                codes = _grams(own, m) if m else own
                fps = _winnow(own)[0] if m == WINDOW else codes
                for start in range(0, len(fps), 10_000):  # a long item in bounded pieces
                    part = slice(start, min(start + 10_000, len(fps)))
                    shown = [b" ".join(words[s:s + m]) for s in range(part.start, part.stop)]
                    n = len(shown)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * n, pa.string()), pa.array(shown, pa.binary()), pa.array(fps[part].view(np.int64)),
                         pa.array(codes[part].view(np.int64)), pa.array([m] * n, pa.int32())], names=["item", "window", "fp", "code", "m"])

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    return map_arrow(rows, run, "item string, window binary, fp long, code long, m int")


def _bit_filter(codes: DataFrame) -> np.ndarray:
    """Two bits a value; the driver gets the words of the filter that are not 0,
    at most ``FILTER_BITS`` / 64 of them."""
    size, wanted = 1 << 16, 32 * codes.count()
    while size < min(wanted, FILTER_BITS):
        size *= 2
    bit = F.explode(F.array(F.col("code").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("code", 32).bitwiseAND(F.lit(size - 1))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = (codes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(one).alias("bits"))).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask, found = np.uint64(len(bits) * 64 - 1), np.ones(len(h), bool)
    for shift in (0, 32):
        b = (h >> np.uint64(shift)) & mask
        found &= (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return found


_SPAN = pa.struct([("starts", pa.list_(pa.int64())), ("words", pa.binary()), ("fps", pa.list_(pa.int64()))])


def _spans(texts: list[list[bytes]], h: np.ndarray, bits: np.ndarray, short: list[int]) -> list[list[dict]]:
    """Per document, what may be hit: runs of windows whose fingerprint and words
    the filter lets through (``fps``: one a window), and short windows with all
    their places."""
    out: list[list[dict]] = [[] for _ in texts]
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]

    def inside(places: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(ends, places, "right")
        keep = places + m <= ends[doc]
        return places[keep], doc[keep]

    best, place = _winnow(h)
    if len(best):
        runs = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
        at = np.flatnonzero(np.repeat(_passes(bits, best[runs[:-1]]), np.diff(runs)))
        at = at[_passes(bits, _grams(h, WINDOW)[at])]
        at, doc = inside(at, WINDOW)
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1
        for windows in np.split(at, cuts) if len(at) else ():
            d = int(np.searchsorted(ends, windows[0], "right"))
            first = int(windows[0] - begins[d])
            out[d].append({"starts": [first], "words": b" ".join(texts[d][first:first + len(windows) - 1 + WINDOW]),
                           "fps": best[windows].view(np.int64).tolist()})
    for m in short:
        g = _grams(h, m)
        seen: dict = {}
        for p, d in zip(*(a.tolist() for a in inside(np.flatnonzero(_passes(bits, g)), m))):
            first = p - int(begins[d])
            shown = b" ".join(texts[d][first:first + m])
            if (d, shown) not in seen:
                seen[d, shown] = {"starts": [], "words": shown, "fps": [int(g[p].view(np.int64))]}
                out[d].append(seen[d, shown])
            seen[d, shown]["starts"].append(first)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _merged(starts: pd.Series, stops: pd.Series) -> pd.Series:
    """The union of spans, in order; none where there are none."""
    out = []
    for a, b in zip(starts, stops):
        if a is None or not len(a):
            out.append([])
            continue
        order = np.argsort(a, kind="stable")
        a, top = a[order], np.maximum.accumulate(b[order])
        new = np.flatnonzero(np.concatenate(([True], a[1:] > top[:-1])))
        out.append(np.stack([a[new], top[np.append(new[1:], len(a)) - 1]], axis=1).tolist())
    return pd.Series(out)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, n_words, n_hit (words inside an
    occurrence of a window of an item), spans (merged runs of hit words, as word
    numbers from 0, ``stop`` exclusive) and items (ids of the items with a window
    that occurs, as strings in order).

    Null and empty texts have no words.  Rows that share a key stay rows of
    their own; rows without a key are scanned like others.  An item without a key
    hits words but is in no list; items that share a key count once.  With empty
    tables nothing is hit.  Further columns are not looked at.
    """
    windows = stash(item_windows(items, item_key, item_text).groupBy("fp", "window").agg(
        F.min("code").alias("code"), F.min("m").alias("m"), F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("set", F.md5(F.to_json("items").cast("binary"))), "windows")
    bits = _bit_filter(windows.select(F.explode(F.array("fp", "code")).alias("code")).distinct())
    short = [r["m"] for r in windows.where(F.col("m") < WINDOW).select("m").distinct().collect()]  # at most 9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches, "text", 4 << 20):
            texts, h = _read_words(batch, "text", known)
            found = _spans(texts, h, bits, short)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.list_(_SPAN))],
                names=["key", "n_words", "found"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    scanned = map_arrow(rows, run, f"key {kind}, n_words long, found array<struct<starts: array<long>, words: binary, fps: array<long>>>")
    # documents with the same possible spans, wherever they stand, share a shape
    scanned = stash(scanned.select("key", "n_words", F.expr("transform(found, x -> x.starts)").alias("starts"),
                                   F.expr("transform(found, x -> struct(x.words, x.fps))").alias("shape"))
                    .withColumn("shape_id", F.when(F.size("shape") > 0, F.md5(F.to_json("shape").cast("binary")))), "scanned")

    shapes = scanned.where("shape_id IS NOT NULL").groupBy("shape_id").agg(F.min("shape").alias("shape"))
    hits = (shapes.select("shape_id", F.posexplode("shape").alias("span", "x"))
            .select("shape_id", "span", F.split(F.col("x.words").cast("string"), " ", -1).alias("w"), "x.fps")
            .select("shape_id", "span", "w", (F.size("w") - F.size("fps") + 1).alias("m"), F.posexplode("fps").alias("i", "fp"))
            .select("shape_id", "span", "m", "i", "fp", F.expr("cast(array_join(slice(w, i + 1, m), ' ') as binary)").alias("window"))
            .join(windows.select("fp", "window", "set"), ["fp", "window"]))
    per = stash(hits.groupBy("shape_id").agg(F.collect_list(F.struct("span", "i", "m")).alias("hits"), F.sort_array(F.collect_set("set")).alias("sets"))
                .withColumn("sets_id", F.md5(F.to_json("sets").cast("binary"))), "hits")
    lists = (per.groupBy("sets_id").agg(F.min("sets").alias("sets")).select("sets_id", F.explode("sets").alias("set"))
             .join(windows.groupBy("set").agg(F.min("items").alias("items")), "set")
             .groupBy("sets_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    found = per.join(lists, "sets_id", "left").select("shape_id", "hits", "items")
    ends = F.expr("flatten(transform(hits, x -> transform(starts[x.span], s -> struct(s + x.i as start, s + x.i + x.m as stop))))")
    spans = F.transform(_merged(F.expr("ends.start"), F.expr("ends.stop")), lambda x: F.struct(x[0].alias("start"), x[1].alias("stop")))
    return (scanned.select("key", "n_words", "starts", "shape_id").join(found, "shape_id", "left")
            .withColumn("ends", ends).withColumn("spans", spans)
            .select(F.col("key").alias(key), "n_words",
                    F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)").alias("n_hit"), "spans",
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids
    joined by commas; of the empty string without any) and contaminated."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
    lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) AS g FROM iw WHERE len(w) > 0),
dwin AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, unnest(list_transform(range(1, len(w) - m + 2),
    lambda s: array_to_string(w[s:s + m - 1], ' '))) AS g FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hits AS (SELECT doc_id, s, m, g FROM dwin WHERE g IN (SELECT g FROM win)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
lists AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM hits JOIN win USING (g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN lists USING (doc_id)
"""
