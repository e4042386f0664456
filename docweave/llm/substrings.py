"""Substring dedup: every repeated passage of ``WORDS`` words, exactly.

Anchors are word grams that are the smallest by hash in some stretch of grams as
long as a passage holds, so two copies of a passage always share one (winnowing).
A window of ``WORDS`` words reaches far on one side of its anchor at least; where
the anchor and the half window on that side occur more than once, the window is
compared by digest; the first copy of a window, by key and place, stays.  What
later windows cover, to the word, goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import discard, map_arrow, read, slices, stash

WINDOW = 16
#: One end in 32 bytes, after at least 8; a chunk of MOST bytes ends anyway.
BITS = 5
LEAST = 8
MOST = 1_024
#: Words of the shortest passage that is removed, and of an anchor.
WORDS = 50
GRAM = 8
#: Windows are compared in so many parts, by digest, one after the other: what is
#: shuffled of them takes a part of the disk at a time.  A power of two.
PARTS = 2
#: Spans and keys of first copies that are broadcast to the texts, at most (24 bytes or less each).
BROADCAST_MARKS = 500_000
#: Words whose hashes a worker keeps.
CACHE = 500_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_GEAR = np.random.default_rng(4_096).integers(0, 1 << 16, 256, dtype=np.uint16)
_MASK = np.uint16(((1 << BITS) - 1) << (16 - BITS))


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks, the last one the length of the data."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # h(i) = sum of gear(byte i - k) << k over 16 bytes, in 16 bits
        grown = h.copy()
        grown[step:] += h[:-step] << np.uint16(step)
        h = grown
    ends, last = [], 0
    for p in (np.flatnonzero((h & _MASK) == 0) + 1).tolist():
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST:
            ends.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


class _Words(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h


def hashes(data: bytes, known: dict) -> np.ndarray:
    """Two 64-bit hashes of every word (a run of bytes that are not ASCII white space)."""
    return np.frombuffer(b"".join(map(known.__getitem__, data.split())), np.uint64).reshape(-1, 2)


def _grams(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    out, n = np.zeros(len(h) - width + 1, np.uint64), len(h) - width + 1
    for k in range(width):
        out *= base
        out += h[k:k + n]
    return (out ^ (out >> np.uint64(29))) * base


def anchors(h: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of every window of ``words`` words, which nothing
    outside the window decides, and the hashes of all grams."""
    gram = min(GRAM, words)
    if len(h) < words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = _grams(np.ascontiguousarray(h[:, 0]), gram, _BASES[0])
    view = np.lib.stride_tricks.sliding_window_view(g, words - gram + 1)
    at = np.concatenate([view[k:k + 65_536].argmin(axis=1) + np.arange(k, min(k + 65_536, len(view))) for k in range(0, len(view), 65_536)])
    return at, g


def halves(h: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window the place of its half in the text, and of every place that
    is one the digest: the anchor with the words on the side where the
    window has more of them, as many as every such window holds.  Equal windows
    have equal halves.  A place is twice that of the anchor, plus 1 for the left side."""
    at, g = anchors(h, words)
    gram = min(GRAM, words)
    side = (words - gram + 1) // 2
    left = at - np.arange(len(at)) >= side
    of = 2 * at + left
    places = np.unique(of)
    if not len(places):
        return of, places, np.empty(0, np.uint64)
    runs = _grams(np.ascontiguousarray(h[:, 1]), gram + side, _BASES[1])
    d = runs[places // 2 - np.where(places % 2 == 1, side, 0)] + g[places // 2] * _BASES[0] + (places % 2).astype(np.uint64)
    return of, places, d


def _anchor_rows(docs: DataFrame, words: int) -> DataFrame:
    """(id, place, d) of the ``halves`` of each text."""
    def run(batches):
        known = _Words()
        for batch in slices(batches, "text", 2 << 20):
            ids, places, digests = [], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, at, d = halves(hashes(t.encode("utf-8", "surrogatepass"), known), words)
                ids.append(np.full(len(at), i, np.int64))
                places.append(at)
                digests.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *ids])), pa.array(np.concatenate(places)),
                                              pa.array(np.concatenate(digests).view(np.int64))], names=["id", "place", "d"])

    return map_arrow(docs, run, "id long, place long, d long")


def _windows(docs: DataFrame, words: int) -> DataFrame:
    """(id, a, b, d1, d2, own): bytes [a, b) and digest of every window of
    ``words`` words whose half is one of ``places``; own: the text has the
    window before, and the first such copy ends before this one begins."""
    def of(i: int, t: str, places: np.ndarray, known: dict):
        data = t.encode("utf-8", "surrogatepass")
        h = hashes(data, known)
        s = np.flatnonzero(np.isin(halves(h, words)[0], places))
        if not len(s):
            return None
        raw = np.frombuffer(data, np.uint8)
        gap = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        d = [_grams(np.ascontiguousarray(h[:, k]), words, _BASES[k])[s].view(np.int64) for k in (0, 1)]
        a, b = starts[s], ends[s + words - 1]
        order = np.lexsort((d[1], d[0]))  # stable: equal windows by place
        new = np.append(True, (np.diff(d[0][order]) != 0) | (np.diff(d[1][order]) != 0))
        own = np.empty(len(s), bool)
        own[order] = a[order] >= b[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
        return np.full(len(s), i, np.int64), a, b, *d, own

    def run(batches):
        known = _Words()
        for batch in slices(batches, "text", 1 << 20):
            rows = [of(i, t, np.array(p, np.int64), known) for i, t, p in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            rows = [r for r in rows if r is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["id", "a", "b", "d1", "d2", "own"])

    return map_arrow(docs, run, "id long, a long, b long, d1 long, d2 long, own boolean")


def _spans(rows: DataFrame) -> DataFrame:
    """(id, spans, firsts) of (id, hits, firsts): the stretches that the hits
    cover, in order, and the distinct firsts."""
    def run(batches):
        for batch in batches:
            spans, sources = [], []
            for k in range(batch.num_rows):
                hits = batch.column(1)[k].values
                a, b = (hits.field(j).to_numpy(zero_copy_only=False) for j in range(2))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                spans.append([{"start": x, "end": y} for x, y in zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist())])
                sources.append(np.unique(batch.column(2)[k].values.to_numpy(zero_copy_only=False)).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(sources, pa.list_(pa.int64()))], names=["id", "spans", "firsts"])

    return map_arrow(rows.select("id", "hits", "firsts"), run, "id long, spans array<struct<start:long,end:long>>, firsts array<long>")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, spans, firsts): byte spans [start, end) to remove from each text, in
    order, and the keys that hold the first copies; only rows with any.

    The first copy of a window is the one with the smallest key, then place; a
    later one in the same text goes where it does not overlap the first.  Words
    count, not the white space between them.  Digests are pre-aggregated before
    they are dealt, and the joins back are plain joins, which AQE can split.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    found = stash(_anchor_rows(docs, words), "anchors")
    again = found.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    places = stash(found.join(again, "d").groupBy("id").agg(F.collect_list("place").alias("places")), "places")
    discard(found)
    windows = stash(_windows(docs.join(places, "id").select("id", "text", "places"), words), "windows")
    discard(places)
    parts = []
    for k in range(PARTS):
        some = windows.where(F.col("d1").bitwiseAND(F.lit(PARTS - 1)) == k)
        firsts = stash(some.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("own").alias("twice"))
                       .where("first < last OR twice").select("d1", "d2", "first"), "firsts")
        later = some.join(firsts, ["d1", "d2"]).where("id > first OR own")
        hits = later.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("hits"), F.collect_set("first").alias("firsts"))
        parts.append(stash(_spans(hits), "part"))
        discard(firsts)
    discard(windows)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    spans = stash(_spans(every.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("hits"),
                                                 F.flatten(F.collect_list("firsts")).alias("firsts"))), "spans")
    discard(*parts)
    return spans


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` with its texts less their repeated passages, and ``spans`` (byte
    spans of the old text) and ``firsts`` (keys that keep the passages); both
    null where nothing goes.

    Null and empty texts and rows without a key stay as they are.  Rows that
    share a key are one document: equal ones lose alike and keep their first
    copy, unequal ones should be given keys of their own.  Cuts keep whole
    characters.  Columns named ``spans`` or ``firsts`` give way.
    """
    marks = repeats(df, key, text, words).withColumnRenamed("id", "__id")
    if (marks.agg(F.sum(F.size("spans") + F.size("firsts"))).first()[0] or 0) <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    rest = [c for c in df.columns if c not in ("spans", "firsts")]
    joined = df.select(*rest).join(marks, F.col(key).cast("long") == F.col("__id"), "left").drop("__id")
    place = joined.columns.index(text)
    at = joined.columns.index("spans")

    def cut(t: str, spans: list[dict]) -> str:
        data, out, last = t.encode("utf-8", "surrogatepass"), [], 0
        for s in spans:
            a, b = s["start"], s["end"]
            while a < len(data) and data[a] & 0xC0 == 0x80:
                a += 1  # a character that a chunk's end splits stays whole
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            out.append(data[last:a])
            last = max(a, b)
        return b"".join([*out, data[last:]]).decode("utf-8", "replace")

    def run(batches):
        for batch in slices(batches, text, 4 << 20):
            texts = [t if t is None or not s else cut(t, s) for t, s in
                     zip(batch.column(place).to_pylist(), batch.column(at).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(joined, run, T.StructType(joined.schema.fields))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that loses a passage: its spans, the documents that
    keep the passages, and the digest of what is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = dedup(docs).where("spans IS NOT NULL")
    return cut.select("doc_id", F.size("spans").cast("long").alias("n_spans"),
                      F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_bytes"),
                      F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
                      F.col("firsts").alias("first_doc_ids"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
