"""Byte-pair encoding and decoding with a public byte-level vocabulary.

A word's parts and the ranks of adjacent parts are kept in two contiguous
arrays; the smallest rank is looked up again and again, one boundary goes, and
the two neighbouring ranks are refreshed.  Words above ``SHORT`` bytes, for
which that scan would be quadratic, merge in the same order from a heap.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import map_arrow, read, replace_column, slices

#: Fixed value: the pattern that cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 128
#: Words whose ids one worker remembers before a new generation of them.
CACHE = 200_000
_NONE = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The vocabulary's letter of each byte: printable Latin-1 stands for itself,
    the other bytes follow from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Packed ids by word, merged when first asked for."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge
        self.older: dict[str, bytes] = {}

    def turn(self) -> None:
        """Start a new generation; words in use come back from the older one."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.merge(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(word) <= SHORT:
            self[word] = ids
        return ids


def _ranges(points: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


class _Words:
    """Cuts a text by ``PATTERN``.  The standard library's matcher is twice as
    fast, but has no character properties: they are looked up once for every
    block of 256 characters that a text has, and become plain classes."""

    KINDS = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s")]

    def __init__(self) -> None:
        self.blocks: set[int] = set()
        self.points: list[list[int]] = [[], [], []]
        self._learn({0})

    def _learn(self, blocks: set[int]) -> None:
        for block in sorted(blocks - self.blocks):
            for point in range(block << 8, (block + 1) << 8):
                for kind, points in zip(self.KINDS, self.points):
                    if kind.match(chr(point)):
                        points.append(point)
                        break
        self.blocks |= blocks
        letter, digit, blank = (_ranges(sorted(p)) for p in self.points)
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+"
                              f"|[{blank}]+(?![^{blank}])|[{blank}]+").findall
        known = _ranges(sorted(p for b in self.blocks for p in range(b << 8, (b + 1) << 8)))
        self.new = re.compile(f"[^{known}]").search

    def findall(self, text: str) -> list[str]:
        if not text.isascii() and self.new(text):
            self._learn(self.blocks | {ord(c) >> 8 for c in set(text)})
        return self.cut(text)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max(
            [*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cut_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
                                         or r"(?!)")
        self.words = _Words()
        self.known = _Known(self.merge)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        if len(word) > SHORT:
            return self._merge_long(word)
        parts, rank = [self.first[b] for b in word], self.rank.get
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], _NONE)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        parts, n = [self.first[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or self.rank.get(parts[i] << 20 | parts[j]) != r:
                continue  # one of the two has changed since
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := self.rank.get(parts[a] << 20 | parts[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str, out: list[bytes]) -> None:
        known = self.known
        if len(known) > CACHE:
            known.turn()
        out.extend(map(known.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        out: list[bytes] = []
        at = 0
        for m in self.cut_special.finditer(text):
            self._plain(text[at:m.start()], out)
            out.append(np.int32(self.special[m[0]]).tobytes())
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        table, n = self.bytes_of, len(self.bytes_of)
        return b"".join([table[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _encoded(batches, path: str, text: str, out: str):
    v = vocabulary(path)
    for batch in slices(batches, text, 4 << 20):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        got = [None if t is None else v.encode(t) for t in texts]
        sizes = np.array([0 if g is None else len(g) // 4 for g in got], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join([g or b"" for g in got]), np.int32), pa.int32())
        ids = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([g is None for g in got]))
        yield replace_column(batch, out, ids)


def _decoded(batches, path: str, ids: str, out: str):
    v = vocabulary(path)
    for batch in slices(batches, ids, 4 << 20):
        column = batch.column(batch.schema.get_field_index(ids))
        if column.null_count:
            texts = [None if (x := column[i].as_py()) is None else v.decode(x) for i in range(len(column))]
        else:
            texts = _decode_all(v, column)
        yield replace_column(batch, out, pa.array(texts, pa.string()))


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``out``: the token ids of each whole text (array of int).

    A null text gives null, an empty one an empty array; special tokens that
    stand in a text are found as such.  Rows are independent (repeated rows
    alike, an empty table stays empty); other columns pass through, one named
    ``out`` gives way.  ``path``: the vocabulary file, at the same place on
    every worker.
    """
    path = path or default_path()
    return map_arrow(df, lambda batches: _encoded(batches, path, text, out), _with(df.schema, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out``: the text of each array of ids, special tokens included.

    Null ids give null, an empty array an empty text; null items and ids that
    the vocabulary lacks give nothing; bytes that are no UTF-8 give U+FFFD.
    """
    path = path or default_path()
    return map_arrow(df, lambda batches: _decoded(batches, path, ids, out), _with(df.schema, out, T.StringType()))


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``decode(encode(df))``, less the column ``text``, in one pass of the
    workers: the ids do not travel to the JVM and back between the two."""
    path = path or default_path()

    def run(batches):
        for batch in _encoded(batches, path, text, ids):
            rest = [n for n in batch.schema.names if n != text]
            yield from _decoded(iter([batch.select(rest)]), path, ids, out)

    return map_arrow(df, run, _with(_with(df.drop(text).schema, ids, T.ArrayType(T.IntegerType())), out, T.StringType()))


def _decode_all(v: Vocabulary, column: pa.ListArray) -> list[str]:
    flat = column.flatten()
    sound = not flat.null_count and (not len(flat) or (0 <= pc.min(flat).as_py() and pc.max(flat).as_py() < len(v.bytes_of)))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    if not sound:
        flat = flat.to_pylist()
        return [v.decode(flat[a:b]) for a, b in zip([0, *ends], ends)]
    flat = flat.to_numpy(zero_copy_only=False)
    return [b"".join([_bytes_of(v, flat[at:min(at + _GATHERED, b)]) for at in range(a, b, _GATHERED)]).decode("utf-8", "replace")
            for a, b in zip([0, *ends], ends)]


#: Ids whose bytes are gathered at a time.
_GATHERED = 1 << 16


def _bytes_of(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of valid ids: one gather from the tokens' bytes laid end to end."""
    sizes = v.sizes[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(v.starts[ids] - ends + sizes, sizes)
    at += np.arange(len(at))
    return v.blob[at].tobytes()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = round_trip(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
