"""Language-model scoring: a hierarchical Pitman-Yor model of words.

Restaurants: one root over the vocabulary, with a uniform base, and one
restaurant per distinct previous word (and one for a text's start), all with the
root as parent.  A customer of a context restaurant is a training token; a table
of it is a customer of the root.  Gibbs sweeps reseat all customers of a dish
given the rest; the predictive probability of a token is averaged over the
sweeps after the first, and perplexity follows from its logs.

The work is dealt by word into blocks.  Each batch of texts packs, per block,
what it counts (word, context, document, times) into compressed arrays; a block
gathers them once and keeps them in a table bucketed by block.  What a sweep
needs from elsewhere is taken from one sweep to the next (so blocks sample in
parallel, each against the last sweep of the others).  The tables and customers
of a context are summed where the context is dealt to: a block sends those of its
contexts in an order settled beforehand, and gets the sums back in the same
order, so a sweep shuffles a few bytes per block and context.  Words so common
that they are spread over all blocks, and the totals, are sums of bounded number.
Sweeps are seeded, so a lost task changes nothing.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import map_arrow, read, remainder, shuffles_dropped, slices, stash, trim, trimmed
from docweave.sources.layout import save_bucketed
from docweave.sources.scratch import scratch_dir

#: Gibbs sweeps; the first only settles the seating.
SWEEPS = 4
BURN_IN = 1
#: Concentrations of the root and of the context restaurants.
STRENGTH = (1.0, 1.0)
#: Bytes of text per block, and blocks at least.
BLOCK_BYTES = 16 << 20
MIN_BLOCKS = 64
#: Bytes of text that are packed at a time.
BATCH_BYTES = 4 << 20
#: Blocks of text per place that sums the tables of contexts.
PLACE_BLOCKS = 4
#: Words of at least a (4 x blocks)-th of all tokens are spread over all blocks;
#: at most so many words can be.
SPREAD_WORDS = 1 << 16
#: Customers seated one by one; from then on a 16th of those seated at a time.
SINGLE = 64
END = np.uint64(0x7E5D0F1C3B2A4968)
START = np.uint64(0)  # the first by hash, as it is by place in a batch: entries are in order of their types
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
CACHE = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(text: str | None, known: dict) -> np.ndarray:
    """Hashes of the words (A-Z in lower case) and one end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _place(contexts: np.ndarray, places: int) -> np.ndarray:
    """Where the tables of each context are summed."""
    mixed = (contexts ^ (contexts >> np.uint64(31))) * _MIX
    return ((mixed >> np.uint64(33)) % np.uint64(places)).astype(np.int64)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an array by place of value (so that zeros run), compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) if a.size else b""


def _unpack(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _batches(batches):
    """Slices of bounded bytes and rows, each with a number that is the same in every run."""
    from pyspark import TaskContext

    n = TaskContext.get().partitionId() << 32
    for batch in slices(_merged(batches, "text"), "text", BATCH_BYTES):
        for at in range(0, batch.num_rows, 50_000):
            yield n, batch.slice(at, 50_000)
            n += 1


def _merged(batches, column: str):
    """Neighbouring record batches as one while ``column`` holds at most
    ``BATCH_BYTES``: Spark sends few rows at a time, a batch's words repeat."""
    held, size = [], 0
    for batch in batches:
        more = batch.column(batch.schema.get_field_index(column)).nbytes
        if held and size + more > BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def _common_words(docs: DataFrame, share: float) -> np.ndarray:
    """Hashes of the words with at least ``share`` of all tokens: batches report
    the words that reach half of it among their own."""
    def run(batches):
        known = _Words()
        for _, batch in _batches(batches):
            parts = [tokens(t, known) for t in batch.column(0).to_pylist()]
            words, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
            total = n.sum()
            top = n >= share / 2 * total
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words[top].view(np.int64), 0)), pa.array(np.append(n[top], total)),
                 pa.array(np.append(np.zeros(top.sum(), bool), True))], names=["w", "n", "all"])

    sums = stash(map_arrow(docs.select("text"), run, "w long, n long, all boolean").groupBy("w", "all").agg(F.sum("n").alias("n")), "common")
    total = sums.where("all").agg(F.sum("n")).first()[0] or 0
    rows = sums.where(~F.col("all") & (F.col("n") >= max(1.0, share * total))).orderBy(F.desc("n"), "w").limit(SPREAD_WORDS).collect()
    return np.sort(np.array([r["w"] for r in rows], np.int64).view(np.uint64))


def _deal(docs: DataFrame, blocks: int, common: np.ndarray) -> DataFrame:
    """Per batch and block: words, entries per word, and of each entry its
    context, document (place in the batch) and times; per batch a header."""
    def run(batches):
        known = _Words()
        for number, batch in _batches(batches):
            parts = [tokens(t, known) for t in batch.column(2).to_pylist()]
            sizes = [len(p) for p in parts]
            h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            doc = np.repeat(np.arange(len(parts), dtype=np.uint16), sizes)
            words, at = np.unique(h, return_inverse=True)
            u = np.zeros(len(h), np.uint64)  # the previous word, from 1; 0 at a text's start
            u[1:] = at[:-1] + 1
            u[np.cumsum([0, *sizes[:-1]])[:len(parts)]] = 0
            contexts = np.append(START, words)
            width, wide = np.uint64(max(1, len(parts))), np.uint64(len(contexts))
            entry, times = np.unique((at.astype(np.uint64) * wide + u) * width + doc, return_counts=True)
            e_doc, rest = (entry % width).astype(np.uint16), entry // width
            e_u, e_w = (rest % wide).astype(np.int64), (rest // wide).astype(np.int64)
            del entry, rest, u, doc, at, h, parts
            key = words * _MIX
            spread = np.isin(words, common)
            e_key = key[e_w] + np.where(spread[e_w], contexts[e_u] * _ODD, np.uint64(0))
            e_key = (e_key ^ (e_key >> np.uint64(31))) * _MIX
            block = ((e_key >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            rows = []
            for piece in np.split(order, cuts) if len(order) else []:
                w = e_w[piece]
                starts = np.flatnonzero(np.diff(w, prepend=-1))
                met, e_met = np.unique(e_u[piece], return_inverse=True)
                rows.append((int(block[piece[0]]), _pack(words[w[starts]]), _pack(np.diff(np.append(starts, len(w))).astype(np.uint32)),
                             _pack(contexts[met]), _pack(e_met.astype(np.uint32)), _pack(e_doc[piece]), _pack(times[piece].astype(np.uint32))))
            learn = np.packbits(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)).tobytes()
            n = len(rows)
            block_of = [r[0] for r in rows] + [int(number % blocks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_of, pa.int32()), pa.array([number] * (n + 1), pa.int64()),
                 *(pa.array([r[k] for r in rows] + [None], pa.binary()) for k in range(1, 7)),
                 pa.array([learn] * (n + 1), pa.binary()),
                 pa.array([None] * n + [batch.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([None] * n + [sizes], pa.list_(pa.int64())),
                 pa.array([None] * n + [batch.column(1).to_pylist()], pa.list_(pa.bool_()))],
                names=["block", "batch", "words", "per", "contexts", "u", "doc", "times", "learn", "keys", "sizes", "held"])

    return map_arrow(
        docs.select("key", "held", "text"), run, "block int, batch long, words binary, per binary, contexts binary, u binary, doc binary, times binary, learn binary, "
             "keys array<long>, sizes array<long>, held array<boolean>")


_TABLE = ("block int, m_words binary, m_contexts binary, m_types binary, m_u binary, m_c binary, o_batch array<long>, o_type array<binary>, "
          "o_doc array<binary>, o_times array<binary>, h_batch array<long>, h_keys array<array<long>>, "
          "h_sizes array<array<long>>, h_held array<array<boolean>>")


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of some arrays, and of each array the places there."""
    values = np.unique(np.concatenate([np.empty(0, np.uint64), *arrays]))
    return values, [np.searchsorted(values, a).astype(np.uint32) for a in arrays]


def _unpacked(column: pa.ChunkedArray, kind):
    for b in column:
        yield _unpack(b.as_py(), kind)


def _gather(rows: pa.Table, places: int) -> pa.Table:
    """One row per block: its words, its contexts in the order of their places,
    the types (word, context) with their training counts, per batch the entries
    by type, and headers.  The entries are unpacked a batch at a time."""
    block = rows["block"][0].as_py()
    head = rows.filter(pc.is_valid(rows["keys"])).select(["batch", "keys", "sizes", "held"])
    rows = rows.filter(pc.is_valid(rows["words"])).drop_columns(["keys", "sizes", "held"]).sort_by("batch")
    all_words, at = _joined(list(_unpacked(rows["words"], np.uint64)))
    contexts, met = _joined(list(_unpacked(rows["contexts"], np.uint64)))
    order = np.lexsort((contexts, _place(contexts, places)))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    wide = max(1, len(order))

    def keys():
        """Of each batch the types of its entries, in order."""
        for w, m, p, u in zip(at, met, _unpacked(rows["per"], np.uint32), _unpacked(rows["u"], np.uint32)):
            out = np.repeat(w.astype(np.int64) * wide, p)
            out += m[u]
            yield out

    some = [k[np.append(True, k[1:] != k[:-1])] for k in keys()]  # a batch's entries are in order of their types
    types = np.unique(np.concatenate(some) if some else np.empty(0, np.int64))
    del some
    counts, packed = np.zeros(len(types), np.int64), []
    for k, d, n, learn in zip(keys(), _unpacked(rows["doc"], np.uint16), _unpacked(rows["times"], np.uint32), rows["learn"]):
        new = np.append(True, k[1:] != k[:-1])
        starts = np.flatnonzero(new)
        mine = np.searchsorted(types, k[starts])
        learned = np.where(np.unpackbits(np.frombuffer(learn.as_py(), np.uint8))[d] == 1, n, 0)
        counts[mine] += np.add.reduceat(learned.astype(np.int64), starts)
        packed.append(_pack(np.diff(mine[np.cumsum(new) - 1], prepend=0).astype(np.uint32)))
    m_types = np.diff(np.searchsorted(types, np.arange(len(all_words) + 1) * wide)).astype(np.uint32)
    types %= wide
    binary = lambda *x: pa.array(x, pa.binary())
    binaries = lambda x: pa.array([x], pa.list_(pa.binary()))
    return pa.table({
        "block": pa.array([block], pa.int32()), "m_words": binary(all_words.tobytes()), "m_contexts": binary(contexts[order].tobytes()), "m_types": binary(m_types.tobytes()),
        "m_u": binary(_pack(rank[types])), "m_c": binary(_pack(counts.astype(np.uint32)) if counts.max(initial=0) < 1 << 32 else _pack(counts)),
        "o_batch": pa.array([rows["batch"].to_pylist()], pa.list_(pa.int64())), "o_type": binaries(packed),
        "o_doc": binaries(rows["doc"].to_pylist()), "o_times": binaries(rows["times"].to_pylist()),
        "h_batch": pa.array([head["batch"].to_pylist()], pa.list_(pa.int64())), "h_keys": pa.array([head["keys"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
        "h_sizes": pa.array([head["sizes"].to_pylist()], pa.list_(pa.list_(pa.int64()))), "h_held": pa.array([head["held"].to_pylist()], pa.list_(pa.list_(pa.bool_())))})


def seat(c: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
    """Tables of each dish after its ``c`` customers have come in one by one.

    A customer opens a table with weight (strength + d * tables of the
    restaurant) * parent probability, and joins one of the dish's with the
    number seated less d per table.  ``others``: tables of other dishes.
    """
    t = np.minimum(c, 1).astype(float)
    order = np.argsort(-c, kind="stable")
    sizes = -c[order]
    p, o = parent[order], others[order]
    tables = t[order]
    n = 1
    while True:
        k = int(np.searchsorted(sizes, -n))  # dishes with more than n customers
        if not k:
            break
        step = 1 if n < SINGLE else max(1, n // 16)
        fresh = (strength + d * (o[:k] + tables[:k])) * p[:k]
        chance = fresh / (n - d * tables[:k] + fresh)
        if step == 1:
            tables[:k] += rng.random(k) < chance
        else:
            tables[:k] += rng.binomial(np.minimum(step, -sizes[:k] - n), np.clip(chance, 0, 1))
        n += step
    t[order] = tables
    return t


class _Block:
    """The model of one block after a sweep; ``tables`` and ``seated`` are those
    of all blocks' restaurants for its contexts, once they are known."""

    def __init__(self, row: dict, common: np.ndarray):
        self.words = np.frombuffer(row["m_words"], np.uint64)
        self.contexts = np.frombuffer(row["m_contexts"], np.uint64)
        self.word = np.repeat(np.arange(len(self.words)), np.frombuffer(row["m_types"], np.uint32))
        self.u = _unpack(row["m_u"], np.uint32).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["m_c"]) if row["m_c"] else b""
        kind = np.uint32 if len(raw) == 4 * len(self.u) else np.int64
        self.c = _unpack(row["m_c"], kind).astype(np.int64)
        self.many = np.flatnonzero(self.c > 1)  # only these can have more than a table
        self.number = row["block"]
        place = np.searchsorted(common, self.words)
        self.spread = np.full(len(self.words), -1)
        if len(common):
            hit = common[np.minimum(place, len(common) - 1)] == self.words
            self.spread[hit] = place[hit]
        self.own = self.spread < 0
        self.count = np.bincount(self.word, weights=self.c, minlength=len(self.words))
        self.t = np.minimum(self.c, 1).astype(float)
        self.top = (self.count > 0).astype(float)  # tables of each word at the root
        self.tables = self.seated = None

    def resume(self, kept: list[dict], step: int) -> None:
        """The seating after a step, and the sums of that step."""
        parts = {k: sorted((r["place"], r["data"]) for r in kept if r["name"] == k and r["step"] == (0 if k == "seated" else step))
                 for k in ("t", "top", "tables", "seated")}
        t, top, self.tables, self.seated = (np.concatenate([np.empty(0, np.int64), *(_unpack(b, np.int64) for _, b in parts[k])]).astype(float)
                                            for k in ("t", "top", "tables", "seated"))
        self.t[self.many], self.top = t, top

    def guests(self) -> np.ndarray:
        """Customers of each word at the root."""
        return np.bincount(self.word, weights=self.t, minlength=len(self.words))

    def _root(self, state: dict) -> np.ndarray:
        """Probability of each word at the root."""
        guests, top = self.guests(), self.top.copy()
        held = ~self.own
        guests[held], top[held] = state["guests"][self.spread[held]], state["top"][self.spread[held]]
        return _root_probability(guests, top, state)

    def sweep(self, s: int, state: dict) -> None:
        rng = np.random.default_rng([s, self.number])
        base, many = self._root(state), self.many
        others = np.maximum(self.tables[self.u[many]] - self.t[many], 0)
        self.t[many] = seat(self.c[many], base[self.word[many]], others, state["d1"], STRENGTH[1], rng)
        guests = self.guests().astype(np.int64)
        own = np.flatnonzero(self.own & (guests > 1))
        others = np.maximum(state["all_top"] - self.top[own], 0)
        self.top[own] = seat(guests[own], np.full(len(own), state["base"]), others, state["d0"], STRENGTH[0], rng)

    def predict(self, state: dict) -> np.ndarray:
        base = self._root(state)[self.word]
        tables, seated = self.tables[self.u], self.seated[self.u]
        stay = np.where(self.c > 0, self.c - state["d1"] * self.t, 0.0)
        return (stay + (STRENGTH[1] + state["d1"] * tables) * base) / (STRENGTH[1] + seated)

    def sums(self) -> list[tuple[str, int, float]]:
        """What the root needs of this block, and all blocks of the common words."""
        guests, held = self.guests(), np.flatnonzero(~self.own)
        out = [("guests", int(self.spread[k]), float(guests[k])) for k in held]
        out += [("count", int(self.spread[k]), float(self.count[k])) for k in held]
        own, g = self.own & (self.count > 0), guests
        for name, x in (("words", own.sum()), ("all_guests", guests[self.own].sum()), ("all_top", self.top[self.own].sum()), ("tokens", self.c.sum()),
                        ("n1", (self.c == 1).sum()), ("n2", (self.c == 2).sum()), ("g1", (g[own] == 1).sum()), ("g2", (g[own] == 2).sum())):
            out.append((name, 0, float(x)))
        return out

    def parts(self, names, places: int) -> list[tuple[str, int, bytes]]:
        """The seating, and the tables and customers of its contexts by place."""
        out = [("t", 0, _pack(self.t[self.many].astype(np.int64))), ("top", 0, _pack(self.top.astype(np.int64)))]
        cuts = np.searchsorted(_place(self.contexts, places), np.arange(places + 1))
        for name in names:
            total = np.bincount(self.u, weights=self.t if name == "tables" else self.c, minlength=len(self.contexts)).astype(np.int64)
            out += [(name, k, _pack(total[cuts[k]:cuts[k + 1]])) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        return out


def _root_probability(guests, top, state: dict):
    stay = np.where(guests > 0, guests - state["d0"] * top, 0.0)
    return (stay + (STRENGTH[0] + state["d0"] * state["all_top"]) * state["base"]) / (STRENGTH[0] + state["all_guests"])


_MODEL = ["block", "m_words", "m_contexts", "m_types", "m_u", "m_c"]
_PARTS = "block int, step int, name string, place int, data binary"


def _rows(batches):
    """The rows of record batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _with_parts(table: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The blocks with ``kept``: their parts (the table is not shuffled)."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.groupBy("block").agg(F.collect_list(F.struct("step", "name", "place", "data")).alias("kept"))
    return table.join(rows, "block")


def _sweep(table: DataFrame, common: np.ndarray, places: int, states: list[dict], parts: list[DataFrame]) -> DataFrame:
    """``_PARTS`` and (name, k, x) sums of each block after one more sweep; of the
    first seating where no state is known."""
    step = len(states)
    last = states[-1] if states else None

    def run(batches):
        for row in _rows(batches):
            block = _Block(row, common)
            if step:
                block.resume(row["kept"], step - 1)
                block.sweep(step, last)
            sums, kept = block.sums(), block.parts(("tables",) if step else ("tables", "seated"), places)
            n, m = len(sums), len(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.number] * (n + m), pa.int32()), pa.array([step] * (n + m), pa.int32()), pa.array([x[0] for x in sums + kept]),
                 pa.array([None] * n + [x[1] for x in kept], pa.int32()), pa.array([None] * n + [x[2] for x in kept], pa.binary()),
                 pa.array([x[1] for x in sums] + [None] * m, pa.int64()), pa.array([x[2] for x in sums] + [None] * m, pa.float64())],
                names=["block", "step", "name", "place", "data", "k", "x"])

    rows = _with_parts(table.select(*_MODEL), parts) if parts else table.select(*_MODEL)
    return stash(rows.mapInArrow(trimmed(run), f"{_PARTS}, k long, x double"), "sweep")


def _sent(table: DataFrame, places: int) -> DataFrame:
    """Per place and block the contexts that the block sends there."""
    def send(batches):
        for row in _rows(batches):
            contexts = np.frombuffer(row["m_contexts"], np.uint64)
            cuts = np.searchsorted(_place(contexts, places), np.arange(places + 1))
            to = np.flatnonzero(np.diff(cuts)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([row["block"]] * len(to), pa.int32()),
                                              pa.array([contexts[cuts[k]:cuts[k + 1]].tobytes() for k in to], pa.binary())], names=["place", "block", "contexts"])

    return table.select("block", "m_contexts").mapInArrow(trimmed(send), "place int, block int, contexts binary")


_MEETINGS = "place int, size long, blocks array<int>, at array<binary>"


def _meet(rows: pa.Table) -> pa.Table:
    """A place: its ``size`` contexts, and of each block which of them it sends."""
    contexts, at = _joined([np.frombuffer(b.as_py(), np.uint64) for b in rows["contexts"]])
    return pa.table({"place": pa.array([rows["place"][0].as_py()], pa.int32()), "size": pa.array([len(contexts)], pa.int64()),
                     "blocks": pa.array([rows["block"].to_pylist()], pa.list_(pa.int32())), "at": pa.array([[_pack(a) for a in at]], pa.list_(pa.binary()))})


def _totals(sent: DataFrame, meetings: DataFrame) -> DataFrame:
    """``_PARTS``: what the blocks sent of their contexts, summed over all blocks,
    for each block in the order in which it sent them."""
    def run(batches):
        for row in _rows(batches):
            at = {b: _unpack(a, np.uint32) for b, a in zip(row["blocks"], row["at"])}
            by_name: dict[tuple, list] = {}
            for r in row["sent"]:
                by_name.setdefault((r["step"], r["name"]), []).append(r)
            for (step, name), some in by_name.items():
                total = np.zeros(row["size"], np.int64)
                for r in some:
                    total[at[r["block"]]] += _unpack(r["data"], np.int64)  # a block names a context once
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"] for r in some], pa.int32()), pa.array([step] * n, pa.int32()), pa.array([name] * n), pa.array([row["place"]] * n, pa.int32()),
                     pa.array([_pack(total[at[r["block"]]]) for r in some], pa.binary())], names=["block", "step", "name", "place", "data"])

    rows = sent.groupBy("place").agg(F.collect_list(F.struct("block", "step", "name", "data")).alias("sent"))
    return stash(meetings.join(rows, "place").mapInArrow(trimmed(run), _PARTS), "totals")


def _state(sums: DataFrame, common: np.ndarray, states: list[dict]) -> dict:
    """The sums of a sweep: two per common word, and a few totals - bounded
    whatever the corpus."""
    rows = sums.groupBy("name", "k").agg(F.sum("x").alias("x")).collect()
    state = {"guests": np.zeros(len(common)), "count": np.zeros(len(common))}
    total: dict[str, float] = {}
    for r in rows:
        if r["name"] in state:
            state[r["name"]][r["k"]] = r["x"]
        else:
            total[r["name"]] = r["x"]
    get = lambda k: total.get(k, 0.0)
    used = state["count"] > 0
    state["words"] = get("words") + used.sum()
    state["tokens"] = get("tokens")
    state["base"] = 1 / (state["words"] + 1)
    state["all_guests"] = get("all_guests") + state["guests"].sum()
    if not states:
        share = lambda a, b: float(np.clip(a / max(a + 2 * b, 1.0), 0.05, 0.95))
        state["d1"], state["d0"] = share(get("n1"), get("n2")), share(get("g1"), get("g2"))
        state["top"] = used.astype(float)
    else:
        last = states[-1]
        state["d1"], state["d0"], state["top"] = last["d1"], last["d0"], last["top"].copy()
        at = np.flatnonzero(state["guests"] > 1)
        state["top"][at] = seat(state["guests"][at].astype(np.int64), np.full(len(at), state["base"]), np.maximum(last["all_top"] - last["top"][at], 0),
                                state["d0"], STRENGTH[0], np.random.default_rng([len(states), 1 << 20]))
    state["all_top"] = get("all_top") + state["top"].sum()
    return state


def _score(table: DataFrame, common: np.ndarray, states: list[dict], parts: list[DataFrame]) -> DataFrame:
    """Sums per batch and block: known tokens, log10(count + 1), log10 probability."""
    def run(batches):
        for row in _rows(batches):
            block = _Block(row, common)
            chance = np.zeros(len(block.u))
            for step in range(BURN_IN + 1, len(states)):
                block.resume(row["kept"], step)
                chance += block.predict(states[step])
            count = block.count.copy()
            held = ~block.own
            count[held] = states[0]["count"][block.spread[held]]
            count = count[block.word]
            base, known = np.log10(count + 1), (count > 0).astype(float)
            chance = np.log10(chance / (len(states) - BURN_IN - 1))
            for number, of, doc, times in zip(row["o_batch"], row["o_type"], row["o_doc"], row["o_times"]):
                of, doc, times = np.cumsum(_unpack(of, np.uint32).astype(np.int64)), _unpack(doc, np.uint16), _unpack(times, np.uint32)
                docs, at = np.unique(doc, return_inverse=True)
                sums = [np.bincount(at, weights=times * x[of], minlength=len(docs)) for x in (known, base, chance)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([_pack(docs)], pa.binary()), pa.array([_pack(sums[0].astype(np.uint32))], pa.binary()),
                     pa.array([sums[1].tobytes()], pa.binary()), pa.array([sums[2].tobytes()], pa.binary())], names=["batch", "doc", "known", "base", "chance"])

    return _with_parts(table.select(*_MODEL, "o_batch", "o_type", "o_doc", "o_times"), parts).mapInArrow(
        trimmed(run), "batch long, doc binary, known binary, base binary, chance binary")


def score(df: DataFrame, key: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row.

    ``held_out``: boolean column, true for texts that the model does not learn
    from (null: learnt).  A null or empty text is its end alone; texts of equal
    content score alike; rows that share a key keep a row each; an empty table
    gives no rows; other columns are not read.  base_score: add-one unigram;
    score: the model's log10 probability.  Perplexity is 10 ** (-score / n_tokens).
    Words are told apart by 64-bit hashes.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = df.select(F.col(key).cast("long").alias("key"), held.alias("held"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(MIN_BLOCKS, math.ceil(size / BLOCK_BYTES))
    common = _common_words(docs, max(1 / (4 * blocks), 1 / SPREAD_WORDS))
    places = max(MIN_BLOCKS, blocks // PLACE_BLOCKS)
    spark = df.sparkSession
    names = [f"docweave_{n}_{uuid.uuid4().hex[:12]}" for n in ("model", "meetings")]
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(rows: DataFrame, gather, schema: str, name: str, key: str) -> DataFrame:
        def run(group: pa.Table) -> pa.Table:
            out = gather(group)
            trim()
            return out

        out = rows.repartition(dealt, key).groupBy(key).applyInArrow(run, schema)
        with shuffles_dropped(spark):
            return save_bucketed(out, name, scratch_dir(spark, name), dealt, key)

    table = bucketed(_deal(docs, blocks, common), lambda rows: _gather(rows, places), _TABLE, names[0], "block")
    meetings = bucketed(_sent(table, places), _meet, _MEETINGS, names[1], "place")
    states: list[dict] = []
    kept: list[DataFrame] = []  # seatings and sums that are still needed
    parts: list[DataFrame] = []  # those of the last step, and the customers of contexts
    for step in range(SWEEPS + 1):
        swept = _sweep(table, common, places, states, parts)
        states.append(_state(swept.where("k IS NOT NULL"), common, states))
        rows = swept.where("data IS NOT NULL").drop("k", "x")
        sums = _totals(rows.where("name IN ('tables', 'seated')"), meetings)
        seats, tables = rows.where("name IN ('t', 'top')"), sums.where("name = 'tables'")
        if not step:
            seated = sums.where("name = 'seated'")
            kept.append(seated)
        if step > BURN_IN:
            kept += [seats, tables]
        parts = [seated, seats, tables]
    tokens_all, words = states[0]["tokens"], states[0]["words"]
    none = F.lit(None)
    sums = _score(table, common, states, kept).select(
        "batch", "doc", "known", "base", "chance", none.cast("array<long>").alias("keys"), none.cast("array<long>").alias("sizes"), none.cast("array<boolean>").alias("held"))
    heads = table.select(F.explode(F.arrays_zip("h_batch", "h_keys", "h_sizes", "h_held")).alias("h")).select(
        F.col("h.h_batch").alias("batch"), *[none.cast("binary").alias(n) for n in ("doc", "known", "base", "chance")],
        F.col("h.h_keys").alias("keys"), F.col("h.h_sizes").alias("sizes"), F.col("h.h_held").alias("held"))
    log_all = math.log10(tokens_all + words + 1)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["keys"].notna()].iloc[0]
        n = len(head["sizes"])
        known, base, chance = np.zeros(n), np.zeros(n), np.zeros(n)
        for d, k, b, c in pdf.loc[pdf["doc"].notna(), ["doc", "known", "base", "chance"]].sort_values("base").itertuples(index=False):
            at = _unpack(d, np.uint16)
            known[at] += _unpack(k, np.uint32)
            base[at] += np.frombuffer(b)
            chance[at] += np.frombuffer(c)
        sizes = np.array(head["sizes"], np.int64)
        return pd.DataFrame({"key": pd.array(list(head["keys"]), "Int64"), "held_out": list(head["held"]), "n_tokens": sizes,
                             "n_known": known.round().astype(np.int64), "train_tokens": int(tokens_all),
                             "base_score": base - sizes * log_all, "score": chance})

    out = sums.unionByName(heads).groupBy("batch").applyInPandas(
        total, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)
    for name in names:  # the files stay for the rows above
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, held_out=remainder(F.col("doc_id"), 7) == 2)
