"""MinHash near-duplicates: many universal hash minima, banding, signature
verification, confirmation on full shingle sets, connected components.

Documents with equal shingle sets collapse into one class.  In a bucket (equal
band) every class is first compared with the smallest one; then, wherever a
bucket still holds several components, its members of different components are
compared, block against block, each block pair returning a spanning forest.  So
no pair is ever a row, and every pair that shares a bucket is either compared or
already connected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import map_arrow, read, slices, stash
from docweave.llm.components import connected_components
from docweave.llm.vectors import forest

BANDS = 32
ROWS = 5
HASHES = BANDS * ROWS
#: A pair of similarity s has that signature bit different with probability
#: (1 - s) / 2: at 0.8 a mean of 16 of 160, deviation 3.8; 5.8 deviations are let through.
SLACK = 5.8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
CACHE = 500_000
#: Members of one block of a bucket, and columns of one product.
BLOCK = 256
COLUMNS = 4_096
#: Rows of the block pairs that are filtered in one call, about.
CALL_ROWS = 50_000
#: Rows whose texts meet in one call, about (a block pair has 2 * BLOCK at most).
TEXT_ROWS = 500


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    """h(x) = ((a x + b) mod 2**64) >> 32 with odd a: strongly universal on 32-bit x."""
    rng = np.random.default_rng(20_240)
    return (rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2))


class _Words(dict):
    """64-bit hashes of words; forgets everything when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case (bytes methods know ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``width``: one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    span = min(width, n)
    x = h[:n - span + 1].copy()
    for j in range(1, span):
        x = (x ^ (x >> np.uint64(29))) * _MIX + h[j:n - span + 1 + j] * _ODD
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(span * (span < width))) * _ODD
    return np.unique(x ^ (x >> np.uint64(32)))


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.uint64(0xFFFFFFFF))
    short = x & np.uint64(0xFFFFFFFF)
    for at in range(0, len(x), 512):
        low = np.minimum(low, ((a[:, None] * short[None, at:at + 512] + b[:, None]) >> np.uint64(32)).min(1))
    return low


def sign(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, d1, d2, s1, s2, s3, keys): set size, 128-bit digest of the set,
    one bit of each minimum, and a key per band (none for an empty set)."""
    def run(batches):
        known, (a, b) = _Words(), _parameters()
        fold = np.cumprod(np.full(ROWS, _ODD))
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column(1).to_pylist()
            n, digests, low = [], [], np.zeros((len(texts), HASHES), np.uint64)
            for i, t in enumerate(texts):
                x = shingle_hashes(words_of(t), width, known)
                n.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                if len(x):
                    low[i] = minima(x, a, b)
            size = np.array(n, np.int64)
            keys = ((low.reshape(-1, BANDS, ROWS) + np.uint64(1)) * fold).sum(2, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(33))) * _MIX + np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD
            full = size > 0
            bits = np.packbits((low & np.uint64(1)).astype(np.uint8), axis=1)
            s = np.concatenate([bits, np.zeros((len(texts), 24 - bits.shape[1]), np.uint8)], axis=1).copy().view(np.int64)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(s[:, 0]),
                 pa.array(s[:, 1]), pa.array(s[:, 2]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1).view(np.int64)))],
                names=["id", "n", "d1", "d2", "s1", "s2", "s3", "keys"])

    return map_arrow(df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run,
                     "id long, n long, d1 long, d2 long, s1 long, s2 long, s3 long, keys array<long>")


def _most_apart(percent: int) -> int:
    """Signature bits that two similar sets differ in, at most."""
    share = (1 - percent / 100) / 2
    return int(HASHES * share + SLACK * (HASHES * share * (1 - share)) ** 0.5) + 1


def _plausible(a: str, b: str, percent: int) -> Column:
    """Length and signature filters of a pair with columns a_n, a_s1.. and b_n, b_s1.."""
    apart = sum((F.bit_count(F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}"))) for i in (1, 2, 3)), F.lit(0))
    return ((F.lit(100) * F.least(f"{a}_n", f"{b}_n") >= F.lit(percent) * F.greatest(f"{a}_n", f"{b}_n"))
            & (apart <= F.lit(_most_apart(percent))))


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("rep", "n", "s1", "s2", "s3")])


def _texts(ids: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t) of the wanted ids."""
    return stash(df.select(F.col(key).cast("long").alias("__k"), F.col(text).alias("t")).where("t IS NOT NULL")
                 .join(stash(ids.distinct(), "ids"), F.col("__k") == F.col("id")).select("id", "t"), "texts")


def _confirm(pairs: DataFrame, df: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    texts = _texts(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), df, key, text)
    both = (pairs.join(texts.withColumnRenamed("t", "tb"), F.col("b") == F.col("id")).drop("id")
            .join(texts.withColumnRenamed("t", "ta"), F.col("a") == F.col("id")).select("a", "b", "ta", "tb"))

    def run(batches):
        last, first = None, set()
        for batch in slices(batches, "tb", 4 << 20):
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ta != last:
                    last, first = ta, _shingles(ta, width)
                other = _shingles(tb, width)
                inner = len(first & other)
                keep.append(inner > 0 and 100 * inner >= percent * (len(first) + len(other) - inner))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stash(map_arrow(both, run, "a long, b long"), "links")


def _shingles(text: str, width: int) -> set:
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < width else set(zip(*[w[i:] for i in range(width)]))


def _overlaps(left: list[set], right: list[set]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set: products
    of 0/1 matrices over the shingles that both sides have."""
    common = {s: k for k, s in enumerate(set().union(*left) & set().union(*right))}
    out = np.zeros((len(left), len(right)))

    def places(sets: list[set]) -> tuple[np.ndarray, np.ndarray]:
        found = [[common[x] for x in s if x in common] for s in sets]
        return (np.repeat(np.arange(len(sets)), [len(f) for f in found]),
                np.fromiter((k for f in found for k in f), np.int64))

    (l_row, l_col), (r_row, r_col) = places(left), places(right)
    for at in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - at)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, row, col in ((a, l_row, l_col), (b, r_row, r_col)):
            own = (col >= at) & (col < at + width)
            m[row[own], col[own] - at] = 1
        out += a @ b.T
    return out


def _plausible_matrix(l: dict, r: dict, percent: int) -> np.ndarray:
    """``_plausible`` of every left with every right row, and of different parts."""
    n, m = l["n"], r["n"]
    x, y = ([d[c].view(np.uint64) for c in ("s1", "s2", "s3")] for d in (l, r))
    apart = sum(np.bitwise_count(a[:, None] ^ b[None, :]).astype(np.int16) for a, b in zip(x, y))
    return ((100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m)) & (apart <= _most_apart(percent))
            & (l["part"][:, None] != r["part"]))


def _across(marked: DataFrame, short: DataFrame, df: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Links between members (band, rep, part) of one band that are in different
    parts.  The commonest part of a band is its host; the other members are
    compared with it and with one another, in blocks: first by size and
    signature alone, and only members with a plausible partner bring their texts
    to a second round."""
    parts = marked.groupBy("band", "part").agg(F.count(F.lit(1)).alias("c"))
    bands = stash(parts.groupBy("band").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("p"))
                  .where("p > 1").select("band", F.col("top.part").alias("host"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("n_host"),
                                         F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("n_stray")), "mixed")
    rows = marked.join(bands, "band").join(short, "rep").withColumn("stray", F.col("part") != F.col("host"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("stray"), F.col("n_stray")).otherwise(F.col("n_host"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    side = lambda d, left, host, a, b: d.select("band", "rep", "part", "n", "s1", "s2", "s3", F.lit(left).alias("left"), F.lit(host).alias("host"), a.alias("a"), b.alias("b"))
    strays, hosts = rows.where("stray"), rows.where("NOT stray")
    among = strays.withColumn("other", F.explode(upto("n_stray")))
    dealt = (side(strays.withColumn("other", F.explode(upto("n_host"))), True, True, F.col("block"), F.col("other"))
             .unionByName(side(hosts.withColumn("other", F.explode(upto("n_stray"))), False, True, F.col("other"), F.col("block")))
             .unionByName(side(among, True, False, F.col("block"), F.col("other")).where("a <= b"))
             .unionByName(side(among, False, False, F.col("other"), F.col("block")).where("a <= b")))
    group = ["band", "host", "a", "b"]

    def plausible(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(pdf), bool)
        left, columns = pdf["left"].to_numpy(bool), {c: pdf[c].to_numpy(np.int64) for c in ("n", "part", "s1", "s2", "s3")}
        for own in pdf.groupby(group, sort=False).indices.values():
            l, r = own[left[own]], own[~left[own]]
            may = _plausible_matrix(*({c: v[side] for c, v in columns.items()} for side in (l, r)), percent)
            keep[l], keep[r] = may.any(1), may.any(0)
        return pdf.loc[keep, [*group, "rep", "part", "left"]]

    dealt = stash(dealt, "blocks")
    # most block pairs are small: many of them are one call's work
    calls = max(1, -(-dealt.count() // CALL_ROWS))
    call = F.pmod(F.xxhash64(*group), F.lit(calls)).alias("call")
    dealt = stash(dealt.groupBy(call).applyInPandas(plausible, "band long, host boolean, a int, b int, rep long, part long, left boolean"), "dealt")
    texts = _texts(dealt.select(F.col("rep").alias("id")), df, key, text)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, part, left = pdf["rep"].to_numpy(np.int64), pdf["part"].to_numpy(np.int64), pdf["left"].to_numpy(bool)
        known: dict[int, set] = {}  # a member stands in several bands
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for own in pdf.groupby(group, sort=False).indices.values():
            l, r = own[left[own]], own[~left[own]]
            if not len(l) or not len(r):
                continue
            for i in own:
                if ids[i] not in known:
                    known[ids[i]] = _shingles(pdf["t"].iat[i], width)
            sets = {i: known[ids[i]] for i in own}
            inner = _overlaps([sets[i] for i in l], [sets[i] for i in r])
            n, m = (np.array([len(sets[i]) for i in at]) for at in (l, r))
            links = (100 * inner >= percent * (n[:, None] + m - inner)) & (part[l][:, None] != part[r])
            at, root = np.concatenate([l, r]), forest(links, ids[l], ids[r])
            moved = root != ids[at]
            out.append((ids[at][moved], root[moved]))
        a, b = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b}).astype("int64")

    calls = max(1, -(-dealt.count() // TEXT_ROWS))
    return stash(dealt.join(texts, F.col("rep") == F.col("id")).select(*group, "rep", "part", "left", "t")
                 .groupBy(F.pmod(F.xxhash64(*group), F.lit(calls)).alias("call")).applyInPandas(run, "a long, b long"), "links")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """``df`` with n_shingles, component_id and kept (the smallest id of its component).

    Links: 100 * intersection >= ``percent`` * union of the shingle sets.  Null
    or empty texts have no shingle, no link, and are their own component; rows
    without a key have a null component and stay.  Rows that share a key are one
    node; any of their texts may link it.  Input columns named like an output
    give way.  A pair at the very threshold is missed with probability 3e-6
    (no common band) plus 1e-8 (signature); what is linked is exact.
    """
    signed = stash(sign(df, key, text, width), "signed")
    best = F.min(F.struct("id", "n", "s1", "s2", "s3", "keys")).alias("r")
    classes = stash(signed.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(best)
                    .select("d1", "d2", F.col("r.id").alias("rep"), "r.n", "r.s1", "r.s2", "r.s3", "r.keys"), "classes")
    short = classes.select("rep", "n", "s1", "s2", "s3")
    dealt = classes.select("rep", F.explode("keys").alias("band"))
    buckets = stash(dealt.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"))
                    .where("last > centre").drop("last"), "buckets")
    members = stash(dealt.join(buckets, "band"), "members")
    # round 1: with the smallest member of each bucket
    pairs = (members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
             .join(_prefixed(short, "y"), F.col("b") == F.col("y_rep")).join(_prefixed(short, "x"), F.col("a") == F.col("x_rep")))
    links = _confirm(stash(pairs.where(_plausible("x", "y", percent)).select("a", "b").distinct(), "pairs"), df, key, text, width, percent)
    parts = connected_components(links)
    # round 2: what still is in different components of one bucket
    marked = stash(members.join(parts, F.col("rep") == F.col("node"), "left")
                   .select("band", "rep", F.coalesce("component", "rep").alias("part")), "marked")
    links = links.unionByName(_across(marked, short, df, key, text, width, percent))
    # the nodes of one class, too: equal sets of different keys
    parts = connected_components(links.unionByName(_twins(signed, classes)))
    nodes = signed.groupBy("id").agg(F.max("n").alias("n"))
    result = stash(nodes.join(parts, F.col("id") == F.col("node"), "left")
                   .select(F.col("id").alias("__id"), F.col("n").alias("__n"), F.coalesce("component", "id").alias("__c")), "result")
    rest = [c for c in df.columns if c not in ("n_shingles", "component_id", "kept")]
    return (df.join(result, F.col(key).cast("long").eqNullSafe(F.col("__id")))
            .select(*rest, F.col("__n").alias("n_shingles"), F.col("__c").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))


def _twins(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges from every document of a class to its smallest one."""
    return (signed.where("n > 0").select("id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
            .where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")
