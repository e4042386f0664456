"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

A document's score is linear in features of its text.  Each pair of a good and
a bad document adds the logistic loss of the difference of their features; a
quantile of the scores, at the share of bad documents, is the threshold.

All pairs of all labelled rows count, and none is formed: what a row adds to the
gradient depends on its own features and on the other label's scores alone, as a
smooth function of the row's score.  Each Newton step takes two passes over the
rows: one counts the scores of each label on a fine grid (a score is shared by
its two neighbours there, an error of less than one in a million), one sums the
gradient and the curvature.  The curvature takes scores to the nearest half,
which says how far a step goes, not where the steps end.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import map_arrow, read, remainder, replace_column, slices, stash

RIDGE = 1e-3
#: Steps of the score grid per unit, and at most in all.
FINE, GRID = 256, 1 << 17
#: Scores that are looked at one by one for the threshold, at most.
CLOSE = 100_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"!?"
_STOPS = b".,;:'\"-()"
_ODD = b"#$%&*@^~|<>{}[]\\/=+_`"
_RUN = re.compile(rb"([!#$%&*@^~|<>?.,=+_-])\1\1")
_WIDE = 1_000


def _shares(b: bytes, words: list[bytes]) -> list[float]:
    """Shares within a text or a line: capitals, digits, marks, odd signs, runs
    of one sign, words said again at once, distinct words, words with odd signs."""
    n, w = max(1, len(b)), max(1, len(words))
    odd = len(b) - len(b.translate(None, _ODD))
    upper = len(b) - len(b.translate(None, _UPPER))
    lower = len(b) - len(b.translate(None, _LOWER))
    digit = len(b) - len(b.translate(None, _DIGIT))
    marks = len(b) - len(b.translate(None, _MARKS))
    again = sum(x == y for x, y in zip(words, words[1:]))
    return [upper / max(1, upper + lower), digit / n, marks / n, odd / n, len(_RUN.findall(b)) / w,
            again / w, len(set(words)) / w ** 0.9]


def features(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    w, n = max(1, len(words)), max(1, len(b))
    whole = _shares(b, words)
    top = Counter(words).most_common(1)[0][1] / w if words else 0.0
    lines = [x for x in b.split(b"\n") if x.strip()]
    # the part of the words that stand in lines of each odd kind: junk may be one passage of a clean text
    in_kind, worst = [0.0] * 5, [0.0] * 5
    for line in lines:
        own = line.split()
        for at in range(0, len(own), _WIDE):
            piece = own[at:at + _WIDE]
            s = _shares(b" ".join(piece), piece)
            tops = Counter(piece).most_common(1)[0][1] / len(piece)
            kinds = (s[0] > 0.4 and len(piece) > 3, s[3] > 0.04, s[4] > 0.2, s[5] > 0.2, tops > 0.35 and len(piece) > 5)
            for k, yes in enumerate(kinds):
                in_kind[k] += len(piece) * yes
            if len(piece) > 3:
                for k, x in enumerate((s[0], s[2], s[3], s[4], s[5])):
                    worst[k] = max(worst[k], x)
    stops = len(b) - len(b.translate(None, _STOPS))
    blank = len(b) - len(b.translate(None, b" \t\n\r"))
    ascii_n = sum(len(b) - len(b.translate(None, x)) for x in (_UPPER, _LOWER, _DIGIT))
    return [math.log1p(len(words)), *whole, *(math.sqrt(x) for x in whole[:6]), top, n / w, stops / n, blank / n, ascii_n / n,
            *(x / w for x in in_kind), *(math.sqrt(x / w) for x in in_kind), *(float(x > 0) for x in in_kind), *worst,
            1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)),
            sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)), float(not words)]


def _add(parts: list[dict]) -> dict:
    """Sums of equal (name, place); a name that begins with ``max`` takes the largest."""
    out = {}
    for name in sorted({n for p in parts for n in p}):
        k = np.concatenate([p[name][0] for p in parts if name in p])
        v = np.concatenate([p[name][1] for p in parts if name in p])
        places, at = np.unique(k, return_inverse=True)
        total = np.full(len(places), -np.inf)
        if name.startswith("max"):
            np.maximum.at(total, at, v)
        else:
            total = np.bincount(at, weights=v, minlength=len(places))
        out[name] = places, total
    return out


def _flat(x) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, float).reshape(-1)
    return np.arange(len(x)), x


def _dense(sums: dict, name: str, shape) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)))
    if name in sums:
        out[sums[name][0]] = sums[name][1]
    return out.reshape(shape)


def _convolve(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums over j of counts[j] * kernel of (i - j), kernel from 1 - n to n - 1."""
    n, size = len(counts), 1 << (3 * len(counts)).bit_length()
    both = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)
    return np.maximum(both[n - 1:2 * n - 1], 0)


def _sigmoid(s):
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def _solve(total, n: int) -> dict:
    """The model without its threshold.  ``total(f)``: the sums of f(x, y) over
    all pieces of the rows, {name: (places, values)}; ``n`` features."""
    first = total(lambda x, y: {"sum": _flat(x.sum(0)), "n": _flat([(y == 0).sum(), (y == 1).sum()]),
                                "max": _flat(x.max(0)), "max_of_minus": _flat((-x).max(0))} if len(x) else {})
    bad, good = _dense(first, "n", 2)
    if not bad or not good:
        return {"w": np.zeros(n), "mean": np.zeros(n), "scale": np.ones(n), "threshold": 0.0, "bad": bad, "good": good}
    mean = _dense(first, "sum", n) / (bad + good)
    wide = _dense(first, "max", n) + _dense(first, "max_of_minus", n)
    scale = np.sqrt(_dense(total(lambda x, y: {"square": _flat(((x - mean) ** 2).sum(0))}), "square", n) / (bad + good))
    scale[(scale < 1e-9) | (wide <= 0)] = 1.0
    w = np.zeros(n)
    for _ in range(50):  # Newton steps on the mean logistic loss of all pairs
        step = max(1 / FINE, float(np.abs(w) @ (wide / scale)) / GRID)

        def count(x, y):
            z = (x - mean) / scale
            s = z @ w
            low, half = np.floor(s / step).astype(np.int64), np.rint(2 * s).astype(np.int64)
            up = s / step - low
            out = {}
            for label in (0, 1):
                mine = y == label
                out[f"fine{label}"] = np.concatenate([low[mine], low[mine] + 1]), np.concatenate([1 - up[mine], up[mine]])
                out[f"half{label}"] = half[mine], np.ones(mine.sum())
                places, at = np.unique(half[mine], return_inverse=True)
                sums = np.zeros((len(places), n))
                np.add.at(sums, at, z[mine])
                out[f"z{label}"] = (places[:, None] * n + np.arange(n)).reshape(-1), sums.reshape(-1)
            return out

        seen = total(count)

        def grid(name):
            pair = [seen[f"{name}{label}"] for label in (0, 1)]
            low = int(min(k[0] for k, _ in pair))
            size = int(max(k[-1] for k, _ in pair)) - low + 1
            return low, size, [np.bincount(k - low, weights=v, minlength=size) for k, v in pair]

        low, size, counts = grid("fine")
        gaps = np.arange(1 - size, size) * step
        lost = [_convolve(counts[1], _sigmoid(gaps)), _convolve(counts[0], _sigmoid(-gaps))]  # of a bad, of a good row
        low_h, size_h, halves = grid("half")
        near = np.arange(size_h)
        bend = _sigmoid((near[:, None] - near) / 2)
        bend = bend * (1 - bend)
        curve = [bend @ halves[1], bend @ halves[0]]

        def slope(x, y):
            z = (x - mean) / scale
            s = z @ w
            at, half = s / step - low, np.rint(2 * s).astype(np.int64) - low_h
            pull = np.where(y == 1, -1.0, 1.0) * np.where(y == 1, np.interp(at, np.arange(size), lost[1]), np.interp(at, np.arange(size), lost[0]))
            v = np.where(y == 1, curve[1][half], curve[0][half])
            return {"grad": _flat(pull @ z), "hess": _flat((z * v[:, None]).T @ z)}

        sums = total(slope)
        sum_z = []
        for label in (0, 1):
            k, v = seen[f"z{label}"]
            sum_z.append(np.bincount(k - low_h * n, weights=v, minlength=size_h * n).reshape(size_h, n))
        cross = sum_z[1].T @ bend @ sum_z[0]
        pairs = bad * good
        grad = _dense(sums, "grad", n) / pairs + RIDGE * w
        hess = (_dense(sums, "hess", (n, n)) - cross - cross.T) / pairs + RIDGE * np.eye(n)
        change = np.linalg.solve(hess, grad)
        w -= change
        if np.abs(change).max() < 1e-7:
            break
    return {"w": w, "mean": mean, "scale": scale, "threshold": 0.0, "bad": bad, "good": good}


def _cut(s: np.ndarray, y: np.ndarray, share: float, model: dict, before: float = 0.0, after: float | None = None) -> float:
    """Between the score at which the rows reach ``share`` and the next; each
    label weighs what it does among all labelled rows.  ``s``, ``y``: the rows
    around it; ``before``: what rows below them weigh, ``after``: the score that follows."""
    weight = np.where(y == 1, (1 - share) / model["good"], share / model["bad"])
    order = np.argsort(s, kind="stable")
    s = s[order] if after is None else np.append(s[order], after)
    i = max(0, min(int(np.searchsorted(before + np.cumsum(weight[order]), share - 1e-9)), len(s) - 2))
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def fit(x: np.ndarray, y: np.ndarray, bad_share: float) -> dict:
    """Weights, centre, scale and threshold from features and 0/1 labels in memory.

    Without rows of both labels the weights are 0 and every score is 0.5.
    """
    n = x.shape[1] if x.ndim == 2 else len(features(""))
    model = _solve(lambda f: _add([f(x.reshape(-1, n), y)]), n)
    if model["bad"] and model["good"]:
        model["threshold"] = _cut(((x - model["mean"]) / model["scale"]) @ model["w"], y, bad_share, model)
    return model


def score(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, 0 to 1: 0.5 at the threshold, higher for better texts.

    Null and empty texts have the features of an empty text; rows are
    independent; a column named ``out`` gives way.
    """
    mean, scale, w, threshold = model["mean"], model["scale"], model["w"], model["threshold"]

    def run(batches):
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(w))
            s = np.clip(((x - mean) / scale) @ w - threshold, -35, 35)
            yield replace_column(batch, out, pa.array(1 / (1 + np.exp(-s)), pa.float64()))

    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])
    return map_arrow(df, run, schema)


def _pieces(batches):
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y


def _total(rows: DataFrame, f) -> dict:
    """Sums of f over the stashed features; bounded whatever their number."""
    def run(batches):
        sums, parts = {}, []
        for x, y in _pieces(batches):
            parts.append(f(x, y))
            if len(parts) == 16:
                sums, parts = _add([sums, *parts]), []
        for name, (k, v) in _add([sums, *parts]).items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(v, pa.float64())], names=["name", "k", "v"])

    found = (map_arrow(rows, run, "name string, k long, v double").groupBy("name", "k")
             .agg(F.when(F.col("name").startswith("max"), F.max("v")).otherwise(F.sum("v")).alias("v"))
             .toPandas())
    return {name: (g["k"].to_numpy(), g["v"].to_numpy()) for name, g in found.sort_values(["name", "k"]).groupby("name")}


def _threshold(rows: DataFrame, model: dict, share: float) -> float:
    """``_cut`` of all rows: counts by ever finer classes of the score, until few
    rows are left around it (or all of one score)."""
    w, mean, scale = model["w"], model["mean"], model["scale"]

    def run(batches):
        for x, y in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(((x - mean) / scale) @ w), pa.array(y, pa.int32())], names=["s", "y"])

    scores = stash(map_arrow(rows, run, "s double, y int"), "scores")
    weigh = lambda bad, good: bad * share / model["bad"] + good * (1 - share) / model["good"]
    ends = scores.agg(F.min("s").alias("low"), F.max("s").alias("high")).first()
    low, high, before, after = ends["low"], ends["high"], 0.0, None
    near = scores
    while True:
        n = near.count()
        if n <= CLOSE or low == high:
            break
        place = F.least(F.floor((F.col("s") - low) / (high - low) * 1000), F.lit(999))
        found = near.groupBy(place.alias("c")).agg(
            F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good"),
            F.min("s").alias("low"), F.max("s").alias("high")).orderBy("c").collect()
        at = 0
        while at < len(found) - 1 and before + weigh(found[at]["bad"], found[at]["good"]) < share - 1e-9:
            before += weigh(found[at]["bad"], found[at]["good"])
            at += 1
        if at + 1 < len(found):
            after = found[at + 1]["low"]
        low, high = found[at]["low"], found[at]["high"]
        near = scores.where(F.col("s").between(low, high))
    if n > CLOSE:  # all of one score: the cut is at it, or between it and the next
        counts = {r["y"]: r["n"] for r in near.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        whole = before + weigh(counts.get(0, 0), counts.get(1, 0))
        last = min(weigh(1, 0), weigh(0, 1))
        return float(low if after is None or whole - last >= share - 1e-9 else (low + after) / 2)
    got = near.orderBy("s", "y").toPandas()
    return _cut(got["s"].to_numpy(), got["y"].to_numpy(), share, model, before, after)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on all labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Labels that are null or not 0/1 are left out; of several labels of one
    doc_id the smallest counts.  The features of labelled rows are a table in the
    shared folder; the driver gets sums of bounded number.
    """
    marked = (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
              .where(remainder(F.col("doc_id"), 3) != 1)
              .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("__y")))
    counts = {r["__y"]: r["n"] for r in marked.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches):
        for batch in slices(batches, "text"):
            rows = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "id"])

    # features first: they, not the texts, meet the labels
    known = docs.where(F.coalesce(remainder(F.col("doc_id"), 3) != 1, F.lit(False)))
    found = map_arrow(known.select("text", F.col("doc_id").cast("long")), run, "x array<double>, id long")
    rows = stash(found.join(marked, found["id"] == F.col("__id")).select("x", F.col("__y").alias("y")), "features")
    model = _solve(lambda f: _total(rows, f), len(features("")))
    if model["bad"] and model["good"]:
        model["threshold"] = _threshold(rows, model, counts.get(0, 0) / max(1, sum(counts.values())))
    return model


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
