"""Secret scan: fixed patterns, and character Markov models compared by
log-likelihood ratio (random strings against ordinary identifiers).

DataFrame functions only.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import read, stash

# The base patterns (Java syntax; ASCII case folding only).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{32,}"  # maximal runs of 32 or more
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge, and ordinary identifiers that train them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-][A-Za-z0-9_-]{11,}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: A word is frequent in this share of the texts, and in LEAST of them at least.
FREQUENT = 1e-4
LEAST = 2
#: Added to every count of character pairs.
SMOOTHING = 0.5
#: Log odds (natural) that a string needs to be called a secret.
THRESHOLD = 10.0


def _positions(df: DataFrame, text: str, pattern: str, kind: int, out: str, group: int | None = None,
               least: int = 0) -> DataFrame:
    """Add ``out``: array of (start, kind, end) of the matches of ``pattern``."""
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    df = df.withColumn(f"{out}_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    hit = F.size(f"{out}_m") > 0
    df = df.withColumn(f"{out}_p", F.when(hit, F.transform(F.split(F.col(text), pattern, -1), F.char_length)))
    if group is not None:
        df = df.withColumn(f"{out}_g", F.when(hit, F.transform(
            F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), F.char_length)))

    def step(acc, i):
        start = acc["at"] + F.get(F.col(f"{out}_p"), i)
        end = start + F.char_length(F.get(F.col(f"{out}_m"), i))
        grown = F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"),
                                                      end.alias("end"))))
        if group is not None:
            grown = F.when(F.get(F.col(f"{out}_g"), i) >= least, grown).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size(f"{out}_m") - 1),
                        F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return df.withColumn(out, F.when(hit, spans).otherwise(empty)).drop(f"{out}_p", f"{out}_g")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add arrays ``__assign``, ``__access``, ``__hex`` of (start, kind, end)."""
    df = _positions(df, text, ASSIGN, 0, "__assign", 2, 8)
    df = _positions(df, text, ACCESS, 1, "__access")
    return _positions(df, text, HEX, 2, "__hex")


def _pairs(strings: DataFrame) -> dict[tuple[int, int], float]:
    """Counts of adjacent character pairs of a column ``s``: at most the square
    of the alphabet, so they may come to the driver."""
    chars = F.split("s", "")
    pair = F.explode(F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars)),
                                lambda a, b: F.ascii(a) * 128 + F.ascii(b)))
    rows = (strings.where(F.char_length("s") >= 2).select(pair.alias("p"))
            .groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())
    known = {ord(c) for c in ALPHABET}
    return {divmod(r["p"], 128): float(r["n"]) for r in rows
            if r["p"] is not None and r["p"] // 128 in known and r["p"] % 128 in known}


def _ordinary(strings: DataFrame) -> DataFrame:
    """Distinct identifiers (column ``s``) outside every pattern whose words, cut
    at _ and -, are all frequent by document count.  A random string is in one
    text and its copies, so however many there are, they stay out: at most
    1 / FREQUENT times the words of a text can be frequent at any size."""
    free = F.regexp_replace("t", ASSIGN, "=")  # "=": what stands beside a match is no identifier either
    names = F.array_distinct(F.filter(F.regexp_extract_all(free, F.lit(IDENTIFIER), F.lit(0)),
                                      lambda s: ~s.rlike(f"(?:{HEX})|(?:{ACCESS})")))
    words = lambda s: F.array_distinct(F.filter(F.split(s, "[_-]+"), lambda w: w != ""))
    tagged = lambda values, kind: F.transform(values, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))
    seen = strings.select(names.alias("names")).select(F.explode(F.concat(
        tagged(F.col("names"), 0), tagged(F.array_distinct(F.flatten(F.transform("names", words))), 1),
        tagged(F.array(F.lit("")), 2))).alias("x"))
    counts = stash(seen.groupBy("x.kind", "x.s").agg(F.count(F.lit(1)).alias("n")), "identifiers")
    texts = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    frequent = counts.where((F.col("kind") == 1) & (F.col("n") >= max(LEAST, math.ceil(FREQUENT * texts)))).select(F.col("s").alias("w"))
    parts = counts.where("kind = 0").select("s", words(F.col("s")).alias("ws")).where(F.size("ws") > 0)
    found = parts.select("s", F.size("ws").alias("k"), F.explode("ws").alias("w")).join(frequent, "w")
    return found.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n")).where("n = k").select("s")


def train(df: DataFrame, text: str = "text") -> dict[tuple[int, int], float]:
    """Log ratios by character pair.  Labelled samples: values that the base
    patterns mark are random strings; words of 12 characters or more outside
    every pattern, made of words that are frequent by document count, are
    ordinary identifiers.  Every distinct sample counts once, over all rows.
    Without samples a model is uniform."""
    strings = df.select(F.col(text).alias("t")).where("t IS NOT NULL")
    random = strings.where(F.col("t").rlike(ASSIGN) | F.col("t").rlike(ACCESS) | F.col("t").rlike(HEX)).select(
        F.explode(F.concat(
            F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda s: F.char_length(s) >= 8),
            F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)),
            F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))).alias("s")).distinct()
    ordinary = _ordinary(strings)
    models = []
    for sample in (random, ordinary):
        counts, size = _pairs(sample), len(ALPHABET)
        totals: dict[int, float] = {}
        for (a, _), n in counts.items():
            totals[a] = totals.get(a, 0.0) + n
        models.append({(a, b): math.log((counts.get((a, b), 0.0) + SMOOTHING) / (totals.get(a, 0.0) + SMOOTHING * size))
                       for a in map(ord, ALPHABET) for b in map(ord, ALPHABET)})
    return {pair: models[0][pair] - models[1][pair] for pair in models[0]}


def _score(string: Column, table: Column) -> Column:
    codes = F.transform(F.split(string, ""), F.ascii)
    return F.aggregate(F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)),
                                  lambda a, b: a * 128 + b), F.lit(0.0), lambda acc, p: acc + F.get(table, p))


def scan(df: DataFrame, ratios: dict[tuple[int, int], float] | None = None, text: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """Add ``secrets``: all spans of each text as an array of (start, kind, end),
    by start, then kind (0 assign, 1 access, 2 hex, 3 markov).

    A null or empty text has none.  Each row is judged alone (repeated rows
    alike); an input column named ``secrets`` gives way.  Markov spans are runs
    of ``CANDIDATE`` whose log odds reach ``threshold`` and that touch no base span.
    """
    ratios = train(df, text) if ratios is None else ratios
    flat = [f"{ratios.get((a, b), 0.0):.3f}" for a in range(128) for b in range(128)]
    table = F.split(F.lit(",".join(flat)), ",").cast("array<float>")  # folded to one literal
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = _positions(base_spans(df, "__t"), "__t", CANDIDATE, 3, "__run")
    base = F.concat("__assign", "__access", "__hex")

    def judged(run, i):
        free = ~F.exists(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
        return free & (_score(F.get(F.col("__run_m"), i), table) >= threshold)

    added = F.when(F.size("__run") > 0, F.filter("__run", judged)).otherwise(F.col("__run"))
    df = df.withColumn("__added", added)
    return (df.withColumn("secrets", F.array_sort(F.concat("__assign", "__access", "__hex", "__added")))
            .drop("__t", "__assign", "__access", "__hex", "__run", "__added",
                  "__assign_m", "__access_m", "__hex_m", "__run_m"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(F.encode(spans_text(base), "UTF-8"), 256).alias("base_sha256"),
                        spans_text(F.col("secrets")).alias("spans"))
