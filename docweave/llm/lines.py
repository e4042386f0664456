"""Line dedup: exact set-similarity join of lines (DataFrame functions only).

A line is the set of its words.  Words are ordered from rare to common, and two
lines of Jaccard similarity 0.8 or more share a word among the first few of each
(prefix filter).  Where they meet, their sizes (length filter), the places of
that word (positional filter) and 64 parity bits bound the overlap; what is left
is verified on the words themselves.  A line goes if an earlier one, by key and
line number, is that similar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import discard, read, stash

PERCENT = 80
#: Words are counted in so many buckets, which bounds what the counts take;
#: words of one bucket go by their hash.
BUCKETS = 1 << 16
#: Members of a group of near copies that all others are compared with.
LEADERS = 4
#: Marks a posting of a word that is none of its line's index words; above any number of words.
OTHER = 1 << 62
#: For tables of hashes: few values come twice, so a dictionary of them is work for nothing.
HASHES = {"parquet.enable.dictionary": "false"}
#: Keys are broadcast up to this many (a few MB), and dealt beyond, with the wide rows that they meet.
BROADCAST_KEYS = 500_000


def _few(keys: DataFrame) -> DataFrame:
    """A table of keys from ``stash``, broadcast where it is small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _spaced(text: str) -> Column:
    """The text with other blanks than line ends as spaces: a split at one
    character is many times cheaper than one at a pattern."""
    t = F.col(text)
    odd = F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\r")) | F.contains(t, F.lit("\f")) | F.contains(t, F.lit("\u000b"))
    return F.when(odd, F.translate(t, "\t\r\f\u000b", "    ")).otherwise(t)


def _coded(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``__code``: 0, or, where rows of one key differ in their text,
    31 bits of the text's hash above a line number, which tell them apart."""
    digest = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF))
    shared = stash(df.select(F.col(key).cast("long").alias("__key"), digest.alias("__h")).groupBy("__key")
                   .agg(F.min("__h").alias("a"), F.max("__h").alias("b")).where("a <> b").select("__key"), "clashes")
    return df.join(shared, F.col(key).cast("long") == F.col("__key"), "left").withColumn(
        "__code", F.when(F.col("__key").isNull(), F.lit(0).cast("long")).otherwise(F.shiftleft(digest, 32))).drop("__key")


def _lines(df: DataFrame, key: str, text: str, numbers: str | None = None) -> DataFrame:
    """(doc, line, t): the lines of a ``_coded`` table; ``line`` is the row's code
    plus the number from 0.  ``numbers``: column with the ``line`` values to take."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), *([numbers] if numbers else []),
                                                   "__code", F.posexplode(F.split(_spaced(text), "\n", -1)).alias("line", "t"))
    rows = rows.withColumn("line", F.col("__code") + F.col("line"))
    if numbers:
        rows = rows.where(F.array_contains(numbers, F.col("line")))
    return rows.select("doc", "line", "t")


def _words(line: Column) -> Column:
    """The words of a line; may hold empty strings."""
    return F.split(line, " ", -1)


def _bucket_counts(df: DataFrame, text: str) -> DataFrame:
    """(b, n): words counted by bucket of their hash, over all texts."""
    flat = F.replace(_spaced(text), F.lit("\n"), F.lit(" "))
    return (df.select(F.explode(F.split(flat, " ", -1)).alias("w"))
            .groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")))


def _prefix(n: Column) -> Column:
    """Words that a line shows: a similar line of no fewer words has one of its
    own first ``_index`` words among them."""
    return n - F.ceil(n * F.lit(PERCENT) / 100) + 1


def _index(n: Column) -> Column:
    """The same for the line of fewer words: two similar lines share at least
    2t / (1 + t) of the shorter one's words."""
    return n - F.ceil(n * F.lit(2 * PERCENT) / (100 + PERCENT)) + 1


def _signed(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, line, n, sig, sig2, s1, s2, heads, prefix): distinct words, 128
    parity bits (64 of the words with a negative hash, 64 of the others), two
    digests of the set, four digests of four words each (of the smallest and of
    the largest hashes of either sign), and hashes of its rarest words in order."""
    level = [0] * BUCKETS  # at most BUCKETS rows come to the driver
    for r in counts.collect():
        level[r["b"]] = min(127, round(3 * math.log2(r["n"] + 1)))
    # (small numbers, folded to one literal: every plan of the driver holds its text)
    rarity = F.split(F.lit(",".join(map(str, level))), ",").cast("array<bigint>")

    # distinct hashes in order; a 0 among them parts those of either sign
    zero = F.lit(0).cast("long")
    h = F.array_remove(F.array_distinct(F.transform(_words(F.col("t")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    h = F.sort_array(F.concat(h, F.array(zero)))
    # (blank lines stay for now: a filter here would compute the hashes a second time)
    rows = lines.select("doc", "line", h.alias("all")).select(
        "doc", "line", F.array_remove("all", zero).alias("h"), F.array_position("all", zero).cast("int").alias("place"))
    rows = rows.withColumns({"n": F.size("h"), "low": F.slice("h", F.lit(1), F.col("place") - 1), "high": F.slice("h", F.col("place"), F.size("h"))})
    # common words last: the bucket's count above 48 bits of the word's hash
    # (an item that is never null: an array that may hold nulls is sorted as objects)
    keyed = F.transform("h", lambda x: F.shiftleft(rarity[x.bitwiseAND(F.lit(BUCKETS - 1))], 48).bitwiseOR(F.shiftrightunsigned(x, 16)))
    one = F.lit(1).cast("long")
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))
    prefix = F.transform(F.slice(F.sort_array(keyed), F.lit(1), _prefix(F.col("n")).cast("int")), lambda k: F.hash(k))
    able = lambda c: F.when(F.col("n") > 3, c)
    four = [F.slice("h", 1, 4), F.slice("h", -4, 4), F.slice(F.reverse("low"), 1, 4), F.slice("high", 1, 4)]
    heads = F.array(*[F.when(F.size(f) == 4, F.hash(F.lit(i), f)) for i, f in enumerate(four)])
    return rows.select("doc", "line", "n", bits("low").alias("sig"), bits("high").alias("sig2"), F.xxhash64("h").alias("s1"),
                       F.xxhash64(F.lit(1), "h").alias("s2"), able(heads).alias("heads"), able(prefix).alias("prefix"))


def _apart(a: str, b: str) -> Column:
    """Words that one of two lines lacks, at least: parity bits that differ."""
    return (F.bit_count(F.col(f"{a}_sig").bitwiseXOR(F.col(f"{b}_sig"))) + F.bit_count(F.col(f"{a}_sig2").bitwiseXOR(F.col(f"{b}_sig2"))))


def _possible(n_a: Column, n_b: Column, apart: Column) -> Column:
    """Length filter, and the most words that one of two similar lines can lack."""
    return ((100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & (apart * (100 + PERCENT) <= (100 - PERCENT) * (n_a + n_b)))


def _earlier(a: str, b: str) -> Column:
    return F.expr(f"{a}_doc < {b}_doc OR ({a}_doc = {b}_doc AND {a}_line < {b}_line)")


def _verify(pairs: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line) of the later lines of the pairs whose words reach the similarity."""
    places = pairs.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).unionByName(
        pairs.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line")))
    wanted = stash(places.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__lines")), "wanted")
    docs = df.select(key, text, "__code").join(_few(wanted), F.col(key).cast("long") == F.col("__doc"))
    sets = stash(_lines(docs, key, text, "__lines"), "sets")
    side = lambda p: sets.select(*[F.col(c).alias(f"{p}_{c}") for c in sets.columns])
    both = pairs.join(side("y"), ["y_doc", "y_line"]).join(side("x"), ["x_doc", "x_line"])
    for p in ("x", "y"):
        both = both.withColumn(f"{p}_w", F.array_remove(F.array_distinct(F.transform(_words(F.col(f"{p}_t")), lambda w: F.xxhash64(w))),
                                                        F.xxhash64(F.lit(""))))
    both = both.withColumn("inner", F.size(F.array_intersect("x_w", "y_w")))
    hit = F.expr(f"100 * inner >= {PERCENT} * (size(x_w) + size(y_w) - inner)")
    later = stash(both.where(hit).select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line")).distinct(), "later")
    discard(wanted, sets)
    return later


def _matched(pairs: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line) of the later lines that some pair settles.  One match is
    enough: first the earliest candidate of each line is verified, then all those
    of the lines that it does not settle; but all at once where that is at most
    four times as many."""
    ends = pairs.columns
    earliest = stash(pairs.groupBy("y_doc", "y_line").agg(F.min(F.struct("x_doc", "x_line")).alias("x")).select(
        F.col("x.x_doc").alias("x_doc"), F.col("x.x_line").alias("x_line"), "y_doc", "y_line"), "earliest")
    if pairs.count() <= 4 * earliest.count():  # few others: one pass over the texts for all of them
        discard(earliest)
        return _verify(pairs, df, key, text)
    settled = _verify(earliest, df, key, text)
    rest = stash(pairs.join(settled, F.expr("y_doc = doc AND y_line = line"), "left_anti").join(earliest, ends, "left_anti"), "rest")
    others = _verify(rest, df, key, text)
    discard(earliest, rest)
    return settled.unionByName(others)


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line) of the lines to remove, numbered from 0."""
    return _repeated(_coded(df.select(key, text), key, text), key, text).select("doc", F.col("line").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("line"))


def _repeated(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line) of the lines of a ``_coded`` table to remove.

    Equal sets collapse into one class with its earliest line.  Classes that
    agree in the four words of one of their heads are first compared with the
    ``LEADERS`` earliest of them, which settles most of a group of near copies.
    What finds no match there is looked up among all lines that share a word of
    the prefix; so a large group makes few more comparisons than it has members.
    """
    counts = stash(_bucket_counts(df, text), "counts")
    lines = stash(_signed(_lines(df, key, text), counts), "lines", **HASHES)
    discard(counts)
    body = ["doc", "line", "n", "sig", "sig2", "heads", "prefix"]
    classes = stash(lines.where("n > 0").groupBy("s1", "s2").agg(
        F.min(F.struct(*body)).alias("f"), F.count(F.lit(1)).alias("copies")).select("s1", "s2", "copies", "f.*"), "classes", **HASHES)
    able = classes.where("n > 3")  # smaller sets are only similar to themselves
    named = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])
    heads = able.select("doc", "line", "n", "sig", "sig2", F.explode("heads").alias("k")).where("k IS NOT NULL")
    shared = stash(heads.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "shared")
    heads = stash(heads.join(_few(shared), "k"), "heads")
    discard(shared)
    place = Window.partitionBy("k").orderBy("doc", "line")
    leaders = heads.withColumn("r", F.row_number().over(place)).where(F.col("r") <= LEADERS).drop("r")
    leaders = stash(leaders, "leaders")
    near = named(heads, "y").join(named(leaders, "x"), F.col("x_k") == F.col("y_k"))
    near = near.where(_earlier("x", "y") & _possible(F.col("x_n"), F.col("y_n"), _apart("x", "y")))
    ends = ["x_doc", "x_line", "y_doc", "y_line"]
    near = stash(near.select(*ends).distinct(), "near")
    discard(heads, leaders)
    later = _matched(near, df, key, text)
    discard(near)

    known = stash(later, "known")
    known = _few(known).withColumn("done", F.lit(1))
    open_ = able.join(known, ["doc", "line"], "left").withColumn("done", F.coalesce("done", F.lit(0)))
    posts = open_.select("doc", "line", "sig", "sig2", "n", "done", F.posexplode("prefix").alias("i", "word"))
    m = F.shiftleft(F.col("n").cast("long"), 32) + F.shiftleft(F.col("i").cast("long"), 1) + F.col("done")
    posts = posts.withColumn("m", F.when(F.col("i") < _index(F.col("n")), m).otherwise(m + F.lit(OTHER)))
    # (columns that are never null: the join tests them for each pair)
    posts = posts.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("word", "doc", "line", "sig", "sig2", "m")])
    # a is the line of fewer words (of as many: the earlier one) and shows its index words alone; whichever is later must be open
    a, b = named(posts, "a"), named(posts, "b")
    plain = F.col("b_m").bitwiseAND(F.lit(OTHER - 1))
    n_a, n_b = F.shiftright("a_m", 32), F.shiftright(plain, 32)
    i = lambda p: F.shiftright(F.col(f"{p}_m").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    done = lambda p: F.col(f"{p}_m").bitwiseAND(F.lit(1)) == 1
    first = _earlier("a", "b")
    # (the tests that are cheap and fail most come first: one comparison for an index word and the sizes' order;
    # with a term of b, so that both sides stay one exchange)
    fits = ((F.col("a_m") <= plain.bitwiseOR(F.lit(0xFFFFFFFF))) & _possible(n_a, n_b, _apart("a", "b"))
            & ((n_a < n_b) | first) & F.when(first, ~done("b")).otherwise(~done("a") & _earlier("b", "a"))
            & ((F.least(i("a"), i("b")) + F.least(n_a - i("a"), n_b - i("b"))) * (100 + PERCENT) >= PERCENT * (n_a + n_b)))
    met = (a.join(b, (F.col("a_word") == F.col("b_word")) & fits)
           .select(*[F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{p}_{c}")
                     for p, x, y in (("x", "a", "b"), ("y", "b", "a")) for c in ("doc", "line")]))
    pairs = stash(met.distinct(), "pairs")
    later = later.unionByName(_matched(pairs, df, key, text))
    discard(pairs)
    gone = later.select("doc", "line", F.lit(True).alias("gone"))
    status = classes.select("s1", "s2", "copies", F.col("doc").alias("f_doc"), F.col("line").alias("f_line")).join(
        gone, (F.col("f_doc") == F.col("doc")) & (F.col("f_line") == F.col("line")), "left").where("gone OR copies > 1").drop("doc", "line", "copies")
    return (lines.where("n > 0").select("doc", "line", "s1", "s2").join(stash(status, "status"), ["s1", "s2"])
            .where("gone OR doc <> f_doc OR line <> f_line").select("doc", "line"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with its texts less the repeated lines, and ``removed_lines``
    (their numbers from 0; empty where none go).

    Blank lines, null and empty texts and rows without a key stay as they are.
    Rows that share a key and a text are one document: the first copy of a line,
    by key and number, stays in each of them.  Rows that share a key alone are
    documents of their own, in the order of their texts' hashes.  A column named
    ``removed_lines`` gives way.
    """
    coded = _coded(df.drop("removed_lines"), key, text)
    gone = stash(_repeated(coded.select(key, text, "__code"), key, text), "gone")
    low = F.col("line").bitwiseAND(F.lit(0xFFFFFFFF))
    per = gone.distinct().groupBy(F.col("doc").alias("__doc"), (F.col("line") - low).alias("__row")).agg(
        F.array_sort(F.collect_list(low.cast("int"))).alias("__gone"))
    rows = coded.join(per, (F.col(key).cast("long") == F.col("__doc")) & (F.col("__code") == F.col("__row")), "left").drop("__code")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda s, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return (rows.drop("__doc", "__row").withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
            .withColumn("removed_lines", F.coalesce("__gone", F.expr("cast(array() as array<int>)"))).drop("__gone"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that goes: doc_id, line_no."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_lines(docs).select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line_no"))


#: The same join on exact word counts.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
sets AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(
    string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS ws FROM lines),
classes AS (
  SELECT ws, len(ws) AS n, min({'d': doc_id, 'l': line_no}) AS f FROM sets WHERE len(ws) > 0 GROUP BY ws),
words AS (SELECT f, n, unnest(ws) AS w FROM classes),
ranked AS (
  SELECT f, n, w, row_number() OVER (PARTITION BY f ORDER BY df, w) AS r
  FROM words JOIN (SELECT w, count(*) AS df FROM words GROUP BY w) USING (w)),
prefix AS (SELECT f, n, w FROM ranked WHERE r <= n - CAST(ceil(n * 80 / 100.0) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT x.f AS xf, y.f AS yf FROM prefix x JOIN prefix y ON x.w = y.w
  WHERE x.f < y.f AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
alike AS (
  SELECT DISTINCT yf FROM pairs JOIN classes a ON a.f = xf JOIN classes b ON b.f = yf
  WHERE 100 * len(list_intersect(a.ws, b.ws)) >= 80 * (a.n + b.n - len(list_intersect(a.ws, b.ws))))
SELECT s.doc_id, CAST(s.line_no AS BIGINT) AS line_no
FROM sets s JOIN classes c ON s.ws = c.ws LEFT JOIN alike g ON g.yf = c.f
WHERE g.yf IS NOT NULL OR s.doc_id <> c.f.d OR s.line_no <> c.f.l
"""
