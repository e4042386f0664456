"""Text rules as Spark Column expressions.

Everything here is a pure Column -> Column function built from JVM-side
functions, so it stays inside whole-stage code generation (the array parts
run as higher-order functions) and can be used in ``select``, ``withColumn``
or SQL-like pipelines on batch or streaming DataFrames.

Whitespace: Python's ``\\s`` on ``str`` is Unicode whitespace plus the
separators U+001C..U+001F.  Java's ``\\s`` is ASCII only, so we use the
Unicode flag and add the four separators explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference behaviour -----------------
PLACEHOLDER = "No readable content found."
CHUNK_SIZE = 2000
SENTENCES_PER_CHUNK = 2
DEFAULT_SENTENCES = 5
LEVEL_LABELS = {1: "brief", 2: "detailed"}  # anything else: "full"
# ---------------------------------------------------------------------------

WS_RUN = r"(?U)[\s\x1c-\x1f]+"
# every character Python's str.isspace() accepts (derived by rule, 29 chars)
PY_WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
SENTENCE_BREAK = r"(?<=[.!?])(?U)[\s\x1c-\x1f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: ``btrim`` with the whitespace set (no regex)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def normalize_whitespace(c) -> Column:
    """Every whitespace run becomes one space; ends stripped."""
    # after the replace the only whitespace left is U+0020, so trim() is exact
    return F.trim(F.regexp_replace(_col(c), WS_RUN, " "))


def _sentences_of_normalized(norm: Column, limit: int = -1) -> Column:
    parts = F.split(norm, SENTENCE_BREAK, limit)
    return F.filter(parts, lambda x: x != "")


def split_sentences(c) -> Column:
    """Sentences of the normalised text, split after . ! ? + space."""
    return _sentences_of_normalized(normalize_whitespace(c))


def _lead_of_normalized(norm: Column, n: int) -> Column:
    # split(limit=n+1) keeps the first n sentences exact and leaves the rest
    # of the text in one trailing part we drop - no need to split it all.
    first = F.slice(_sentences_of_normalized(norm, n + 1), 1, n)
    return (
        F.when(norm.isNull(), F.lit(PLACEHOLDER))
        .when(norm == "", F.lit(PLACEHOLDER))
        .otherwise(F.array_join(first, " "))
    )


def lead_summary(c, n: int = DEFAULT_SENTENCES) -> Column:
    """First ``n`` sentences joined by a space; blank -> placeholder."""
    if n < 1:
        raise ValueError("n must be >= 1")
    return _lead_of_normalized(normalize_whitespace(c), n)


def chunk_text(c, size: int = CHUNK_SIZE) -> Column:
    """T4: array of fixed-size code-point chunks; empty text -> [].

    ``regexp_extract_all`` walks the string once (linear), unlike a
    ``sequence`` of ``substring`` calls which rescans UTF-8 per chunk.
    """
    if size < 1:
        raise ValueError("size must be >= 1")
    return F.regexp_extract_all(_col(c), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunk_summary(chunk, per_chunk: int = SENTENCES_PER_CHUNK) -> Column:
    """T5: the lead sentences of one chunk (placeholder if blank)."""
    return lead_summary(chunk, per_chunk)


def chunk_summaries(c, size: int = CHUNK_SIZE,
                    per_chunk: int = SENTENCES_PER_CHUNK) -> Column:
    """T5 (in-row): array of the lead sentences of every chunk."""
    normalized = F.transform(chunk_text(c, size), normalize_whitespace)
    return F.transform(normalized, lambda ch: _lead_of_normalized(ch, per_chunk))


def local_summary(c, size: int = CHUNK_SIZE,
                  per_chunk: int = SENTENCES_PER_CHUNK) -> Column:
    """Chunk summaries joined by a blank line; ``""`` for empty text.

    In-row form: no shuffle, one pass per document.
    """
    return F.array_join(chunk_summaries(c, size, per_chunk), "\n\n")


def chunk_rows(df, text_col: str = "text", key_cols=("doc_id",),
               size: int = CHUNK_SIZE):
    """T4 (row form): one row per chunk ``(*keys, chunk_no, chunk)``.

    Use this when single documents are so long that one task per document
    would straggle; ``summaries_from_chunk_rows(spread=...)`` then spreads
    the chunks of such documents over tasks.
    """
    keys = [F.col(k) for k in key_cols]
    return df.select(*keys, F.posexplode(chunk_text(text_col, size)).alias("chunk_no", "chunk"))


def all_chunk_rows(df, text_col: str = "text", key_cols=("doc_id",), size: int = CHUNK_SIZE):
    """As ``chunk_rows``, with one row ``(*keys, null, null)`` for a document
    without any chunk, so that summaries keep every document."""
    keys = [F.col(k) for k in key_cols]
    return df.select(*keys, F.posexplode_outer(chunk_text(text_col, size)).alias("chunk_no", "chunk"))


def summaries_from_chunk_rows(chunks, key_cols=("doc_id",),
                              per_chunk: int = SENTENCES_PER_CHUNK, spread: int | None = None):
    """T5/T6 (row form): summarise chunk rows, then one ordered concat per doc.

    With ``spread=n`` the chunk rows are first hash-partitioned by
    ``(keys, chunk_no)`` into ``n`` partitions, so the chunks of one very
    long document are summarised by many tasks instead of the one that read
    it (the chunk text is shuffled once).  The aggregate then carries one
    short summary per chunk (a few hundred bytes), so even a document with a
    third of all chunks stays a small group.
    """
    if spread:
        chunks = chunks.repartition(int(spread), *key_cols, "chunk_no")
    keyed = chunks.withColumn("chunk_summary", lead_summary("chunk", per_chunk))
    agg = keyed.groupBy(*key_cols).agg(
        F.array_sort(F.collect_list(F.when(F.col("chunk_no").isNotNull(), F.struct("chunk_no", "chunk_summary")))).alias("_parts")
    )
    return agg.select(*key_cols,
                      F.array_join(F.transform("_parts", lambda p: p["chunk_summary"]),
                                   "\n\n").alias("summary"))


def shorten_title(stem) -> Column:
    """``_`` and ``-`` become spaces."""
    return F.translate(_col(stem), "_-", "  ")


def level_label(level) -> Column:
    """1 brief, 2 detailed, anything else full."""
    lv = _col(level)
    return (F.when(lv == 1, F.lit(LEVEL_LABELS[1]))
            .when(lv == 2, F.lit(LEVEL_LABELS[2]))
            .otherwise(F.lit("full")))
