"""Part assembly (A1-A4): document text from ordered parts.

Three forms of the rules:

* in-row, over an ``array<string>`` column of parts already inside the
  document row - no shuffle;
* grouped, over a parts table ``(doc keys, part_no, text)`` - one
  aggregation keyed by document.  Parts are filtered and trimmed to the
  text that survives *before* the shuffle, and every concat sorts on an
  explicit position (``collect_list`` order is never relied on).  The
  aggregated value is the document's own text, so its size is bounded by
  the document, not by the data set;
* as rows (``part_rows``), for documents that fit no row: every part with its
  place in the document's text, in blocks that many tasks share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.structured import PREVIEW_ROWS, _ordered_concat, table_preview

# ---- fixed values ----------------------------------------------------------
PART_SEP = "\n\n"
SLIDE_PREFIX = "Slide "
# -----------------------------------------------------------------------------

_NON_BLANK = r"(?U)[^\s\x1c-\x1f]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """True for null or whitespace-only text (Python ``not s.strip()``)."""
    col = _c(c)
    return col.isNull() | ~col.rlike(_NON_BLANK)


def join_parts(parts) -> Column:
    """A1/A3 in-row: drop blank parts, join with a blank line."""
    return F.array_join(F.filter(_c(parts), lambda p: ~is_blank(p)), PART_SEP)


def assemble_paragraphs(parts: DataFrame, key_cols=("doc_id",), order_col: str = "part_no",
                        text_col: str = "text", out: str = "text") -> DataFrame:
    """A1: blank paragraphs dropped, the rest joined by a blank line.

    Documents whose paragraphs are all blank give ``""``.
    """
    keys = list(key_cols)
    kept = parts.select(*keys, order_col,
                        F.when(~is_blank(text_col), F.col(text_col)).alias("_t"))
    agg = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.when(F.col("_t").isNotNull(), F.struct(F.col(order_col).alias("o"),
                                                  F.col("_t").alias("v"))))).alias("_p"))
    return agg.select(*keys, F.array_join(F.transform("_p", lambda p: p["v"]), PART_SEP).alias(out))


def assemble_pages(pages: DataFrame, key_cols=("doc_id",), order_col: str = "page_no",
                   text_col: str = "text", out: str = "text") -> DataFrame:
    """A3: a failed (null) or blank page is skipped; blank-line join."""
    return assemble_paragraphs(pages, key_cols, order_col, text_col, out)


#: Parts of one block of a document.
BLOCK_PARTS = 1_024


def part_rows(parts: DataFrame, key_cols=("doc_id",), order_col: str = "part_no", text_col: str = "text",
              sep: str = PART_SEP, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """A1/A3 as rows: ``(*keys, order, start, text)`` of the parts that are not
    blank; ``start`` is the place of the part's first character in the text that
    ``assemble_paragraphs`` would give, ``sep`` between parts counted.

    Blocks are ``block_parts`` consecutive part numbers.  Their lengths, one row
    a block, are summed up along a document, and the places within a block on
    their own, so no task sees more than a block of any document.  Equal numbers
    go by their text, parts without a number come first, in one block.
    """
    keys = list(key_cols)
    block = F.coalesce(F.floor(F.col(order_col) / block_parts), F.lit(-(1 << 62))).cast("long")
    kept = parts.where(~is_blank(text_col)).select(*keys, order_col, F.col(text_col).alias("text"), block.alias("_block"),
                                                   (F.char_length(text_col) + len(sep)).cast("long").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = kept.groupBy(*keys, "_block").agg(F.sum("_n").alias("_sum")).select(
        *keys, "_block", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    for c in keys:  # null keys are documents too
        blocks = blocks.withColumnRenamed(c, f"_k_{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [kept["_block"] == blocks["_block"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    within = Window.partitionBy(*keys, kept["_block"]).orderBy(F.col(order_col).asc_nulls_first(), "text").rowsBetween(Window.unboundedPreceding, -1)
    return kept.join(blocks, on, "left").select(
        *keys, order_col, (F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("start"), "text")


def write_part_rows(rows: DataFrame, path: str, key_cols=("doc_id",), files: int | None = None) -> None:
    """Write ``part_rows`` as Parquet whose files, and rows within, follow the
    order of the texts: ranges of (keys, start), so a large document is written
    by many tasks."""
    order = [*key_cols, "start"]
    spark = rows.sparkSession
    n = int(files or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def slide_text(slide_no, shape_texts) -> Column:
    """A2 in-row: ``Slide n: `` + shape texts joined by newline.

    ``shape_texts`` holds the texts of the shapes that have a text frame
    (empty strings included); an empty or null array means the slide is
    omitted (null), though it keeps its number.
    """
    texts = _c(shape_texts)
    return F.when(F.size(texts) > 0, F.concat(
        F.lit(SLIDE_PREFIX), _c(slide_no).cast("string"), F.lit(": "), F.array_join(texts, "\n")))


def assemble_slides(slides: DataFrame, key_cols=("doc_id",), slide_col: str = "slide_no",
                    shapes_col: str = "shapes", out: str = "text") -> DataFrame:
    """A2 over one row per slide with an array of shape texts."""
    keys = list(key_cols)
    lines = slides.select(*keys, slide_col, slide_text(slide_col, shapes_col).alias("_s"))
    agg = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.when(F.col("_s").isNotNull(), F.struct(F.col(slide_col).alias("o"),
                                                  F.col("_s").alias("v"))))).alias("_p"))
    return agg.select(*keys, F.array_join(F.transform("_p", lambda p: p["v"]), PART_SEP).alias(out))


def assemble_slides_from_shapes(shapes: DataFrame, key_cols=("doc_id",),
                                slide_col: str = "slide_no", shape_col: str = "shape_no",
                                text_col: str = "text", out: str = "text") -> DataFrame:
    """A2 two-level form over one row per shape (``text`` null = no text frame).

    Shapes -> slides is one aggregation; slides -> document a second, on far
    fewer rows.
    """
    keys = list(key_cols)
    # shapes without text are kept as empty slots so the slide still exists
    # (and the document too) without a second pass over the input
    per_slide = (shapes.groupBy(*keys, slide_col)
                 .agg(F.array_sort(F.collect_list(F.when(
                     F.col(text_col).isNotNull(),
                     F.struct(F.col(shape_col).alias("o"), F.col(text_col).alias("v"))))).alias("_p"))
                 .select(*keys, slide_col, F.transform("_p", lambda p: p["v"]).alias("shapes")))
    return assemble_slides(per_slide, keys, slide_col, "shapes", out)


def assemble_sheets(rows: DataFrame, doc_cols=("doc_id",), sheet_col: str = "sheet",
                    sheet_order_col: str = "sheet_no", order_cols=("row_no",), cell_cols=(),
                    n: int = PREVIEW_ROWS, out: str = "text") -> DataFrame:
    """A4: per sheet ``Sheet: <title>`` + first ``n`` rows (null cells dropped,
    ``str`` of the rest joined by ', '), sheets joined by a blank line in
    sheet order.  An all-null row stays as an empty line.
    """
    docs = list(doc_cols)
    previews = table_preview(rows, docs + [sheet_col, sheet_order_col], list(order_cols),
                             list(cell_cols), n=n, title_col=sheet_col, drop="null")
    return _ordered_concat(previews, docs, sheet_order_col, "preview", PART_SEP, out)
