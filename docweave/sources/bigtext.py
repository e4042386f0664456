"""Texts of any size: a file is read in blocks by many tasks.

A text above 2 GiB fits no cell.  Here a file is cut at every ``block_bytes``,
and each cut moves on to the next byte below 0x80 that is no line feed: such a
byte starts a character and never splits ``\r\n``, so both neighbours find the
same place, and the blocks decode and fold as the whole would.  A first pass
counts each block's characters; their prefix sums say where a block starts in
the text, so a second pass cuts the same 2,000-character chunks that the whole
text has.  Only the chunks that a cut runs through meet in a shuffle.

A text may lie in several files, as many tasks write it: each file then names its
``text`` and its ``part``, in whose order they follow; a part ends with a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import CHUNK_SIZE, SENTENCES_PER_CHUNK, lead_summary

BLOCK_BYTES = 64 << 20
CHUNK_SEP = "\n\n"


def _cut(file, size: int, at: int) -> int:
    """Where the block boundary at byte ``at`` really lies."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    file.seek(at)
    while at < size:
        piece = file.read(1 << 16)
        for i, b in enumerate(piece):
            if b < 0x80 and b != 0x0A:
                return at + i
        at += len(piece)
    return size


def block_text(path: str, block: int, block_bytes: int) -> str:
    """One block of a file as text; empty where an earlier one took it."""
    from docweave.sources.storage import open_store

    store, at = open_store(path)
    with store.open_input_file(at) as file:
        size = file.size()
        start, stop = _cut(file, size, block * block_bytes), _cut(file, size, (block + 1) * block_bytes)
        file.seek(start)
        data = file.read(stop - start)
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def _read(blocks: DataFrame, block_bytes: int, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield from function(row, block_text(row.path, row.block, block_bytes))

    return blocks.mapInPandas(run, schema)


def _slots(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, text, n_chars, start): the blocks of ``files`` (path, length,
    and text and part where a text has several files), their characters, and the
    place of the first one in the text.  A file without bytes has one block."""
    if "text" not in files.columns:
        files = files.withColumns({"text": F.col("path"), "part": F.lit("")})
    last = F.greatest(F.ceil(F.col("length") / block_bytes), F.lit(1)) - 1
    blocks = files.select("path", "text", "part", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition(_slots(files), "path", "block")
    counted = _read(blocks, block_bytes, lambda row, text: [pd.DataFrame({
        "path": [row.path], "block": [row.block], "text": [row.text], "part": [row.part], "n_chars": [len(text)]})],
                    "path string, block long, text string, part string, n_chars long")
    before = Window.partitionBy("text").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("start", F.coalesce(F.sum("n_chars").over(before), F.lit(0))).drop("part")


def text_pieces(blocks: DataFrame, size: int = CHUNK_SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """T4 of ``text_blocks``: (path - the text's -, chunk_no, inside, piece).  A chunk that no
    cut runs through is one piece from place 0; other pieces say where in their
    chunk they begin."""
    def cut(row, text):
        start, at, rows = int(row.start), 0, []
        while at < len(text):
            no, inside = divmod(start + at, size)
            rows.append((row.text, no, inside, text[at:at + size - inside]))
            at += size - inside
            if len(rows) == 2_000 or at >= len(text):
                yield pd.DataFrame(rows, columns=["path", "chunk_no", "inside", "piece"])
                rows = []

    dealt = blocks.select("path", "block", "text", "start").repartition(_slots(blocks), "path", "block")
    return _read(dealt, block_bytes, cut, "path string, chunk_no long, inside long, piece string")


def chunk_summaries(pieces: DataFrame, size: int = CHUNK_SIZE, per_chunk: int = SENTENCES_PER_CHUNK) -> DataFrame:
    """T5: (path, chunk_no, summary).  A full chunk is summarised where it was
    read; pieces are put together first."""
    full = (F.col("inside") == 0) & (F.char_length("piece") == size)
    rows = pieces.select("path", "chunk_no", "inside", full.alias("full"),
                         F.when(full, lead_summary("piece", per_chunk)).otherwise(F.col("piece")).alias("t"))
    met = rows.groupBy("path", "chunk_no").agg(F.bool_and("full").alias("full"), F.array_sort(F.collect_list(F.struct("inside", "t"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return met.select("path", "chunk_no", F.when(F.col("full"), text).otherwise(lead_summary(text, per_chunk)).alias("summary"))


def big_text_summaries(files: DataFrame, size: int = CHUNK_SIZE, per_chunk: int = SENTENCES_PER_CHUNK,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, n_chars, summary) of text files (path, length) of any size, or of
    texts in several files (``text``, ``part`` too; path is the text then), the summary as ``local_summary`` has it of the whole text; '' for an empty file.
    The one row that a file ends in holds its summary, not its text."""
    blocks = text_blocks(files, block_bytes)
    parts = chunk_summaries(text_pieces(blocks, size, block_bytes), size, per_chunk)
    joined = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "summary"))).alias("p")).select(
        "path", F.array_join(F.transform("p", lambda x: x["summary"]), CHUNK_SEP).alias("summary"))
    return (blocks.groupBy(F.col("text").alias("path")).agg(F.sum("n_chars").alias("n_chars")).join(joined, "path", "left")
            .select("path", "n_chars", F.coalesce("summary", F.lit("")).alias("summary")))
