"""A corpus pipeline of five stages: quality filter, line dedup, near-duplicate
removal, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; the one before it is then
dropped.  All but the last return the columns of documents, unchanged but for
text and n_chars in line_dedup.

Odd input, in every stage: further columns pass through whatever their names,
as the operators see all of them under private ones; repeated rows are rows of
their own; an empty table stays empty.  What a null key, source or text and an
empty or very long text come to is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, lines, minhash, mixing, quality
from docweave.llm.common import discard, read, stash


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with private column names, and those by column."""
    names = {c: f"__in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _shown(df: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    return df.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, learnt from this table's labels, puts at 0.5
    or above.  Without labels of both kinds all stay.  A null text is scored as
    an empty one; a row without a key is scored and never learnt from."""
    model = quality.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    hidden, names = _hidden(docs)
    return _shown(quality.score(hidden, model, text=names["text"], out="__score").where("__score >= 0.5"), names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that an earlier line repeats; n_chars follows.  A
    document that loses every word goes; one that had none (null, empty, blank)
    and one without a key stay as they are."""
    hidden, names = _hidden(docs)
    text = names["text"]
    cut = lines.dedup(hidden, key=names["doc_id"], text=text)
    untouched = F.size("removed_lines") == 0
    cut = cut.where(untouched | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    changed = {}
    if "n_chars" in names:
        changed["n_chars"] = F.when(untouched, F.col(names["n_chars"])).otherwise(
            F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return _shown(cut, names, **changed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five-word shingles,
    0.8).  Rows that share a doc_id stay or go together; documents without words
    and rows without a key are in no group and stay."""
    hidden, names = _hidden(docs)
    return _shown(minhash.near_duplicates(hidden, key=names["doc_id"], text=names["text"]).where("kept"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.
    A null source is a source; a null text has no words, and any number of
    copies of it meets the target."""
    hidden, names = _hidden(docs)
    mixed = mixing.mix(hidden, key=names["doc_id"], source=names["source"], size=mixing.words(F.col(names["text"])))
    return _shown(mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), names)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256) of every copy; a null text
    is an empty one."""
    texts = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.round_trip(texts)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: The stages that learn, sign and tokenise have no SQL form; the tests hold
#: run() and each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
