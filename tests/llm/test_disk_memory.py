"""What operators leave on disk and in their workers."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.llm import language_model, lines, substrings
from docweave.llm.common import stash


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_table_on_disk_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out = stash(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # files go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert sorted(r["count"] for r in out.collect()) == [142] * 1 + [143] * 6


def test_substrings_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5_000)]
    shared = [" ".join(rng.choice(words, 70)) for _ in range(4)]
    rows = [(i, " ".join([" ".join(rng.choice(words, 30)), shared[i % 4], " ".join(rng.choice(words, 20)), shared[(i * 3 + 1) % 4]])) for i in range(24)]
    df = spark.createDataFrame([*rows, (50, shared[0] + " " + shared[0]), (51, None), (52, "")], "doc_id long, text string")
    got = {}
    for parts in (1, 4):
        monkeypatch.setattr(substrings, "PARTS", parts)
        got[parts] = sorted((r.id, tuple(tuple(s) for s in r.spans), tuple(r.firsts)) for r in substrings.repeats(df).collect())
    assert got[1] == got[4]
    assert {r[0] for r in got[4]} >= {*range(4, 24), 50}
    cut = [sorted(map(tuple, substrings.dedup(df).select("doc_id", "text", F.col("spans").cast("string")).collect()))]
    monkeypatch.setattr(substrings, "BROADCAST_MARKS", 0)
    cut.append(sorted(map(tuple, substrings.dedup(df).select("doc_id", "text", F.col("spans").cast("string")).collect())))
    assert cut[0] == cut[1] and len(cut[0]) == 27


def test_lines_with_keys_dealt_and_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [[f"w{k}" for k in rng.integers(0, 300, 20)] for _ in range(6)]
    rows = []
    for i in range(60):
        line = list(base[i % 6])
        if i % 3:
            line[int(rng.integers(0, 20))] = f"x{i}"
        rows.append((i, " ".join(line) + "\n" + " ".join(f"w{k}" for k in rng.integers(0, 300, 12))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = stash(df.select("doc_id"), "test")
    assert "broadcast" in lines._few(few)._jdf.queryExecution().analyzed().toString().lower()
    got = [sorted(map(tuple, lines.repeated_lines(df).collect()))]
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    assert "broadcast" not in lines._few(few)._jdf.queryExecution().analyzed().toString().lower()
    got.append(sorted(map(tuple, lines.repeated_lines(df).collect())))
    assert got[0] == got[1] and len(got[0]) >= 50


def test_language_model_gathers_a_block_in_little_memory():
    rng = np.random.default_rng(1)
    vocabulary = np.sort(rng.integers(1, 2**63, 20_000).astype(np.uint64))
    mine, rows, n = vocabulary[::7], [], 0
    pack = language_model._pack
    for batch in range(64):
        w, u, d = rng.integers(0, len(mine), 4_000), rng.integers(0, len(vocabulary), 4_000), rng.integers(0, 500, 4_000)
        entries, times = np.unique((w * 65_536 + u) * 1_000 + d, return_counts=True)
        n += len(entries)
        w, u, d = entries // 65_536_000, entries // 1_000 % 65_536, (entries % 1_000).astype(np.uint16)
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        met, of = np.unique(u, return_inverse=True)
        rows.append({"block": 3, "batch": batch, "words": pack(mine[w[starts]]), "per": pack(np.diff(np.append(starts, len(w))).astype(np.uint32)),
                     "contexts": pack(vocabulary[met]), "u": pack(of.astype(np.uint32)), "doc": pack(d), "times": pack(times.astype(np.uint32)),
                     "learn": np.packbits(np.ones(500, bool)).tobytes()})
    schema = pa.schema([("block", pa.int32()), ("batch", pa.int64()), *((k, pa.binary()) for k in ("words", "per", "contexts", "u", "doc", "times", "learn")),
                        ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])
    table = pa.Table.from_pylist(rows, schema=schema)
    tracemalloc.start()
    out = language_model._gather(table, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * n, peak / n
    counts = language_model._unpack(out["m_c"][0].as_py(), np.uint32)
    assert counts.sum() == 64 * 4_000 and len(out["o_type"][0]) == 64


def test_lines_put_little_text_into_plans(spark):
    """The driver keeps the text of every plan: word counts reach it as small numbers."""
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    counts = spark.range(lines.BUCKETS).selectExpr("cast(id as int) AS b", "id * 1000 AS n")
    signed = lines._signed(lines._lines(docs.withColumn("__code", F.lit(0).cast("long")), "doc_id", "text"), counts)
    assert len(signed._jdf.queryExecution().executedPlan().toString()) < 500_000


def test_lines_verify_few_candidates_in_one_pass(spark, monkeypatch):
    names = []
    monkeypatch.setattr(lines, "stash", lambda df, name, **options: names.append(name) or stash(df, name, **options))
    words = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(words[:19] + [f"x{i}"])) for i in range(4)] + [(9, "quite another line of words")]
    got = {(r.doc, r.line) for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (2, 0), (3, 0)} and names.count("sets") == 2
