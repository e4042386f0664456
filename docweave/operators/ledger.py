"""The reply ledger: what a provider has answered, kept as it is paid for.

A reply is keyed by the sha-256 of model and prompt.  Tasks of ``infer_batch``
write each reply (or every few) to a file of its own before they go on, under
``pending/<job>/<partition>``; a task that is run again finds there what its
earlier attempt got.  ``settle`` moves replies into one Parquet table,
``answered``.  A later job joins both before it calls anything, so a prompt is
paid for once, whatever died in between.

Replies of the kinds that are not retried (``ok`` and ``bad_reply``) are paid;
a prompt whose attempts all failed is known to its own job and asked again by
the next one.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.storage import exists, open_store, put, remove

FIELDS = "prompt_key string, content string, attempts int, status string, error string"
PAID = ("ok", "bad_reply")


def prompt_key(model, prompt) -> Column:
    """Null where there is no prompt."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(prompt).isNotNull(), F.sha2(F.concat(
        F.coalesce(c(model).cast("string"), F.lit("")), F.lit("\0"), c(prompt)).cast("binary"), 256))


class ReplyLedger:
    """A ledger at a shared folder.  Several jobs may write it at a time."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.job = uuid.uuid4().hex

    @property
    def answered(self) -> str:
        return f"{self.path}/answered"

    @property
    def pending(self) -> str:
        return f"{self.path}/pending"

    def _unsettled(self, spark: SparkSession, job: str = "*") -> DataFrame:
        return (spark.read.schema(FIELDS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
                .json(self.pending if job == "*" else f"{self.pending}/{job}"))

    def replies(self, spark: SparkSession) -> DataFrame:
        """The paid replies, one a key."""
        found = spark.createDataFrame([], FIELDS)
        if exists(spark, self.answered):
            found = found.unionByName(spark.read.schema(FIELDS).parquet(self.answered))
        if exists(spark, self.pending):
            found = found.unionByName(self._unsettled(spark))
        reply = F.struct("status", "attempts", "content", "error")
        # a job that died between copying and deleting leaves a reply twice; ok is above bad_reply
        return (found.where(F.col("status").isin(*PAID)).groupBy("prompt_key").agg(F.max(reply).alias("r"))
                .select("prompt_key", "r.content", "r.attempts", "r.status", "r.error"))

    def settle(self, spark: SparkSession, everything: bool = False) -> None:
        """Move this job's replies into the table; ``everything``: those of all
        jobs, when no other one runs (of jobs that died, say)."""
        at = self.pending if everything else f"{self.pending}/{self.job}"
        if exists(spark, at):
            self._unsettled(spark, "*" if everything else self.job).where(F.col("status").isin(*PAID)).write.mode("append").parquet(self.answered)
            remove(spark, at)


class TaskReplies:
    """One task's part of a ledger: replies of its earlier attempts and its own."""

    def __init__(self, pending: str, job: str, partition: int, every: int = 1) -> None:
        self.store, root = open_store(pending)
        self.folder = posixpath.join(root, job, str(partition))
        self.every, self.held, self.known = max(1, every), [], {}
        from pyarrow import fs

        for info in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with self.store.open_input_stream(info.path) as f:
                    for line in f.read().splitlines():
                        r = json.loads(line)
                        self.known[r["prompt_key"]] = r["content"], r["attempts"], r["status"], r["error"]

    def keep(self, key: str, reply: tuple) -> None:
        self.known[key] = reply
        self.held.append(dict(zip(("prompt_key", "content", "attempts", "status", "error"), (key, *reply))))
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = "".join(json.dumps(r) + "\n" for r in self.held).encode()
            put(self.store, posixpath.join(self.folder, f"{uuid.uuid4().hex}.json"), data)
            self.held = []
