"""Shared scratch folders under the cluster's checkpoint directory.

Queries that need files (the file sources, the file sinks, streaming) write
them with Spark into ``spark.checkpoint.dir`` - the shared folder every
executor can reach - never into a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from docweave.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/docweave-{name}-{uuid.uuid4().hex[:12]}"
