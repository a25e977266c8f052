"""Folders for what jobs keep between their steps."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or _own()).rstrip('/')}/ledgerlake-{tag}-{uuid.uuid4().hex}"
