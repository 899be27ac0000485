"""Shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="linkloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)  # a local session's work ends with it
    return root


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Where the setting is missing a local session gets a temporary folder; a cluster session is
    an error, because executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to a new scratch folder and read back: computed once, with short lineage."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
