"""Streams into the catalogue: recording links and storing pages.

Every micro-batch writes under its number and the run that its checkpoint belongs to, so a batch
that is replayed after a failure replaces what it had written, and nothing that another run wrote.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.files import lasting_id
from linkloom.operators.catalog import link_rows, page_patches
from linkloom.operators.snapshot import fetch_snapshot
from linkloom.schemas import CATALOG
from linkloom.scratch import work_dir
from linkloom.sources.catalog import (
    create_catalog,
    insert_patches,
    insert_rows,
    stored_elsewhere,
    stored_schema,
)
from linkloom.sources.rawdocs import without_separators, write_rawdocs


class Stopped(Exception):
    """A stream was asked to stop between two micro-batches."""


def drain(query: StreamingQuery) -> bool:
    """Wait for a stream to end; whether it took all there was, or stopped when asked to."""
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if Stopped.__name__ not in str(error):
            raise
        return False
    return True


def start_batches(stream: DataFrame, each: Callable, checkpoint: str | None, trigger: dict[str, Any] | None):
    """Start ``each(batch, number, run)`` on the stream; the run's id lies in the checkpoint."""
    spark = stream.sparkSession
    checkpoint = checkpoint or work_dir(spark, "stream")
    run = lasting_id(spark, f"{checkpoint}/run")
    return (
        stream.writeStream.foreachBatch(lambda batch, number: each(batch, number, run))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def record_stream(
    entries: DataFrame,
    root: str,
    checkpoint: str | None = None,
    as_of: dt.datetime | Column | None = None,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Record a stream of ``id, url`` in the catalogue, one insert per micro-batch.

    The batch size is the source's (``maxFilesPerTrigger`` and the like); the default trigger
    takes all that is there, the rest included, and ends.  Without a ``checkpoint`` each call is a
    run of its own; entries that are in the catalogue already are then an error.
    """
    create_catalog(entries.sparkSession, root)

    def record(batch: DataFrame, number: int, run: str) -> None:
        rows = link_rows(batch, as_of).persist()
        try:
            insert_rows(batch.sparkSession, root, rows, number, run)
        finally:
            rows.unpersist()

    return start_batches(entries, record, checkpoint, trigger)


def store_stream(
    spark: SparkSession,
    root: str,
    pages: DataFrame,
    path: str,
    checkpoint: str | None = None,
    as_of: dt.datetime | Column | None = None,
    trigger: dict[str, Any] | None = None,
    max_files_per_trigger: int | None = None,
    unique_urls: bool = False,
    should_stop: Callable[[], bool] = lambda: False,
    **rawdoc_options: Any,
) -> StreamingQuery:
    """Follow the catalogue: fetch the pages of new rows, write raw records, patch the rows.

    Records of micro-batch ``n`` lie in ``path/run=<run>/batch=n``.  Rows that any earlier run has
    stored are passed over.  ``should_stop`` is asked before each micro-batch; once it is true, the
    rest of the rows is left for a later call with the same ``checkpoint``.  The patches are written
    after the records, from the same fetched pages, so ``stored`` means what is on disk.
    Each micro-batch scans the snapshot's URLs; prefer few large ones.
    """
    create_catalog(spark, root)
    reader = spark.readStream.schema(stored_schema(CATALOG))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(f"{root}/rows")

    def store(batch: DataFrame, number: int, run: str) -> None:
        if should_stop():
            raise Stopped
        session = batch.sparkSession
        done = stored_elsewhere(session, root, run, number)
        todo = (
            batch.filter(~F.coalesce("stored", F.lit(False)))
            .select("id", "url")
            .join(done, "id", "left_anti")
            .persist()
        )
        fetched = fetch_snapshot(todo, pages, unique_urls)
        if rawdoc_options.get("on_separator") == "strip":
            fetched = fetched.withColumn("html", without_separators(F.col("html")))
        fetched = fetched.persist()  # its HTML is moved once, for the records and the patches
        try:
            folder = f"{path}/run={run}/batch={number}"
            write_rawdocs(fetched, folder, mode="overwrite", ids=todo, **rawdoc_options)
            insert_patches(root, page_patches(fetched, as_of), number, run)
        finally:
            fetched.unpersist()
            todo.unpersist()

    return start_batches(rows, store, checkpoint, trigger)
