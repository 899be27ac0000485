"""Dense ids in a given order, without a global window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import work_dir

_ROW_BITS = (1 << 33) - 1


@dataclass
class Numbered:
    """Rows written in order, with the id before each partition's first row."""

    rows: DataFrame
    offsets: list[tuple[int, int]]
    count: int


def write_in_order(
    df: DataFrame, order_by: list[str | Column], path: str, ranges: tuple[int, Column] | None = None
) -> DataFrame:
    """Write ``df`` range-partitioned and sorted, with ``_part`` and ``_row``, and read it back.

    The pair is stored rather than recomputed: range bounds are sampled anew in every run, so
    only written rows keep their place when an executor is lost.  ``ranges`` names a number of
    partitions and each row's, in order, where the caller knows them; it saves the sampling.
    """
    placed = df.repartitionByRange(*order_by) if ranges is None else df.repartitionById(*ranges)
    ordered = (
        placed.sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    ordered.write.parquet(path)
    return df.sparkSession.read.schema(ordered.schema).parquet(path)


def number_written(rows: DataFrame, start: int = 0) -> Numbered:
    """Add ``id`` = ``start`` + 1, + 2, ... to rows of :func:`write_in_order`."""
    # One row per partition of the write, never per data row.
    sizes = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    offsets, last = [], start
    for part, size in sizes:
        offsets.append((part, last))
        last += size
    return Numbered(with_ids(rows, offsets), offsets, last - start)


def with_ids(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Turn ``_part`` and ``_row`` into ``id``; the broadcast table has one row per partition."""
    if len(offsets) == 1:
        placed = rows.withColumn("_before", F.lit(offsets[0][1]).cast("long"))
    else:
        table = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
        placed = rows.join(F.broadcast(table), "_part")
    numbered = placed.withColumn("id", F.col("_before") + F.col("_row") + 1)
    return numbered.drop("_part", "_row", "_before")


def assign_ids(
    df: DataFrame, order_by: list[str | Column], start: int = 0, path: str | None = None
) -> DataFrame:
    """``df`` with a dense ``id`` in the given order, continuing after ``start``.

    ``order_by`` should be a total order.  The ordered rows are written to ``path`` (a new folder
    in the shared scratch area by default) and the result reads them.
    """
    path = path or work_dir(df.sparkSession, "ids")
    numbered = number_written(write_in_order(df, order_by, path), start)
    return numbered.rows.select("id", *[c for c in df.columns if c != "id"])
