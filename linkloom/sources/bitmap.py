"""A seen map that lasts: the bit map of ``bloom_dedup`` on disk, grown batch by batch.

The map is cut into bitmaps of 32,768 places.  Each batch writes the bitmaps of the bits that it was the
first to set, bucketed by bitmap, so a later batch meets them where they lie: only the batch's own
bits are moved.  Readers merge the batches' bitmaps.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.files import folder_names, put_new, read_text, remove
from linkloom.functions.hashing import bit_positions
from linkloom.operators.dedup import EXPECTED_URLS, FALSE_POSITIVES, bloom_mask
from linkloom.scratch import written

_PLACES = 1 << 15  # of one bitmap, as Spark's functions cut them
_BITMAPS_PER_FILE = 4096  # sixteen megabytes


def create_bit_table(
    spark: SparkSession, path: str, num_bits: int | None = None, mask: int | None = None,
    expected: int = EXPECTED_URLS, fpp: float = FALSE_POSITIVES,
) -> None:
    """An empty map of the size that ``bloom_dedup`` would take; one that is there must be of that size."""
    mask = bloom_mask(num_bits, mask, expected, fpp)
    files = -(-(mask + 1) // (_PLACES * _BITMAPS_PER_FILE))
    if not put_new(spark, f"{path}/map", json.dumps({"mask": mask, "files": files})) and _size(spark, path)["mask"] != mask:
        raise ValueError(f"{path} holds a map of another size")


def _size(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/map"))


def _batches(spark: SparkSession, path: str) -> list[str]:
    return [name for name in folder_names(spark, f"{path}/bitmaps") if name.startswith("batch=")]


@contextmanager
def _bitmaps(spark: SparkSession, path: str, files: int) -> Iterator[str]:
    """The written bitmaps as a bucketed table of this session."""
    database = f"linkloom_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}/tables-{database}'")
    try:
        spark.sql(
            f"CREATE TABLE {database}.bitmaps (bucket BIGINT, bitmap BINARY, batch INT) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (bucket) INTO {files} BUCKETS LOCATION '{path}/bitmaps'"
        )
        if _batches(spark, path):
            spark.sql(f"ALTER TABLE {database}.bitmaps RECOVER PARTITIONS")
        yield f"{database}.bitmaps"
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def known_bits(bitmaps: DataFrame, bits: DataFrame) -> DataFrame:
    """``bit`` of those of ``bits`` (``bit, bucket, place``) that are set in any of the bitmaps.

    The hash table is built on ``bits``; the bitmaps stream by in their buckets.
    """
    byte = F.expr("cast(conv(hex(substring(bitmap, cast(place div 8 as int) + 1, 1)), 16, 10) as int)")
    met = bitmaps.join(bits.select("bit", "bucket", "place").hint("shuffle_hash"), "bucket")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0
    return met.filter(is_set).select("bit").distinct()


def bit_table_dedup(df: DataFrame, path: str, batch: int, url: str = "url", seq: str = "seq") -> DataFrame:
    """``df`` with ``is_duplicate``, and its bits added to the map at ``path`` as ``batch``.

    All rows of earlier batches, those with smaller numbers, come before these; inside the batch ``seq`` decides.
    Batches one after the other flag what ``bloom_dedup`` over all of them would.  The same batch
    again, as after a failure, sees what it saw and replaces what it wrote.  ``df`` is read
    twice, so hand over a written table rather than a costly plan.
    """
    spark = df.sparkSession
    size = _size(spark, path)
    bits = df.select(F.col(seq).alias("first"), F.explode(bit_positions(F.col(url), size["mask"])).alias("bit"))
    bits = bits.groupBy("bit").agg(F.min("first").alias("first"))
    place = F.col("bit") + 1  # the functions count from one
    bits = bits.withColumns({"bucket": F.bitmap_bucket_number(place), "place": F.bitmap_bit_position(place)})
    bits = written(bits, "bits")
    with _bitmaps(spark, path, size["files"]) as table:
        known = known_bits(spark.table(table).filter(F.col("batch") < batch).drop("batch"), bits)
        fresh = written(bits.join(known.hint("shuffle_hash"), "bit", "left_anti"), "bits")
        remove(spark, f"{path}/bitmaps/batch={batch}")
        own = fresh.repartition(size["files"], "bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
        writer = own.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch")
        writer.bucketBy(size["files"], "bucket").option("path", f"{path}/bitmaps").saveAsTable(table)
    new = fresh.select(F.col("first").alias(seq)).distinct().withColumn("_new", F.lit(True))
    return df.join(new, seq, "left").withColumn("is_duplicate", F.col("_new").isNull()).drop("_new")


def read_bit_table(spark: SparkSession, path: str) -> DataFrame:
    """``bucket, bitmap`` of the whole map: the batches' bitmaps merged."""
    if not _batches(spark, path):
        return spark.createDataFrame([], "bucket long, bitmap binary")
    rows = spark.read.schema("bucket long, bitmap binary, batch int").parquet(f"{path}/bitmaps")
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bit_table_fill(spark: SparkSession, path: str) -> DataFrame:
    """``bits_set`` and ``fill``, the share of the map's places, of a stored map; see ``bloom_fill``."""
    places = 1 << bin(_size(spark, path)["mask"]).count("1")
    count = read_bit_table(spark, path).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("bits_set"))
    return count.withColumn("fill", F.col("bits_set") / places)
