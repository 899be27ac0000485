"""Schemas of the tables and the description of a crawl job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("stored", T.BooleanType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.IntegerType()),
        T.StructField("create_time", T.TimestampNTZType()),
        T.StructField("update_time", T.TimestampNTZType()),
    ]
)

PATCH = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("id", T.LongType())]
    + [T.StructField(f.name, f.dataType) for f in CATALOG if f.name != "id"]
)

RAWDOC = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("html", T.StringType()),
    ]
)

# Fixed values of the raw-record files.
FIELD_SEPARATOR = 0x1F
RECORD_SEPARATOR = 0x1E
FILE_END = 0x17
FILE_PREFIX = "doc_raw_"
FILE_SUFFIX = ".bin"
MAX_FILE_SIZE = 1024 * 1024 * 1024


@dataclass
class CrawlSpec:
    """One crawl job."""

    links: list[str] = field(default_factory=list)
    task_id: str | None = None
    task_name: str | None = None
    crawl_quantity: int | None = None
    save_directory: str | None = None
    max_file_size: int | None = MAX_FILE_SIZE
    file_prefix: str | None = None
    file_suffix: str | None = None
