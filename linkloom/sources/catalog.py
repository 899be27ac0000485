"""The catalogue on Parquet: rows, patches and deletions, one folder for each write.

Layout below the root: ``rows``, ``patches`` and ``deletes``, each with folders
``write=<version>-<run>-<batch>``.  The version counts all writes of the catalogue, so that later
ones win whoever made them.  Run and batch name a write: the same pair written again, as after a
failure, replaces it under its old version; any other write is checked against all rows there
are.  :func:`compact_catalog` writes what readers see as a new catalogue.

Several writers at once: a write is prepared in ``_staging`` and committed by creating
``_commits/<version>``, which succeeds for one writer only.  One that finds its version taken
checks again, against what the other has committed, and takes the next.  Then the folder is moved to
its place; if the writer is lost in between, the next reader or writer moves it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.files import folder_names, move, put_new, read_text, remove
from linkloom.operators.catalog import catalog_patch, catalog_view, check_insert
from linkloom.schemas import CATALOG, PATCH

_DELETE = T.StructType([T.StructField("id", T.LongType())])
_PARTS = {"rows": CATALOG, "patches": PATCH, "deletes": _DELETE}
_WRITE = T.StructField("write", T.StringType())


def stored_schema(schema: T.StructType) -> T.StructType:
    """Schema of the files with the folder column ``write``."""
    return T.StructType([*schema.fields, _WRITE])


def create_catalog(spark: SparkSession, root: str) -> None:
    """Create an empty catalogue; an existing one is left alone."""
    for part, schema in _PARTS.items():
        empty = spark.createDataFrame([], schema)
        empty.write.mode("ignore").parquet(f"{root}/{part}/{_folder(0, 'create', 0)}")


def _folder(version: int, run: str, batch: int) -> str:
    return f"write={version:012d}-{run}-{batch}"


def _writes(spark: SparkSession, root: str, part: str) -> dict[tuple[str, int], int]:
    """Versions of the writes of a part by run and batch, from the names of the folders."""
    named = [n.removeprefix("write=").split("-") for n in folder_names(spark, f"{root}/{part}") if n.startswith("write=")]
    return {(run, int(batch)): int(version) for version, run, batch in named}


def _commits(spark: SparkSession, root: str) -> list[str]:
    return sorted(n for n in folder_names(spark, f"{root}/_commits") if n.isdecimal())


def _settle(spark: SparkSession, root: str) -> int:
    """Move what is committed but not in its place, and give the last version."""
    placed = {p: folder_names(spark, f"{root}/{p}") for p in _PARTS}
    versions = {int(n.removeprefix("write=").split("-")[0]) for names in placed.values() for n in names if n.startswith("write=")}
    commits = [int(n) for n in _commits(spark, root)]
    for version in commits:
        if version not in versions:
            commit = json.loads(read_text(spark, f"{root}/_commits/{version:012d}"))
            move(spark, f"{root}/_staging/{commit['staging']}", f"{root}/{commit['folder']}")
    return max([*versions, *commits], default=0)


def _write(
    df: DataFrame, root: str, part: str, run: str | None, batch: int, probe: Callable[[], None] = lambda: None
) -> int:
    """Commit one batch, again under its old version if it was there, and count its rows.

    ``probe`` raises if the batch may not be written; it is asked again whenever another writer was faster.
    """
    spark, run = df.sparkSession, run or uuid.uuid4().hex[:12]
    last = _settle(spark, root)
    probe()
    staging = f"{run}-{batch}-{uuid.uuid4().hex[:12]}"
    prepared = f"{root}/_staging/{staging}"
    df.write.parquet(prepared)
    count = spark.read.schema(df.schema).parquet(prepared).count()
    known = _writes(spark, root, part).get((run, batch))
    if known is not None:
        folder = f"{root}/{part}/{_folder(known, run, batch)}"
        remove(spark, folder)
        move(spark, prepared, folder)
        return count
    while True:
        folder = f"{part}/{_folder(last + 1, run, batch)}"
        commit = json.dumps({"staging": staging, "folder": folder})
        if put_new(spark, f"{root}/_commits/{last + 1:012d}", commit):
            break
        last = _settle(spark, root)
        try:
            probe()
        except ValueError:
            remove(spark, prepared)
            raise
    move(spark, prepared, f"{root}/{folder}")
    return count


def _version() -> F.Column:
    return F.substring("write", 1, 12).cast("long")


def _part(spark: SparkSession, root: str, part: str) -> DataFrame:
    """Rows of a part that no later deletion names, with ``version`` and ``write``."""
    _settle(spark, root)
    df = spark.read.schema(stored_schema(_PARTS[part])).parquet(f"{root}/{part}").withColumn("version", _version())
    if part == "deletes" or len(_writes(spark, root, "deletes")) < 2:  # the empty one alone
        return df
    gone = _part(spark, root, "deletes").groupBy("id").agg(F.max("version").alias("_gone"))
    kept = df.join(gone, "id", "left").filter(F.col("_gone").isNull() | (F.col("version") > F.col("_gone")))
    return kept.select(df.columns)


def catalog_rows(spark: SparkSession, root: str) -> DataFrame:
    """Inserted rows without patches, with their ``version`` and ``write``."""
    return _part(spark, root, "rows")


def catalog_patches(spark: SparkSession, root: str) -> DataFrame:
    """Patch rows with their ``version`` and ``write``."""
    return _part(spark, root, "patches")


def read_catalog(spark: SparkSession, root: str, ordered: bool = False) -> DataFrame:
    """All rows with their patches applied, as the reader sees them."""
    rows = catalog_rows(spark, root).drop("version", "write")
    # Patches of a later write win; inside a write their own seq decides.
    order = F.struct("version", "write", F.coalesce("seq", F.lit(0).cast("long"))).alias("seq")
    fields = [f.name for f in PATCH if f.name not in ("seq", "id")]
    patches = catalog_patches(spark, root).select(order, "id", *fields)
    view = catalog_view(catalog_patch(rows, patches))
    return view.orderBy("id") if ordered else view


def _others(df: DataFrame, run: str | None, batch: int) -> DataFrame:
    return df if run is None else df.filter(~F.col("write").endswith(f"-{run}-{batch}"))


def insert_rows(
    spark: SparkSession, root: str, rows: DataFrame, batch: int = 0, run: str | None = None
) -> int:
    """Insert catalogue rows as one batch, all of them or none and an error; how many there were.

    A repeated call for the same ``run`` and ``batch`` replaces the rows; without a ``run`` every
    call is a write of its own.  The probe reads the id column of the others, and of it only
    what lies between the smallest and the largest new id, which file statistics find.
    """
    low, high = rows.agg(F.min("id"), F.max("id")).first()

    def probe() -> None:
        present = _others(catalog_rows(spark, root), run, batch)
        if low is not None:
            present = present.filter(F.col("id").between(low, high))
        check_insert(present, rows)

    return _write(rows.select([f.name for f in CATALOG]), root, "rows", run, batch, probe)


def insert_patches(root: str, patches: DataFrame, batch: int = 0, run: str | None = None) -> int:
    """Add patch rows as one batch; how many rows of the catalogue they name."""
    columns = [
        (F.col(f.name) if f.name in patches.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PATCH
    ]
    spark, run = patches.sparkSession, run or uuid.uuid4().hex[:12]
    _write(patches.select(*columns), root, "patches", run, batch)
    named = catalog_patches(spark, root).filter(F.col("write").endswith(f"-{run}-{batch}"))
    return catalog_rows(spark, root).join(named.select("id"), "id", "left_semi").count()


def delete_rows(spark: SparkSession, root: str, ids: DataFrame, batch: int = 0, run: str | None = None) -> int:
    """Remove the rows with these ids, and their patches; how many rows that were.

    Ids may be inserted anew afterwards.  A repeated call for one ``run`` and ``batch`` says how
    many rows are left to remove.
    """
    doomed = ids.filter(F.col("id").isNotNull()).select(F.col("id").cast("long")).distinct()
    gone = catalog_rows(spark, root).join(doomed, "id", "left_semi").count()
    _write(doomed, root, "deletes", run, batch)
    return gone


def stored_elsewhere(spark: SparkSession, root: str, run: str, batch: int) -> DataFrame:
    """Ids that some other write has marked stored."""
    patches = _others(catalog_patches(spark, root), run, batch)
    return patches.filter(F.col("stored")).select("id")


def compact_catalog(spark: SparkSession, root: str, new_root: str) -> None:
    """Write what readers see, range-partitioned by id, as the only batch of a new catalogue."""
    create_catalog(spark, new_root)
    ordered = read_catalog(spark, root).repartitionByRange("id").sortWithinPartitions("id")
    _write(ordered, new_root, "rows", "compact", 0)
