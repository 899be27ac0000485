"""Catalogue rows and catalogue maintenance as DataFrame operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.html import title_of
from linkloom.functions.urls import host_of
from linkloom.schemas import CATALOG

_FIELDS = [f.name for f in CATALOG if f.name != "id"]
_BLOCKS = 4096


def _moment(as_of: dt.datetime | Column | None) -> Column:
    if as_of is None:
        return F.localtimestamp()
    value = as_of if isinstance(as_of, Column) else F.lit(as_of.isoformat(sep=" "))
    return value.cast("timestamp_ntz")


def _typed(columns: dict[str, Column]) -> list[Column]:
    return [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOG
    ]


def link_rows(entries: DataFrame, as_of: dt.datetime | Column | None = None) -> DataFrame:
    """Catalogue rows of frontier entries: ``id``, ``url``, not stored, created ``as_of``."""
    return entries.select(
        *_typed(
            {
                "id": F.col("id"),
                "url": F.col("url"),
                "stored": F.lit(False),
                "create_time": _moment(as_of),
            }
        )
    )


def page_patches(
    pages: DataFrame, as_of: dt.datetime | Column | None = None, stored: bool = True
) -> DataFrame:
    """Patch rows of stored pages: title, UTF-8 length, ``stored`` and update time by ``id``."""
    page_id = "id" if "id" in pages.columns else "page_id"
    full = pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))
    return full.select(
        F.col(page_id).cast("long").alias("id"),
        F.expr(title_of("html")).alias("title"),
        F.octet_length("html").alias("content_length"),
        F.lit(stored).alias("stored"),
        _moment(as_of).alias("update_time"),
    )


def catalog_view(catalog: DataFrame) -> DataFrame:
    """Reader's view: null ``status_code`` and ``content_length`` read as 0, ``stored`` as false."""
    return (
        catalog.withColumn("status_code", F.coalesce("status_code", F.lit(0)))
        .withColumn("content_length", F.coalesce("content_length", F.lit(0)))
        .withColumn("stored", F.coalesce("stored", F.lit(False)))
    )


def derive_domain(catalog: DataFrame) -> DataFrame:
    """Fill ``domain`` with the host of ``url``."""
    return catalog.withColumn("domain", host_of(F.col("url")))


def catalog_get(catalog: DataFrame, doc_id: int) -> DataFrame:
    """The row with this id, if there is one."""
    return catalog.filter(F.col("id") == doc_id)


def _id_at_rank(catalog: DataFrame, rank: int, low: int, high: int) -> int | None:
    """The ``rank``-th smallest id (from 1), or ``None`` if there are fewer rows.

    Every pass counts the rows of at most 4,096 id ranges and goes on inside the right one, so
    10^12 ids take four passes over ever fewer rows of the id column.
    """
    before = 0
    while True:
        width = max(1, -(-(high - low + 1) // _BLOCKS))
        counts = (
            catalog.filter(F.col("id").between(low, high))
            .groupBy(F.expr(f"(id - {low}L) div {width}L").alias("block"))
            .count()
            .collect()
        )
        for block, count in sorted((r["block"], r["count"]) for r in counts):
            if before + count >= rank:
                break
            before += count
        else:
            return None
        if width == 1:
            return low + block
        low, high = low + block * width, min(high, low + (block + 1) * width - 1)


def _page_numbers(page: int, size: int) -> int:
    if page < 1 or size < 0:
        raise ValueError("page counts from 1 and size must not be negative")
    return (page - 1) * size


def catalog_page(catalog: DataFrame, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows by id: a top-k over the rows up to its end.

    For pages deep in a large catalogue :func:`deep_page` sorts the page alone.
    """
    skip = _page_numbers(page, size)
    return catalog.orderBy("id").offset(skip if size else 0).limit(size)


def deep_page(catalog: DataFrame, page: int, size: int) -> DataFrame:
    """The same page, wherever it lies: its id bounds are found by counting id ranges, now.

    Only the rows between the bounds are sorted when the result is read; ids must be unique and
    the catalogue must not change in between.
    """
    skip = _page_numbers(page, size)
    low, high = catalog.agg(F.min("id"), F.max("id")).first()
    first = None if low is None or not size else _id_at_rank(catalog, skip + 1, low, high)
    if first is None:
        return catalog.limit(0)
    last = _id_at_rank(catalog, skip + size, low, high)
    return catalog.filter(F.col("id").between(first, high if last is None else last)).orderBy("id")


def catalog_count(catalog: DataFrame) -> DataFrame:
    """Number of rows as ``total``."""
    return catalog.agg(F.count(F.lit(1)).alias("total"))


def crawl_progress(catalog: DataFrame) -> DataFrame:
    """``processed`` (stored) rows, ``total`` rows and ``percent`` to two decimals; null if empty."""
    counts = catalog.agg(
        F.count_if(F.coalesce("stored", F.lit(False))).alias("processed"),
        F.count(F.lit(1)).alias("total"),
    )
    share = F.round(F.col("processed") * 100.0 / F.nullif(F.col("total"), F.lit(0)), 2)
    return counts.withColumn("percent", share)


def merge_patches(patches: DataFrame) -> DataFrame:
    """One patch per id: the last non-null value of each field by ``seq``; ``stored`` only rises.

    Patches without an id fall out.  Rows of one id are combined map-side first.
    """
    fields = [c for c in _FIELDS if c in patches.columns]
    known = patches.filter(F.col("id").isNotNull())
    if "seq" not in known.columns:
        known = known.withColumn("seq", F.lit(0).cast("long"))

    def last(name: str) -> Column:
        value = F.col(name)
        order = F.when(value.isNotNull(), F.col("seq"))
        return F.max_by(value, order).alias(name)

    return known.groupBy("id").agg(
        *[
            F.coalesce(F.bool_or("stored"), F.lit(False)).alias("stored") if c == "stored" else last(c)
            for c in fields
        ]
    )


def catalog_patch(catalog: DataFrame, patches: DataFrame, one_per_id: bool = False) -> DataFrame:
    """Update by id: non-null fields overwrite, ``stored`` only turns true, unknown ids do nothing.

    ``one_per_id=True`` says that no id repeats and skips the merge.  The patch side is broadcast
    only if its runtime size allows.
    """
    patch = patches.filter(F.col("id").isNotNull()) if one_per_id else merge_patches(patches)
    fields = [c for c in _FIELDS if c in patch.columns]
    patch = patch.select("id", *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = catalog.join(patch, "id", "left")

    def value(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        if name == "stored":
            return F.coalesce("stored", F.lit(False)) | F.coalesce("_p_stored", F.lit(False))
        return F.coalesce(f"_p_{name}", name)

    return joined.select("id", *[value(c).alias(c) for c in catalog.columns if c != "id"])


def catalog_delete(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalogue without the rows whose id is in ``ids``."""
    return catalog.join(ids.select("id"), "id", "left_anti")


def deleted_count(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """How many rows :func:`catalog_delete` takes away, as ``deleted``."""
    return catalog.join(ids.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def insert_conflicts(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of ``batch`` that are null, repeated in the batch, or present in the catalogue."""
    repeated = batch.groupBy("id").count().filter((F.col("count") > 1) | F.col("id").isNull()).select("id")
    present = batch.select("id").join(catalog.select("id"), "id", "left_semi")
    return repeated.unionByName(present)


def check_insert(catalog: DataFrame, batch: DataFrame) -> None:
    """Raise ``ValueError`` if the batch cannot be inserted as a whole."""
    found = insert_conflicts(catalog, batch).limit(5).collect()
    if found:
        raise ValueError(f"ids missing, repeated or already present, e.g. {[r['id'] for r in found]}")


def catalog_insert(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """Catalogue with the batch added; all rows or, on any id conflict, an error and none."""
    check_insert(catalog, batch)
    return catalog.unionByName(batch.select(*catalog.columns))


def pending_docs(catalog: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """``id, url`` of the rows not yet stored, optionally of an inclusive id range; gaps are fine."""
    todo = catalog.filter(~F.coalesce("stored", F.lit(False)))
    if low is not None:
        todo = todo.filter(F.col("id") >= low)
    if high is not None:
        todo = todo.filter(F.col("id") <= high)
    return todo.select("id", "url")
