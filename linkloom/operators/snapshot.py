"""Seeds and page fetching against a snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.ids import assign_ids


def seed_frontier(
    spark: SparkSession,
    seeds: list[str] | DataFrame,
    order_by: list[str] | None = None,
    dedup: bool = True,
    path: str | None = None,
) -> DataFrame:
    """``id, url`` of the seeds, numbered from 1 in list order or by ``order_by``.

    Null and empty seeds fall out; no seeds at all is an error.  ``dedup=False`` keeps repeats.
    """
    if isinstance(seeds, DataFrame):
        if seeds.isEmpty():
            raise ValueError("no seed links")
        rows = seeds.withColumn("_at", F.struct(*(order_by or ["url"])))
    else:
        if not seeds:
            raise ValueError("no seed links")
        rows = spark.createDataFrame(list(enumerate(seeds)), "_at long, url string")
    rows = rows.filter(F.col("url").isNotNull() & (F.col("url") != "")).select("url", "_at")
    if dedup:
        rows = rows.groupBy("url").agg(F.min("_at").alias("_at"))
    return assign_ids(rows, ["_at"], path=path).select("id", "url")


def answered(pages: DataFrame) -> DataFrame:
    """Pages that count as fetched: with a body, and a 2xx status where there is ``status_code``."""
    if "status_code" in pages.columns:
        pages = pages.filter(F.col("status_code").between(200, 299))
    return pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))


def fetch_snapshot(frontier: DataFrame, pages: DataFrame, unique_urls: bool = False) -> DataFrame:
    """Frontier rows with the ``html`` of their page; URLs without an answered page give no row.

    Of several copies of a URL the answer is the one with a body and the smallest ``page_id``; a
    narrow aggregation finds it, so the copies' HTML never meets in one task.
    ``unique_urls=True`` says there are no copies and saves that step.
    """
    pages = answered(pages)
    if unique_urls:
        found = frontier.join(pages.select("url", "html"), "url")
    else:
        chosen = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
        hits = frontier.join(chosen, "url")
        found = hits.join(pages.select("page_id", "html"), "page_id").drop("page_id")
    return found.select(*frontier.columns, "html")


def fetch_misses(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows that :func:`fetch_snapshot` has no page for."""
    return frontier.join(answered(pages).select("url"), "url", "left_anti")
