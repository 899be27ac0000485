"""A whole crawl job: expand the frontier, record it, store the pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from linkloom.plans.crawl import CrawlResult, crawl
from linkloom.schemas import CrawlSpec
from linkloom.streaming.store import drain, store_stream


def run_job(
    spark: SparkSession,
    spec: CrawlSpec,
    pages: DataFrame,
    base: str = "strict",
    should_stop: Callable[[], bool] = lambda: False,
    as_of: dt.datetime | Column | None = None,
    unique_urls: bool = False,
    **rawdoc_options: Any,
) -> CrawlResult:
    """Crawl as ``spec`` says, into ``save_directory``: ``catalog`` and ``raw`` below it.

    ``should_stop`` is asked between levels, and then between the micro-batches of storing, of
    which each takes one level; what was stored stays.  To store while the crawl still runs, start
    :func:`store_stream` on the catalogue yourself with a ``processingTime`` trigger; here it
    drains the catalogue once the crawl has ended.
    """
    if not spec.save_directory:
        raise ValueError("the job has no save_directory")
    catalog_root = f"{spec.save_directory}/catalog"
    result = crawl(
        spark, spec, pages, base, should_stop=should_stop, unique_urls=unique_urls,
        catalog_root=catalog_root, as_of=as_of,
    )
    if not should_stop():
        drain(store_stream(
            spark, catalog_root, pages, f"{spec.save_directory}/raw",
            checkpoint=f"{spec.save_directory}/checkpoint", as_of=as_of, unique_urls=unique_urls,
            max_file_size=spec.max_file_size, file_prefix=spec.file_prefix,
            file_suffix=spec.file_suffix, should_stop=should_stop,
            **({"max_files_per_trigger": 1} | rawdoc_options),
        ))
    return result
