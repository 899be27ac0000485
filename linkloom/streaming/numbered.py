"""Pages in, numbered links out: new links of a stream get dense ids and are recorded."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.files import put_new, read_text, remove
from linkloom.operators.catalog import link_rows
from linkloom.operators.dedup import dedup_links
from linkloom.operators.ids import number_written, write_in_order
from linkloom.operators.links import extract_links, filter_crawlable
from linkloom.scratch import work_dir
from linkloom.sources.catalog import create_catalog, insert_rows
from linkloom.streaming.store import start_batches

_NUMBERED = "url string, src_id long, pos int, _part int, _row long, batch int"


def number_stream(
    pages: DataFrame,
    root: str,
    base: str = "strict",
    checkpoint: str | None = None,
    as_of: dt.datetime | Column | None = None,
    trigger: dict[str, Any] | None = None,
    start: int = 0,
    seen: DataFrame | None = None,
) -> StreamingQuery:
    """Record the crawlable links of a stream of pages (``page_id, url, html``) that are new.

    Each URL gets one id when it is first linked; ids go on after ``start`` without gaps, by
    micro-batch and inside it by page and place.  URLs of ``seen`` (``url``) get none.  What was numbered,
    and the last id of each micro-batch, lie in the ``checkpoint``.  A micro-batch that is replayed, wherever the one
    before it broke off, finds the same counter and the same earlier links, so it writes the
    same ids, and its insert replaces the one that may be there.
    """
    spark = pages.sparkSession
    create_catalog(spark, root)
    checkpoint = checkpoint or work_dir(spark, "stream")
    state = f"{checkpoint}/numbered"
    if read_text(spark, f"{state}/marks/start") is None:
        if seen is not None:
            seen.select("url").distinct().write.mode("overwrite").parquet(f"{state}/known")
        put_new(spark, f"{state}/marks/start", json.dumps({"last": start, "known": seen is not None}))

    def number_new(batch: DataFrame, number: int, run: str) -> None:
        session = batch.sparkSession
        begun = json.loads(read_text(session, f"{state}/marks/start"))
        last = _last_id(session, state, number, begun)
        # Used three times below; written, so that the pages are read once.
        found = dedup_links(filter_crawlable(extract_links(batch, base)))
        path = f"{state}/found"
        found.write.mode("overwrite").parquet(path)
        first = session.read.schema(found.schema).parquet(path)
        earlier = session.createDataFrame([], "url string")
        if begun["known"]:
            earlier = session.read.schema("url string").parquet(f"{state}/known")
        if number:
            rows = session.read.schema(_NUMBERED).parquet(f"{state}/links")
            earlier = earlier.union(rows.filter(F.col("batch") < number).select("url"))
        # The hash tables are built on the micro-batch; what was seen streams by unsorted.
        known = earlier.join(first.select("url").hint("shuffle_hash"), "url", "left_semi")
        fresh = first.join(known.distinct().hint("shuffle_hash"), "url", "left_anti")
        path = f"{state}/links/batch={number}"
        remove(session, path)  # what a run that ended in the midst of it has left
        numbered = number_written(write_in_order(fresh, ["src_id", "pos"], path), last)
        rows = link_rows(numbered.rows.select("id", "url"), as_of)
        insert_rows(session, root, rows, number, run)
        put_new(session, f"{state}/marks/batch-{number}", json.dumps({"last": last + numbered.count}))

    return start_batches(pages, number_new, checkpoint, trigger)


def _last_id(spark, state: str, number: int, begun: dict) -> int:
    """The last id before micro-batch ``number``."""
    if number == 0:
        return begun["last"]
    mark = read_text(spark, f"{state}/marks/batch-{number - 1}")
    if mark is None:
        raise ValueError(f"micro-batch {number} follows one that has no mark in {state}")
    return json.loads(mark)["last"]
