"""Links of arriving pages, each URL once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.links import extract_links, filter_crawlable, nonempty_pages, with_link_array


#: URLs that a task remembers: as many of the latest, and as many of those before them.
_HELD = 100_000


class _Lately:
    """What a task has sent lately; a bounded number of it."""

    def __init__(self):
        self.recent: set = set()
        self.older: set = set()

    def new(self, key) -> bool:
        if key in self.recent:
            return False
        self.recent.add(key)  # one that comes again stays among the recent ones
        new = key not in self.older
        if len(self.recent) >= _HELD:
            self.recent, self.older = set(), self.recent
        return new


def _distinct_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lately = _Lately()
    for batch in batches:
        fresh = [url for url in pc.unique(batch.column(0)).to_pylist() if lately.new(url)]
        yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.string())], names=["url"])


def _distinct_per_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lately = _Lately()
    for batch in batches:
        keys = zip(batch.column("url").to_pylist(), batch.column("begin").to_pylist())
        yield batch.filter(pa.array([lately.new(key) for key in keys], pa.bool_()))


def stream_links(pages: DataFrame, base: str = "strict") -> DataFrame:
    """Streaming ``url``: crawlable links of the pages, deduped against all earlier ones.

    The state never expires, as nothing may be crawled twice; use the RocksDB state store for
    large ones.  ``dropDuplicates`` itself has no map-side step, so repeats of what a task has sent
    lately are dropped first: a URL that most pages carry does not flood one state partition.
    """
    links = filter_crawlable(extract_links(pages, base)).select("url")
    return links.mapInArrow(_distinct_per_task, "url string").dropDuplicates(["url"])


def window_links(pages: DataFrame, time: str, length: str, delay: str, base: str = "strict") -> DataFrame:
    """Streaming ``url, begin``: crawlable links of the pages, each once in each window of event time.

    ``time`` names a timestamp of ``pages``; windows are ``length`` long (``"1 hour"``) and ``begin`` is
    the start of one.  This is the bounded form of :func:`stream_links`: a window's URLs leave the
    state once the latest time seen is ``delay`` beyond its end.  Links that come later than that are
    dropped, and so are pages without a time.  As there, repeats within a task are dropped
    before the stateful step.
    """
    arrays = with_link_array(nonempty_pages(pages.select(F.col(time).alias("at"), "url", "html")), base)
    found = arrays.select("at", F.explode_outer("links").alias("url")).filter(F.col("url") != "")
    timed = filter_crawlable(found).select("url", "at", F.window("at", length).start.alias("begin"))
    once = timed.mapInArrow(_distinct_per_window, "url string, at timestamp, begin timestamp")
    # The watermark is declared on what the stateful step reads; Python code does not hand it on.
    windows = once.withWatermark("at", delay).select("url", F.window("at", length).alias("window"))
    return windows.dropDuplicates(["url", "window"]).select("url", F.col("window.start").alias("begin"))
