"""Breadth-first expansion of a frontier over a page snapshot.

The HTML is read once: every page is reduced to its distinct crawlable links, written bucketed
by URL.  Each level then joins the small frontier to that table without moving it, keeps the
first occurrence of each URL, and drops the seen ones by an anti-join against a table with the
same buckets; neither is sorted.  A bucket is one file of links, and a few of seen URLs: what the levels
added is merged now and then.  All levels are written, so lineage stays short and a lost executor costs one stage.

With ``state`` a crawl can be finished later.  A mark beside each level says that it is written
and recorded whole; the last marked level is the frontier that is known but not expanded.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.files import folder_names, lasting_id, put_new, read_text, remove
from linkloom.functions.urls import is_crawlable
from linkloom.operators.catalog import link_rows
from linkloom.operators.ids import Numbered, number_written, with_ids, write_in_order
from linkloom.operators.links import nonempty_pages, with_link_array
from linkloom.operators.snapshot import answered, seed_frontier
from linkloom.schemas import CrawlSpec
from linkloom.scratch import work_dir
from linkloom.sources.catalog import catalog_rows, create_catalog, insert_rows

_MAX_BUCKETS = 100_000
_BUCKET_BYTES = 4 << 20  # of link text
_SEEN_RUNS = 6  # levels in files of their own; beyond that they are merged
_PARENTS_PER_TASK = 20_000  # whose new links one task sorts
_LEVEL = "url string, parent_id long, pos long, _part int, _row long, depth int"


@dataclass
class CrawlResult:
    """``frontier``: ``id, url, depth, parent_id, pos``; ``levels``: rows per depth."""

    frontier: DataFrame
    levels: list[int]


def outlinks(pages: DataFrame, base: str = "strict", unique_urls: bool = False) -> DataFrame:
    """One row per URL: ``url, links`` with its distinct crawlable links in page order.

    Of several copies of a URL the one with the smallest ``page_id`` counts, as in
    ``fetch_snapshot``; it is found on two narrow columns, so no link array is sorted.
    """
    pages = nonempty_pages(answered(pages).select("page_id", "url", "html"))
    kept = F.array_distinct(F.filter("links", is_crawlable))
    linked = with_link_array(pages, base).select("page_id", "url", kept.alias("links"))
    if unique_urls:
        return linked.select("url", "links")
    chosen = pages.groupBy("url").agg(F.min("page_id").alias("_first"))
    # "<=" is "=" here, but leaves the join, and so the rows' places, to the URL alone.
    found = linked.join(chosen.hint("shuffle_hash"), "url").filter("page_id <= _first")
    return found.select("url", "links")


def limit_crawl(frontier: DataFrame, quantity: int) -> DataFrame:
    """The first ``quantity`` entries; ids are dense, so this is a filter."""
    return frontier.filter(F.col("id") <= quantity)


def crawl(
    spark: SparkSession,
    seeds: list[str] | DataFrame | CrawlSpec,
    pages: DataFrame,
    base: str = "strict",
    quantity: int | None = None,
    max_depth: int | None = None,
    should_stop: Callable[[], bool] = lambda: False,
    seeds_seen: bool = True,
    unique_urls: bool = False,
    catalog_root: str | None = None,
    as_of: dt.datetime | Column | None = None,
    path: str | None = None,
    buckets: int | None = None,
    start: int = 0,
    seen: DataFrame | None = None,
    state: str | None = None,
) -> CrawlResult:
    """Expand from the seeds until a level brings nothing new.

    Ids follow ``(depth, parent_id, pos)``, the order of one FIFO worker.  The loop also ends at
    ``max_depth``, at ``quantity`` ids, or when ``should_stop()`` is true between levels.
    ``seeds_seen=False`` neither dedups the seeds nor marks them seen.  With ``catalog_root``
    every level is recorded there as a batch of this crawl's run; ids that it would give but that
    are there already are an error before anything is written.  To go on in a catalogue, hand over
    its last id as ``start`` and what an earlier crawl has seen (``url``) as ``seen``: neither is
    given out again; known URLs are not expanded.  Everything is written below ``path`` (by default a new folder in the shared
    scratch area).  ``buckets`` cuts the link and seen tables, by default as the pages are many.

    ``state`` names a lasting folder instead.  A crawl that ended there early, for whatever reason, a crash
    included, is taken up by the next call with it: levels written whole stay with their ids, an
    unfinished one is done anew, and the last one is expanded.  Links come from the pages of the
    first call, as do seeds, ``start`` and ``seen``; the limits of each call bound all levels
    together.  However often it was stopped, the rows are those of one crawl.
    """
    marks = _marks(spark, state) if state else {}
    if catalog_root is not None:
        create_catalog(spark, catalog_root)
    if catalog_root is not None and "level-0" not in marks:
        others = catalog_rows(spark, catalog_root)
        if state:  # this crawl may have got as far as its first level
            others = others.filter(~F.col("write").contains(f"-{lasting_id(spark, f'{state}/run')}-"))
        last = others.agg(F.max("id")).first()[0]
        if last is not None and last > start:
            raise ValueError(f"the catalogue holds ids up to {last}, already present; start after them")
    if isinstance(seeds, CrawlSpec):
        quantity = seeds.crawl_quantity if quantity is None else quantity
        seeds = seeds.links
    path = state or path or work_dir(spark, "crawl")
    database = f"linkloom_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}/tables-{database}'")
    try:
        buckets, found = marks.get("outlinks", {}).get("buckets") or buckets, None
        if "outlinks" not in marks:
            # Written first as they are found, so that their size tells the buckets.
            found = _written_links(outlinks(pages, base, unique_urls), f"{path}/page-links")
            buckets = buckets or _buckets_for(found)
        start = marks.get("level-0", {}).get("start", start)
        run = _Crawl(spark, path, database, buckets, quantity, catalog_root, as_of, start, state is not None)
        if "level-0" in marks:
            run.restore(marks)
        else:
            remove(spark, f"{path}/seeds")
            run.start(seed_frontier(spark, seeds, dedup=seeds_seen, path=f"{path}/seeds"), seeds_seen, seen)
        if found is None:
            run.find_outlinks()
        else:
            run.save_outlinks(found)
            remove(spark, f"{path}/page-links")
        while not run.done and not should_stop() and (max_depth is None or run.depth < max_depth):
            run.next_level()
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    return CrawlResult(run.frontier(), run.levels)


def _marks(spark: SparkSession, state: str) -> dict[str, dict]:
    """What is done of a crawl, by name: the links, and each level."""
    names = [n for n in folder_names(spark, f"{state}/marks") if not n.startswith(("_", "."))]
    return {n: json.loads(read_text(spark, f"{state}/marks/{n}")) for n in names}


def _written_links(links: DataFrame, path: str) -> DataFrame:
    links.write.mode("overwrite").parquet(path)
    return links.sparkSession.read.schema(links.schema).parquet(path)


def _buckets_for(links: DataFrame) -> int:
    size = F.octet_length("url") + F.octet_length(F.concat_ws(" ", "links"))
    return max(1, min(_MAX_BUCKETS, -(-(links.agg(F.sum(size.cast("long"))).first()[0] or 0) // _BUCKET_BYTES)))


class _Crawl:
    """State of one crawl: paths and one number per written partition, no rows."""

    def __init__(self, spark, path, database, buckets, quantity, catalog_root, as_of, start, lasting):
        self.spark, self.path, self.buckets, self.quantity = spark, path, buckets, quantity
        self.links_table, self.seen_table = f"{database}.outlinks", f"{database}.seen_0"
        self.seen_runs, self.merges = 0, 0
        self.catalog_root, self.as_of = catalog_root, as_of
        self.before, self.lasting = start, lasting
        self.run = lasting_id(spark, f"{path}/run") if lasting else uuid.uuid4().hex[:12]
        self.last = None if quantity is None else start + quantity
        self.levels: list[int] = []
        self.offsets: list[tuple[int, int, int]] = []
        self.current: DataFrame | None = None

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    @property
    def done(self) -> bool:
        full = self.quantity is not None and sum(self.levels) >= self.quantity
        return full or self.levels[-1] == 0

    def _append(self, df: DataFrame, table: str, *partition: str, path: str | None = None) -> None:
        writer = df.write.mode("append").bucketBy(self.buckets, "url")
        writer = writer.option("path", path) if path else writer
        (writer.partitionBy(*partition) if partition else writer).saveAsTable(table)

    def _mark(self, name: str, **what) -> None:
        if self.lasting:
            put_new(self.spark, f"{self.path}/marks/{name}", json.dumps(what))

    def _add_seen(self, rows: DataFrame) -> None:
        """Add ``url, parent_id, pos, depth`` of one depth: one file a bucket, if the rows lie by URL."""
        self._append(rows, self.seen_table, "depth")
        self.seen_runs += 1

    def _add_known(self, urls: DataFrame) -> None:
        none = F.lit(None).cast("long")
        earlier = urls.select("url", none.alias("parent_id"), none.alias("pos"), F.lit(-1).alias("depth"))
        self._add_seen(earlier.repartition(self.buckets, "url"))

    def _merge_seen(self) -> None:
        """Put what is seen into one file a bucket; the levels themselves are written elsewhere."""
        if self.seen_runs <= _SEEN_RUNS:
            return
        old, self.merges, self.seen_runs = self.seen_table, self.merges + 1, 0
        self.seen_table = f"{old.rpartition('_')[0]}_{self.merges}"
        self._add_known(self.spark.table(old))
        self.spark.sql(f"DROP TABLE {old}")

    def start(self, seeds: DataFrame, keep: bool, seen: DataFrame | None) -> None:
        none = F.lit(None)
        level = seeds.select("url", none.cast("long").alias("parent_id"), (F.col("id") - 1).alias("pos"))
        if seen is not None:
            known = seen.select("url").distinct()
            if self.lasting:
                known.write.mode("overwrite").parquet(f"{self.path}/known")
                known = self.spark.read.schema("url string").parquet(f"{self.path}/known")
            level = level.join(known, "url", "left_anti")
            self._add_known(known)
        self._add_seen(level.filter(F.lit(keep)).withColumn("depth", F.lit(0)).repartition(self.buckets, "url"))
        self._add_level(level, start=self.before, keep=keep, known=seen is not None)

    def restore(self, marks: dict[str, dict]) -> None:
        """Take up the marked levels: their ids, and from their rows the seen table."""
        if marks["level-0"]["known"]:
            self._add_known(self.spark.read.schema("url string").parquet(f"{self.path}/known"))
        depths = sum(name.startswith("level-") for name in marks)
        rows = self.spark.read.schema(_LEVEL).parquet(f"{self.path}/levels").filter(F.col("depth") < depths)
        seen = rows if marks["level-0"]["keep"] else rows.filter("depth > 0")
        self._add_known(seen)
        for depth in range(depths):
            path, mark = f"{self.path}/levels/depth={depth}", marks[f"level-{depth}"]
            schema = ", ".join(c for c in _LEVEL.split(", ") if not c.startswith("depth"))
            placed = self.spark.read.schema(schema).parquet(path)
            self._take(depth, Numbered(with_ids(placed, mark["offsets"]), mark["offsets"], mark["count"]))

    def save_outlinks(self, links: DataFrame) -> None:
        placed = links.repartition(self.buckets, "url")  # a bucket is one file
        if not self.lasting:
            self._append(placed, self.links_table)
            return
        remove(self.spark, f"{self.path}/outlinks")
        self._append(placed, self.links_table, path=f"{self.path}/outlinks")
        self._mark("outlinks", buckets=self.buckets)

    def find_outlinks(self) -> None:
        """The links that an earlier call wrote, with their buckets."""
        self.spark.sql(
            f"CREATE TABLE {self.links_table} (url STRING, links ARRAY<STRING>) USING parquet "
            f"CLUSTERED BY (url) INTO {self.buckets} BUCKETS LOCATION '{self.path}/outlinks'"
        )

    def _found(self) -> DataFrame:
        """First occurrence of each URL that the current level links.

        The hash table is built on the frontier; the links stream by in their buckets, unsorted.
        """
        links = self.spark.table(self.links_table)
        found = links.join(self.current.hint("shuffle_hash"), "url").select(
            F.col("id").alias("parent_id"), F.posexplode_outer("links").alias("pos", "url")
        )
        # A page's links are distinct, so no parent ties with itself for a URL.
        return (
            found.filter(F.col("url").isNotNull())
            .groupBy("url")
            .agg(F.min("parent_id").alias("parent_id"), F.min_by("pos", "parent_id").cast("long").alias("pos"))
        )

    def next_level(self) -> None:
        depth = self.depth + 1
        # Used twice below; written, so that the links are read once.
        path = f"{self.path}/found/depth={depth}"
        found = self._found()
        found.write.mode("overwrite").parquet(path)
        first = self.spark.read.schema(found.schema).parquet(path)
        seen = self.spark.table(self.seen_table).select("url")
        known = seen.join(first.select("url").hint("shuffle_hash"), "url", "left_semi")
        fresh = first.join(known.hint("shuffle_hash"), "url", "left_anti")
        self._add_seen(fresh.withColumn("depth", F.lit(depth)))
        level = self.spark.table(self.seen_table).filter(F.col("depth") == depth)
        self._add_level(level.select("url", "parent_id", "pos"))
        self._merge_seen()

    def _add_level(self, rows: DataFrame, **more) -> None:
        """Number and write a level; its size is counted in what was written."""
        depth = self.depth + 1
        path = f"{self.path}/levels/depth={depth}"
        if self.lasting:
            remove(self.spark, path)  # what a call that ended in the midst of it has left
        placed = write_in_order(rows, ["parent_id", "pos"], path, self._parent_ranges() if depth else None)
        numbered = number_written(placed, self.before + sum(self.levels))
        self._take(depth, numbered)
        self._mark(f"level-{depth}", offsets=numbered.offsets, count=numbered.count, **more)

    def _take(self, depth: int, numbered: Numbered) -> None:
        given = sum(self.levels)
        size = numbered.count if self.quantity is None else max(0, min(numbered.count, self.quantity - given))
        self.levels.append(size)
        self.offsets += [(depth, part, before) for part, before in numbered.offsets]
        self.current = self._limited(numbered.rows.select("id", "url"))
        if self.catalog_root is not None and size > self._recorded(depth):
            rows = link_rows(self.current, self.as_of)
            insert_rows(self.spark, self.catalog_root, rows, depth, self.run)

    def _recorded(self, depth: int) -> int:
        """Rows of a level that the catalogue has from an earlier call; fewer if a limit cut it."""
        if not self.lasting:
            return 0
        written = F.col("write").endswith(f"-{self.run}-{depth}")
        return catalog_rows(self.spark, self.catalog_root).filter(written).count()

    def _parent_ranges(self) -> tuple[int, Column]:
        """Equal ranges of the parents' ids, which are those of the level before and dense."""
        parents = max(1, self.levels[-1])
        first = self.before + sum(self.levels) - self.levels[-1] + 1
        parts = -(-parents // _PARENTS_PER_TASK)
        part = F.expr(f"cast((parent_id - {first}L) * {parts}L div {parents}L as int)")
        return parts, part

    def _limited(self, rows: DataFrame) -> DataFrame:
        return rows if self.last is None else limit_crawl(rows, self.last)

    def frontier(self) -> DataFrame:
        table = self.spark.createDataFrame(self.offsets, "depth int, _part int, _before long")
        rows = self.spark.read.schema(_LEVEL).parquet(f"{self.path}/levels")
        # One row per written partition and level, so the broadcast does not grow with the rows.
        numbered = rows.join(F.broadcast(table), ["depth", "_part"]).select(
            (F.col("_before") + F.col("_row") + 1).alias("id"), "url", "depth", "parent_id", "pos"
        )
        return self._limited(numbered)
