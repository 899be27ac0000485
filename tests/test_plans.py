"""Plans of the core operators: what must not appear at scale, and what must."""

import ast
import pathlib

import pytest
from pyspark.sql import functions as F

from linkloom.operators import catalog as cat
from linkloom.operators import dedup
from linkloom.operators.ids import assign_ids
from linkloom.operators.links import extract_links, filter_crawlable
from linkloom.operators.snapshot import fetch_snapshot
from linkloom.plans import crawl as plan
from linkloom.schemas import CATALOG
from linkloom.sources import catalog as store

PACKAGE = pathlib.Path(plan.__file__).parents[1]


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big(spark):
    """Joins as for large tables: nothing is small enough to broadcast by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def pages(big):
    return big.read.parquet("/root/testdata/sf0.001/pages.parquet")


def operators(spark, pages):
    links = extract_links(pages, "page")
    seq = pages.select(F.col("page_id").alias("seq"), "url")
    catalog = cat.link_rows(pages.select(F.col("page_id").alias("id"), "url"))
    frontier = catalog.select("id", "url")
    return {
        "extract": links,
        "dedup": dedup.dedup_links(filter_crawlable(links)),
        "drop_seen": dedup.drop_seen(frontier, seq),
        "bloom": dedup.bloom_dedup(seq),
        "fetch": fetch_snapshot(frontier, pages),
        "patch": cat.catalog_patch(catalog, cat.page_patches(pages)),
        "delete": cat.catalog_delete(catalog, frontier),
        "progress": cat.crawl_progress(catalog),
        "ids": assign_ids(frontier, ["url"]),
        "outlinks": plan.outlinks(pages),
    }


def test_no_single_partition_window_and_no_cross_join(big, pages):
    for name, df in operators(big, pages).items():
        shown = text(df)
        for bad in ("Window", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ObjectHashAggregate"):
            assert bad not in shown, name


def test_extraction_moves_nothing_and_reads_html_once(pages):
    shown = text(extract_links(pages, "page"))
    assert "Exchange" not in shown
    assert shown.count("FileScan") == 1
    assert shown.count("regexp_extract_all(html") == 1


def test_first_occurrence_is_one_hash_aggregation(pages):
    shown = text(dedup.dedup_links(extract_links(pages, "page")))
    assert shown.count("Exchange") == 1 and "SortAggregate" not in shown
    assert "partial_min" in shown


def test_bloom_shuffles_bits_after_partial_aggregation(pages):
    seq = pages.select(F.col("page_id").alias("seq"), "url")
    shown = text(dedup.bloom_first(seq, "url", "seq"))
    assert "partial_min" in shown and "SortAggregate" not in shown


def test_outlinks_sort_no_link_arrays(pages):
    shown = text(plan.outlinks(pages))
    assert "SortAggregate" not in shown and "Sort [" not in shown


def test_html_stays_out_of_narrow_plans(pages):
    frontier = pages.select(F.col("page_id").alias("id"), "url")
    ids_only = fetch_snapshot(frontier, pages).select("id")
    for schema in text(cat.catalog_count(frontier)), text(dedup.drop_seen(frontier, pages)):
        assert "html" not in schema
    assert text(ids_only).count("html:string") <= 2  # bodies are looked at, not moved
    assert "html" not in "".join(x for x in text(ids_only).splitlines() if "Exchange" in x)


def test_lookup_is_pushed_to_the_scan(big, tmp_path):
    root = str(tmp_path / "catalog")
    store.create_catalog(big, root)
    big.createDataFrame([], CATALOG).write.mode("append").parquet(f"{root}/rows/write=000000000001-x-1")
    shown = text(cat.catalog_get(store.read_catalog(big, root), 7))
    assert shown.count("EqualTo(id,7)") == 2  # rows and patches


def test_early_page_is_a_top_k(big, pages):
    catalog = pages.select(F.col("page_id").alias("id"), "url")
    assert "TakeOrderedAndProject" in text(cat.catalog_page(catalog, 3, 10))


def test_crawl_level_does_not_move_the_link_and_seen_tables(big, pages, monkeypatch):
    plans = {}
    append, found = plan._Crawl._append, plan._Crawl._found

    def spy_append(self, df, table, *partition):
        if self.levels and self.depth == 0 and table == self.seen_table:
            plans["seen"] = text(df)
        return append(self, df, table, *partition)

    def spy_found(self):
        out = found(self)
        plans["links"] = text(out)
        return out

    monkeypatch.setattr(plan._Crawl, "_append", spy_append)
    monkeypatch.setattr(plan._Crawl, "_found", spy_found)
    url = pages.first().url
    plan.crawl(big, [url], pages, base="page", max_depth=1, buckets=4)
    for shown in plans.values():
        assert shown.count("Bucketed: true") == 1
        # What the frontier brings, on either side of a join or aggregation; no bucketed table.
        assert shown.count("Exchange hashpartitioning") == 2
        assert "SortMergeJoin" not in shown
    assert "Sort [" not in plans["seen"]


def test_library_neither_collects_data_nor_checkpoints_locally():
    allowed = {"operators/ids.py", "operators/catalog.py"}  # per-partition, per-range and error rows
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.parts:
            continue
        source = path.read_text()
        names = {n.attr for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Attribute)}
        assert not names & {"toPandas", "localCheckpoint", "rdd", "crossJoin", "toLocalIterator", "cache"}, path
        if "collect" in names:
            assert str(path.relative_to(PACKAGE)) in allowed, path
