"""Crawl, seeds and snapshot against a plain FIFO queue."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from linkloom.files import folder_names, put_new, read_text
from linkloom.operators.ids import write_in_order
from linkloom.operators.snapshot import fetch_misses, fetch_snapshot, seed_frontier
from linkloom.plans import crawl as plan
from linkloom.plans.crawl import crawl
from linkloom.plans.stages import Stage, run_stages
from linkloom.schemas import CrawlSpec
from linkloom.sources.catalog import read_catalog

SIZE = 60
PAGES = "page_id long, url string, html string"


def targets(k):
    return [f"http://c/{2 * k}", f"http://c/{2 * k + 1}", "http://c/x.PDF", f"http://c/{k * 7 % SIZE}", f"http://c/{2 * k}"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for k in range(SIZE):
        html = "".join(f'<a href="{t}">x</a><a href="/rel">' for t in targets(k))
        rows.append((k, f"http://c/{k}", html))
    # Copies with other links under larger ids do not count.
    rows += [(1000 + k, "http://c/1", '<a href="http://c/copy">') for k in range(30)]
    rows += [(2000, "http://c/3", "")]
    return spark.createDataFrame(rows, PAGES)


def fifo(seeds, seeds_seen=True, quantity=None, max_depth=None):
    queue, seen = [], set()
    for url in seeds:
        if url and not (seeds_seen and url in seen):
            queue.append((len(queue) + 1, url, 0, None))
            if seeds_seen:
                seen.add(url)
    at = 0
    while at < len(queue):
        number, url, depth, _ = queue[at]
        at += 1
        k = int(url.rsplit("/", 1)[1]) if url.rsplit("/", 1)[1].isdigit() else SIZE
        if k >= SIZE or (max_depth is not None and depth >= max_depth):
            continue
        for link in targets(k):
            if not link.lower().endswith(".pdf") and link not in seen:
                seen.add(link)
                queue.append((len(queue) + 1, link, depth + 1, number))
    return queue[:quantity] if quantity is not None else queue


def rows_of(result):
    return [(r.id, r.url, r.depth, r.parent_id) for r in result.frontier.orderBy("id").collect()]


def test_crawl_equals_fifo(spark, pages, tmp_path):
    root = str(tmp_path / "catalog")
    result = crawl(spark, ["http://c/5", "", "http://c/1", None, "http://c/5"], pages, catalog_root=root)
    assert rows_of(result) == fifo(["http://c/5", "http://c/1"])
    assert result.levels[-1] == 0 and sum(result.levels) == len(rows_of(result))
    recorded = read_catalog(spark, root, ordered=True).select("id", "url", "stored").collect()
    assert [tuple(r) for r in recorded] == [(i, u, False) for i, u, _, _ in rows_of(result)]


def test_limited_levels_count_what_is_in_the_result(spark, pages):
    result = crawl(spark, ["http://c/1"], pages, quantity=10)
    assert sum(result.levels) == result.frontier.count() == 10


def test_a_second_crawl_goes_on_or_is_refused(spark, pages, tmp_path):
    root = str(tmp_path / "catalog")
    first = crawl(spark, ["http://c/1"], pages, quantity=10, catalog_root=root)
    before = read_catalog(spark, root, ordered=True).collect()
    with pytest.raises(ValueError, match="already present"):
        crawl(spark, ["http://c/2"], pages, catalog_root=root)
    assert read_catalog(spark, root, ordered=True).collect() == before
    known = first.frontier.select("url")
    later = crawl(spark, ["http://c/2", "http://c/999", "http://c/7"], pages, catalog_root=root, start=10, seen=known)
    recorded = read_catalog(spark, root, ordered=True).collect()
    assert [r.id for r in recorded] == list(range(1, len(recorded) + 1))
    assert len({r.url for r in recorded}) == len(recorded) == 10 + sum(later.levels)
    assert later.frontier.filter("url = 'http://c/999'").count() == 1


def test_an_unfinished_crawl_is_taken_up(spark, pages, tmp_path):
    whole, seeds = fifo(["http://c/1"]), ["http://c/1"]
    state, root = str(tmp_path / "state"), str(tmp_path / "catalog")
    bounds = [{"max_depth": 1}, {"quantity": 10}, {"quantity": 11}, {"should_stop": lambda: True}, {"max_depth": 4}, {}, {}]
    for bound in bounds:
        result = crawl(spark, seeds, pages, state=state, catalog_root=root, **bound)
        got = rows_of(result)
        assert got == whole[: len(got)] and sum(result.levels) == len(got)
        recorded = {(r.id, r.url) for r in read_catalog(spark, root).select("id", "url").collect()}
        assert {r[:2] for r in got} <= recorded <= {r[:2] for r in whole}
    assert got == whole and recorded == {r[:2] for r in whole}
    # Another crawl into the same catalogue is still refused.
    with pytest.raises(ValueError, match="already present"):
        crawl(spark, ["http://c/2"], pages, state=str(tmp_path / "other"), catalog_root=root)


@pytest.mark.parametrize("crash", ["outlinks", "level-0", "level-2", "level-3"])
def test_a_crashed_crawl_is_taken_up(spark, pages, tmp_path, monkeypatch, crash):
    state, root = str(tmp_path / "state"), str(tmp_path / "catalog")
    put_new = plan.put_new

    def failing(spark, path, text):
        if path.endswith(crash):
            raise OSError("lost")
        return put_new(spark, path, text)

    known = spark.createDataFrame([("http://c/4",)], "url string")
    monkeypatch.setattr(plan, "put_new", failing)
    with pytest.raises(OSError):
        crawl(spark, ["http://c/1"], pages, state=state, catalog_root=root, start=5, seen=known)
    monkeypatch.setattr(plan, "put_new", put_new)
    # A level of which just a part was written has no mark either.
    spark.range(3).write.mode("append").parquet(f"{state}/levels/depth=3/half")
    result = crawl(spark, ["http://c/1"], pages, state=state, catalog_root=root, start=5, seen=known)
    want = rows_of(crawl(spark, ["http://c/1"], pages, start=5, seen=known))
    assert rows_of(result) == want and want[0][0] == 6 and "http://c/4" not in {r[1] for r in want}
    assert sorted((r.id, r.url) for r in read_catalog(spark, root).collect()) == [r[:2] for r in want]


def test_files_of_a_bucket_do_not_grow_with_the_levels(spark, tmp_path, monkeypatch):
    """A chain of 20 levels: one file of links a bucket, and a few of seen URLs, also when the crawl is taken up."""
    rows = [(k, f"http://c/{k}", f'<a href="http://c/{k + 1}"><a href="http://c/{k // 2}">') for k in range(20)]
    chain = spark.createDataFrame(rows, PAGES).repartition(5)
    step, files = plan._Crawl.next_level, []

    def counted(self):
        step(self)
        files.append([len(spark.table(t).inputFiles()) for t in (self.links_table, self.seen_table)])

    monkeypatch.setattr(plan._Crawl, "next_level", counted)
    state = str(tmp_path / "state")
    for bound in ({"max_depth": 13}, {}):
        result = crawl(spark, ["http://c/0"], chain, buckets=2, state=state, **bound)
    assert [r.url for r in result.frontier.orderBy("id").collect()] == [f"http://c/{k}" for k in range(21)]
    assert len(files) == 21
    assert max(n for n, _ in files) == 2 and max(n for _, n in files) <= 2 * (plan._SEEN_RUNS + 1)


def test_small_files_are_made_once(spark, tmp_path):
    path = str(tmp_path / "folder" / "name")
    assert read_text(spark, path) is None
    assert put_new(spark, path, "first é") and not put_new(spark, path, "second")
    assert read_text(spark, path) == "first é"
    assert [n for n in folder_names(spark, str(tmp_path / "folder")) if not n.startswith(".")] == ["name"]
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: put_new(spark, f"{path}-x", str(i)), range(16)))
    assert sum(made) == 1 and read_text(spark, f"{path}-x") == str(made.index(True))


def test_seeds_not_seen(spark, pages):
    seeds = ["http://c/1", "http://c/1", "http://c/2"]
    want = fifo(seeds, seeds_seen=False)
    assert [u for _, u, _, _ in want].count("http://c/2") == 2
    assert rows_of(crawl(spark, seeds, pages, seeds_seen=False)) == want


def test_limits(spark, pages):
    spec = CrawlSpec(links=["http://c/1"], crawl_quantity=10)
    assert rows_of(crawl(spark, spec, pages)) == fifo(["http://c/1"], quantity=10)
    assert rows_of(crawl(spark, ["http://c/1"], pages, max_depth=2)) == fifo(["http://c/1"], max_depth=2)
    calls = []
    stopped = crawl(spark, ["http://c/1"], pages, should_stop=lambda: calls.append(1) or len(calls) > 1)
    assert rows_of(stopped) == fifo(["http://c/1"], max_depth=1)


def test_status_and_unique_urls(spark, pages):
    unique = pages.filter("page_id < 1000").withColumn("status_code", F.when(F.col("page_id") == 1, 404).otherwise(200))
    assert [r[1] for r in rows_of(crawl(spark, ["http://c/1"], unique, unique_urls=True))] == ["http://c/1"]
    result = crawl(spark, ["http://c/3"], unique.filter("page_id <> 1"), unique_urls=True)
    assert rows_of(result)[:4] == fifo(["http://c/3"])[:4]


def test_no_tables_are_left(spark, pages):
    crawl(spark, ["http://c/1"], pages, max_depth=1)
    assert [d.name for d in spark.catalog.listDatabases() if d.name.startswith("linkloom")] == []


def test_seed_rules(spark):
    with pytest.raises(ValueError):
        seed_frontier(spark, [])
    assert seed_frontier(spark, ["", None]).count() == 0
    got = seed_frontier(spark, ["b", "a", "", "b"], dedup=False).orderBy("id").collect()
    assert [(r.id, r.url) for r in got] == [(1, "b"), (2, "a"), (3, "b")]
    table = spark.createDataFrame([("z", 2), ("y", 1), ("z", 0)], "url string, n int")
    got = seed_frontier(spark, table, ["n"]).orderBy("id").collect()
    assert [(r.id, r.url) for r in got] == [(1, "z"), (2, "y")]


def test_fetch(spark, pages):
    frontier = spark.createDataFrame([(1, "http://c/1"), (2, "http://c/none"), (3, "http://c/3"), (4, "http://c/1")], "id long, url string")
    got = {r.id: r.html for r in fetch_snapshot(frontier, pages).collect()}
    assert set(got) == {1, 3, 4} and "copy" not in got[1] and got[1] == got[4]
    assert [r.id for r in fetch_misses(frontier, pages).collect()] == [2]
    status = pages.withColumn("status_code", F.when(F.col("url") == "http://c/3", 500).otherwise(204))
    assert {r.id for r in fetch_snapshot(frontier, status).collect()} == {1, 4}
    bodiless = pages.withColumn("html", F.lit(None).cast("string"))
    assert fetch_snapshot(frontier, bodiless).count() == 0


def test_stages(spark):
    df = spark.range(10)
    stages = [Stage(lambda d: d.filter("id > 3"), "filter"), Stage(lambda d: d.withColumn("x", F.col("id") * 2), "double")]
    assert [r.x for r in run_stages(df, stages).collect()] == [8, 10, 12, 14, 16, 18]
    assert Stage(lambda d: d).name == "default"
    with pytest.raises(Exception) as error:
        run_stages(df, [*stages, Stage(lambda d: d.select("nope"), "broken")])
    assert "in stage 'broken'" in error.value.__notes__
    assert run_stages(df, []).count() == 10


def test_write_in_order_keeps_all_rows(spark, tmp_path):
    path = str(tmp_path / "x")
    write_in_order(spark.range(1000).repartition(7), ["id"], path)
    assert spark.read.parquet(path).count() == 1000
