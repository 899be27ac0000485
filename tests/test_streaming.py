"""Streaming forms against their batch forms, with restarts and replays."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linkloom.operators.catalog import link_rows
from linkloom.operators.links import extract_links, filter_crawlable
from linkloom.plans.crawl import crawl
from linkloom.sources.catalog import create_catalog, insert_rows, read_catalog
from linkloom.sources.rawdocs import read_rawdocs
from linkloom.streaming import numbered
from linkloom.streaming.links import stream_links, window_links
from linkloom.streaming.numbered import number_stream
from linkloom.streaming.store import drain, record_stream, store_stream

PAGES = "page_id long, url string, html string"
T1 = dt.datetime(2024, 2, 1)


def page(k):
    html = f'<title>t{k}</title><a href="http://hot/"><a href="http://x/{k % 7}"><a href="http://x/{k}.pdf"><a href="http://hot/">'
    return (k, f"http://p/{k}", html)


def write_files(spark, path, numbers, files=3):
    spark.createDataFrame([page(k) for k in numbers], PAGES).repartition(files).write.mode("append").parquet(path)


def run_links(spark, source, out):
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream_links(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/links").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sorted(r.url for r in spark.read.schema("url string").parquet(f"{out}/links").collect())


def test_links_once_also_after_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, source, range(5))
    run_links(spark, source, out)
    write_files(spark, source, range(5, 40))
    got = run_links(spark, source, out)
    batch = filter_crawlable(extract_links(spark.read.parquet(source))).select("url").distinct()
    assert got == sorted(r.url for r in batch.collect()) == sorted(["http://hot/"] + [f"http://x/{i}" for i in range(7)])


def test_record_stream_restarts_and_drains(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "catalog", "checkpoint"))

    def entries(low, high):
        df = spark.range(low, high).select("id", F.concat(F.lit("http://p/"), "id").alias("url"))
        df.repartition(2).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("id long, url string").option("maxFilesPerTrigger", 1).parquet(source)
        record_stream(stream, root, checkpoint, as_of=T1).awaitTermination()
        return sorted(r.id for r in read_catalog(spark, root).collect())

    entries(0, 501)
    assert run() == list(range(501))
    assert run() == list(range(501))
    entries(501, 520)
    assert run() == list(range(520))
    entries(3, 4)  # an id that is there
    with pytest.raises(Exception, match="already present"):
        run()
    assert read_catalog(spark, root).count() == 520


def test_store_stream_follows_the_catalogue(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / n) for n in ("catalog", "out", "checkpoint"))
    pages = spark.createDataFrame([page(k) for k in range(30)], PAGES)
    entries = pages.select(F.col("page_id").alias("id"), "url")
    create_catalog(spark, root)

    def run():
        store_stream(spark, root, pages, out, checkpoint, as_of=T1, max_file_size=500).awaitTermination()
        rows = read_catalog(spark, root, ordered=True).collect()
        return [r.id for r in rows if r.stored], rows

    insert_rows(spark, root, link_rows(entries.filter("id < 10"), T1))
    assert run()[0] == list(range(10))
    insert_rows(spark, root, link_rows(entries.filter("id >= 10"), T1), 1, "run")
    unknown = spark.createDataFrame([(99, "http://p/none")], "id long, url string")
    insert_rows(spark, root, link_rows(unknown, T1))
    stored, rows = run()
    assert stored == list(range(30))
    assert [(r.title, r.content_length, r.update_time) for r in rows[:30]] == [
        (f"t{k}", len(page(k)[2]), T1) for k in range(30)
    ]
    assert (rows[30].id, rows[30].stored, rows[30].title) == (99, False, None)
    # A replayed batch of rows arrives again as new files, but is stored already.
    insert_rows(spark, root, link_rows(entries.filter("id >= 10"), T1), 1, "run")
    assert run()[1] == rows
    records = [r.html for r in read_rawdocs(spark, out).collect()]
    assert sorted(records) == sorted(page(k)[2] for k in range(30))


def test_runs_without_a_checkpoint_keep_what_earlier_ones_wrote(spark, tmp_path):
    root, out = (str(tmp_path / n) for n in ("catalog", "out"))
    pages = spark.createDataFrame([page(k) for k in range(6)], PAGES)
    for part in (0, 1):
        source = str(tmp_path / f"in{part}")
        pages.filter(F.col("page_id") % 2 == part).selectExpr("page_id as id", "url").write.parquet(source)
        record_stream(spark.readStream.schema("id long, url string").parquet(source), root, as_of=T1).awaitTermination()
    assert sorted(r.id for r in read_catalog(spark, root).collect()) == list(range(6))
    for part in (1, 0):
        store_stream(spark, root, pages.filter(F.col("page_id") % 2 == part), out, as_of=T1).awaitTermination()
    rows = read_catalog(spark, root).collect()
    assert all(r.stored and r.title == f"t{r.id}" for r in rows) and len(rows) == 6
    assert sorted(r.html for r in read_rawdocs(spark, out).collect()) == sorted(page(k)[2] for k in range(6))


def test_storing_stops_between_batches_and_goes_on_later(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / n) for n in ("catalog", "out", "checkpoint"))
    pages = spark.createDataFrame([page(k) for k in range(9)], PAGES)
    create_catalog(spark, root)
    for low in (0, 3, 6):
        entries = pages.filter(F.col("page_id").between(low, low + 2)).selectExpr("page_id as id", "url")
        insert_rows(spark, root, link_rows(entries.coalesce(1), T1))
    asked = []

    def stop():
        asked.append(1)
        return len(asked) > 2

    def run(should_stop):
        options = {"max_files_per_trigger": 1, "should_stop": should_stop}
        done = drain(store_stream(spark, root, pages, out, checkpoint, as_of=T1, **options))
        return done, read_catalog(spark, root).filter("stored").count()

    done, stored = run(stop)
    assert not done and 0 < stored < 9
    assert run(lambda: False) == (True, 9)


def test_a_task_remembers_a_bounded_number_of_links(monkeypatch):
    import pyarrow as pa

    from linkloom.streaming import links

    monkeypatch.setattr(links, "_HELD", 3)
    batches = [["hot", "a", "hot"], ["hot", "b", "c"], ["hot", "d", "e", "f"], ["hot", "a"]]
    sent = [b.column(0).to_pylist() for b in links._distinct_per_task(pa.RecordBatch.from_arrays([pa.array(x)], ["url"]) for x in batches)]
    assert sent == [["hot", "a"], ["b", "c"], ["d", "e", "f"], ["a"]]


def test_window_links_forget_closed_windows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    timed = "page_id long, url string, html string, at timestamp"

    def lot(rows):
        frame = spark.createDataFrame([(*page(k), at and dt.datetime(2024, 2, 1, *divmod(at, 60))) for k, at in rows], timed)
        frame.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(timed).option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            window_links(stream, "at", "1 hour", "10 minutes").writeStream.format("parquet")
            .option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/links")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]

    def found():
        rows = spark.read.schema("url string, begin timestamp").parquet(f"{out}/links").collect()
        return sorted((r.url, r.begin.hour) for r in rows)

    def want(*lots):
        return sorted({(u, at // 60) for k, at in lots for u in ("http://hot/", f"http://x/{k % 7}")})

    first, second = [(k, 60 + k) for k in range(30)], [(k, 125 + k % 3) for k in range(30)]
    lot(first)
    lot([(3, 61), (4, 62), (5, None)])  # repeats of an open window, and a page without a time
    held = run()
    assert found() == want(*first) and held[-1] == 8
    lot(second)  # the first window ends at minute 120 and is kept until 130 has been seen
    lot([(8, 70), (9, 119)])  # late, but not too late
    held = run()
    assert found() == want(*first, *second) and max(held) == 16
    lot([(1, 200)])
    held = run()  # what is seen of window 3 closes the first two
    assert held[-1] == 2
    lot([(2, 90), (1, 201), (6, 240)])  # the first is too late by now
    held = run()
    assert found() == want(*first, *second, (1, 200), (6, 240)) and held[-1] == 4


@pytest.mark.parametrize("crash", [None, "batch-0", "batch-1"])
def test_numbered_links_equal_a_level_of_a_crawl(spark, tmp_path, monkeypatch, crash):
    made = [
        (k, f"http://n/{k}", "".join(f'<a href="http://n/{t}">x</a>' for t in (k * 3, k * 5 + 1, 7, k + 100, k * 3)))
        for k in range(1, 31)
    ]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    folder, root, checkpoint = (str(tmp_path / name) for name in ("pages", "catalog", "checkpoint"))
    for lot in range(3):
        pages.filter(F.floor((F.col("page_id") - 1) / 10) == lot).coalesce(1).write.mode("append").parquet(folder)
    seeds = [url for _, url, _ in made]

    def run():
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        number_stream(stream, root, checkpoint=checkpoint, start=30, seen=pages).awaitTermination()

    if crash:
        put_new = numbered.put_new

        def failing(spark, path, text):
            if path.endswith(crash):
                raise OSError("lost after the write")
            return put_new(spark, path, text)

        monkeypatch.setattr(numbered, "put_new", failing)
        with pytest.raises(StreamingQueryException):
            run()
        assert read_catalog(spark, root).count() > 0  # written, but the micro-batch isn't committed
        monkeypatch.setattr(numbered, "put_new", put_new)
    run()
    run()
    want = crawl(spark, seeds, pages, max_depth=1).frontier.filter("depth = 1").select("id", "url")
    got = sorted((r.id, r.url) for r in read_catalog(spark, root).collect())
    assert got == sorted(map(tuple, want.collect())) and got[0][0] == 31
