"""Catalogue operators and the Parquet catalogue."""

import datetime as dt
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from linkloom.operators import catalog as cat
from linkloom.schemas import CATALOG, PATCH
from linkloom.sources import catalog as store

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1, 3, 4, 5)


def row(doc_id, url="u", title=None, status=None, stored=False, length=None, created=T0, updated=None):
    return (doc_id, url, title, None, status, stored, None, length, created, updated)


def frame(spark, rows):
    return spark.createDataFrame(rows, CATALOG)


def patches(spark, rows):
    names = ("seq", "id", "title", "stored", "content_length", "update_time")
    full = [tuple(dict(zip(names, r)).get(f.name) for f in PATCH) for r in rows]
    return spark.createDataFrame(full, PATCH)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_link_rows(spark):
    entries = spark.createDataFrame([(1, "http://a")], "id long, url string")
    df = cat.link_rows(entries, T0)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in CATALOG]
    assert df.first() == row(1, "http://a")
    assert cat.link_rows(entries).first().create_time is not None


def test_page_patches(spark):
    pages = spark.createDataFrame([(1, "<title> é </title>"), (2, ""), (3, None), (4, "x")], "id long, html string")
    got = by_id(cat.page_patches(pages, T1))
    assert {k: (r.title, r.content_length, r.stored, r.update_time) for k, r in got.items()} == {
        1: ("é", 19, True, T1), 4: ("", 1, True, T1),
    }


def test_view_reads_nulls_as_zero(spark):
    got = cat.catalog_view(frame(spark, [row(1, stored=None), row(2, status=404, length=5, stored=True)]))
    assert [(r.status_code, r.content_length, r.stored, r.update_time) for r in got.orderBy("id").collect()] == [
        (0, 0, False, None), (404, 5, True, None),
    ]


def test_patch_rules(spark):
    catalog = frame(spark, [row(1, title="old"), row(2, stored=True), row(3), row(4, title="keep", length=9)])
    got = by_id(
        cat.catalog_patch(
            catalog,
            patches(
                spark,
                [
                    (1, 1, "first", False, 1, T0), (2, 1, "second", None, None, T1), (3, 1, None, True, None, None),
                    (4, 1, None, False, None, None),  # stored never falls
                    (1, 2, None, False, None, None),
                    (1, 4, None, None, None, None),  # nothing set
                    (1, 99, "x", True, 1, T1),  # unknown id
                    (1, None, "x", True, 1, T1),  # no id
                ],
            ),
        )
    )
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].title, got[1].content_length, got[1].stored, got[1].update_time) == ("second", 1, True, T1)
    assert got[2].stored is True
    assert got[3] == row(3)
    assert got[4] == row(4, title="keep", length=9)


def test_patch_is_idempotent_and_skips_merge_on_request(spark):
    catalog = frame(spark, [row(i) for i in range(5)])
    patch = patches(spark, [(1, i, f"t{i}", True, i, T1) for i in range(3)])
    once = cat.catalog_patch(catalog, patch)
    assert by_id(cat.catalog_patch(once, patch)) == by_id(once)
    assert by_id(cat.catalog_patch(catalog, patch.drop("seq"), one_per_id=True)) == by_id(once)


def test_delete(spark):
    catalog = frame(spark, [row(i) for i in range(5)])
    ids = spark.createDataFrame([(1,), (1,), (7,)], "id long")
    assert set(by_id(cat.catalog_delete(catalog, ids))) == {0, 2, 3, 4}
    assert cat.deleted_count(catalog, ids).first().deleted == 1


@pytest.mark.parametrize("size", [0, 1, 500, 501])
def test_insert(spark, size):
    base = frame(spark, [row(i) for i in range(10)])
    batch = frame(spark, [row(100 + i) for i in range(size)])
    assert cat.catalog_insert(base, batch).count() == 10 + size


@pytest.mark.parametrize("ids", [[100, 3], [100, 100]])
def test_insert_conflict_inserts_nothing(spark, ids):
    base = frame(spark, [row(i) for i in range(10)])
    with pytest.raises(ValueError):
        cat.catalog_insert(base, frame(spark, [row(i) for i in ids]))


def test_insert_without_id(spark):
    base = frame(spark, [row(1)])
    batch = base.withColumn("id", F.lit(None).cast("long"))
    with pytest.raises(ValueError):
        cat.check_insert(base, batch)


@pytest.mark.parametrize(
    "deep, blocks, asked",
    [(False, 4096, [(1, 3), (4, 3), (5, 3)]), (True, 64, [(2, 4), (3, 4), (4, 4)]), (True, 4096, [(2, 3), (1, 20)])],
)
def test_pages(spark, monkeypatch, deep, blocks, asked):
    page_of = cat.deep_page if deep else cat.catalog_page
    monkeypatch.setattr(cat, "_BLOCKS", blocks)
    ids = [-50, 3, 4, 5, 9, 100, 101, 5000, 70_000, 70_001, 10**12]
    catalog = frame(spark, [row(i) for i in ids])
    for page, size in asked:
        want = ids[(page - 1) * size : page * size]
        assert [r.id for r in page_of(catalog, page, size).collect()] == want


def test_page_edges(spark):
    catalog = frame(spark, [row(1)])
    for page_of in (cat.catalog_page, cat.deep_page):
        assert page_of(catalog, 1, 0).count() == 0
        for page, size in ((0, 1), (1, -1)):
            with pytest.raises(ValueError):
                page_of(catalog, page, size)
    assert cat.deep_page(catalog.limit(0), 2, 3).count() == 0


def test_counts(spark):
    catalog = frame(spark, [row(1, stored=True), row(2), row(3)])
    assert cat.catalog_count(catalog).first().total == 3
    assert tuple(cat.crawl_progress(catalog).first()) == (1, 3, 33.33)
    assert tuple(cat.crawl_progress(catalog.limit(0)).first()) == (0, 0, None)
    assert [r.id for r in cat.catalog_get(catalog, 2).collect()] == [2]
    assert cat.catalog_get(catalog, 9).count() == 0


def test_pending(spark):
    catalog = frame(spark, [row(1, stored=True), row(2), row(5), row(9, stored=None)])
    assert sorted(r.id for r in cat.pending_docs(catalog).collect()) == [2, 5, 9]
    assert [r.id for r in cat.pending_docs(catalog, 3, 8).collect()] == [5]


def test_domain(spark):
    df = cat.derive_domain(frame(spark, [row(1, "https://h.example:80/x"), row(2, "x")]))
    assert {r.id: r.domain for r in df.collect()} == {1: "h.example", 2: None}


def test_parquet_catalogue(spark, tmp_path):
    root = str(tmp_path / "catalog")
    store.create_catalog(spark, root)
    assert store.read_catalog(spark, root).count() == 0
    assert store.insert_rows(spark, root, frame(spark, [row(i) for i in range(5)])) == 5
    store.create_catalog(spark, root)  # an existing catalogue stays
    assert store.insert_rows(spark, root, frame(spark, [row(i) for i in range(5, 8)]), 1, "run") == 3
    with pytest.raises(ValueError):
        store.insert_rows(spark, root, frame(spark, [row(2)]))
    with pytest.raises(ValueError):  # the number alone does not make it the same batch
        store.insert_rows(spark, root, frame(spark, [row(6)]), 1)
    store.insert_rows(spark, root, frame(spark, [row(i) for i in range(5, 9)]), 1, "run")  # replayed batch
    assert store.insert_patches(root, patches(spark, [(9, 1, "early", True, 3, T0), (0, 77, "x", None, 1, T0)]), 5) == 1
    store.insert_patches(root, patches(spark, [(1, 1, "late", None, None, T1)]))
    got = store.read_catalog(spark, root, ordered=True).collect()
    assert [r.id for r in got] == list(range(9))
    assert (got[1].title, got[1].stored, got[1].content_length, got[1].update_time) == ("late", True, 3, T1)
    new = str(tmp_path / "compact")
    store.compact_catalog(spark, root, new)
    assert store.read_catalog(spark, new, ordered=True).collect() == got
    assert [f.name for f in store.read_catalog(spark, new).schema] == [f.name for f in CATALOG]


def test_the_later_write_wins_and_deletion_is_lasting(spark, tmp_path):
    root = str(tmp_path / "catalog")
    store.create_catalog(spark, root)
    store.insert_rows(spark, root, frame(spark, [row(i) for i in range(6)]))
    store.insert_patches(root, patches(spark, [(1, 2, "old", True, 3, T0)]), batch=9, run="z")
    store.insert_patches(root, patches(spark, [(1, 2, "new", None, None, T1)]), batch=0, run="a")
    assert store.read_catalog(spark, root).filter("id = 2").first().title == "new"
    doomed = spark.createDataFrame([(2,), (3,), (2,), (99,), (None,)], "id long")
    assert store.delete_rows(spark, root, doomed) == 2
    assert sorted(r.id for r in store.read_catalog(spark, root).collect()) == [0, 1, 4, 5]
    store.insert_rows(spark, root, frame(spark, [row(2)]))
    again = store.read_catalog(spark, root).filter("id = 2").first()
    assert (again.title, again.stored) == (None, False)


def test_domain_of_ipv6(spark):
    df = cat.derive_domain(frame(spark, [row(1, "http://[2001:db8::1]:80/x"), row(2, "http://u@[::1]")]))
    assert {r.id: r.domain for r in df.collect()} == {1: "[2001:db8::1]", 2: "[::1]"}


def _rows(spark, ids):
    return cat.link_rows(spark.createDataFrame([(i, f"http://h/{i}") for i in ids], "id long, url string"), T0)


def test_two_writers_of_one_id(spark, tmp_path, monkeypatch):
    root, barrier = str(tmp_path / "catalog"), threading.Barrier(2, timeout=120)
    store.create_catalog(spark, root)
    put_new, waited = store.put_new, threading.local()

    def together(spark, path, text):
        if not getattr(waited, "once", False):  # both have probed, and neither has committed
            waited.once = True
            barrier.wait()
        return put_new(spark, path, text)

    monkeypatch.setattr(store, "put_new", together)

    def insert(ids):
        try:
            return store.insert_rows(spark, root, _rows(spark, ids))
        except ValueError as refused:
            return str(refused)

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(insert, [[1, 2], [2, 3]]))
        assert sorted(map(type, got), key=str) == [int, str] and "already present" in str(got)
        won = [1, 2] if got[0] == 2 else [2, 3]
        assert sorted(r.id for r in store.read_catalog(spark, root).collect()) == won
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(insert, [[10], [11, 12]])) == [1, 2]
    assert sorted(r.id for r in store.read_catalog(spark, root).collect()) == [*won, 10, 11, 12]


def test_a_lost_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "catalog")
    store.create_catalog(spark, root)

    def lost(*args):
        raise OSError("lost")

    for name, visible in (("put_new", []), ("move", [1])):
        real = getattr(store, name)
        monkeypatch.setattr(store, name, lost)
        with pytest.raises(OSError):
            store.insert_rows(spark, root, _rows(spark, [1]))
        monkeypatch.setattr(store, name, real)
        # Not committed: not there.  Committed, but not moved: the reader moves it.
        assert [r.id for r in store.read_catalog(spark, root).collect()] == visible
    with pytest.raises(ValueError, match="already present"):
        store.insert_rows(spark, root, _rows(spark, [1]))
    assert store.delete_rows(spark, root, spark.createDataFrame([(1,)], "id long")) == 1
    assert store.insert_rows(spark, root, _rows(spark, [1])) == 1
    assert [r.id for r in store.read_catalog(spark, root).collect()] == [1]
