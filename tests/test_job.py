"""A whole job from its description to catalogue and raw files."""

import datetime as dt
import os

import pytest

from linkloom.operators.catalog import crawl_progress
from linkloom.plans.job import run_job
from linkloom.schemas import CrawlSpec
from linkloom.sources.catalog import read_catalog
from linkloom.sources.rawdocs import read_rawdocs

AS_OF = dt.datetime(2024, 3, 1)


def _html(k):
    return f'<title>Page {k}</title><a href="{k + 1}"><a href="http://p/{k + 1}"><a href="http://gone/{k}">'


def test_job(spark, tmp_path):
    rows = [(k, f"http://p/{k}", _html(k)) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    spec = CrawlSpec(
        links=["http://p/0"], crawl_quantity=6, save_directory=str(tmp_path), max_file_size=150,
        file_prefix="job-", file_suffix=".dat",
    )
    result = run_job(spark, spec, pages, base="page", as_of=AS_OF)
    want = ["http://p/0", "http://p/1", "http://gone/0", "http://p/2", "http://gone/1", "http://p/3"]
    assert [r.url for r in result.frontier.orderBy("id").collect()] == want
    catalog = read_catalog(spark, f"{tmp_path}/catalog", ordered=True)
    assert [(r.id, r.url, r.title, r.stored) for r in catalog.collect()] == [
        (i + 1, u, f"Page {u[-1]}" if "/p/" in u else None, "/p/" in u) for i, u in enumerate(want)
    ]
    assert tuple(crawl_progress(catalog).first()) == (4, 6, 66.67)
    raw = f"{tmp_path}/raw"
    names = [n for _, _, files in os.walk(raw) for n in files if not n.endswith(".crc")]
    assert names and all(n.startswith("job-") and n.endswith(".dat") for n in names)
    got = read_rawdocs(spark, raw, file_prefix="job-", file_suffix=".dat").collect()
    assert {r.id: r.html for r in got} == {"doc_1": _html(0), "doc_2": _html(1), "doc_4": _html(2), "doc_6": _html(3)}


def test_job_needs_a_directory(spark):
    with pytest.raises(ValueError):
        run_job(spark, CrawlSpec(links=["http://p/0"]), None)
