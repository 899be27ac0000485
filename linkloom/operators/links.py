"""Outgoing links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.html import anchors_resolved, declared_base, references
from linkloom.functions.urls import is_crawlable, parse_base


def nonempty_pages(pages: DataFrame) -> DataFrame:
    """Drop pages whose HTML is null or empty."""
    return pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))


def with_link_array(pages: DataFrame, base: str = "strict") -> DataFrame:
    """Add ``links``: the URLs of all ``a[href]`` in order, ``''`` where one does not resolve.

    ``base="strict"`` gives relative links no base but the page's ``<base href>``;
    ``base="page"`` resolves them against the page's URL.  Map-only; ``html`` is read once.
    """
    if base not in ("strict", "page"):
        raise ValueError(f"base must be 'strict' or 'page', not {base!r}")
    own = "url" if base == "page" else "CAST(NULL AS STRING)"
    return (
        pages.withColumn("_refs", F.expr(references("html")))
        .withColumn("_page", F.expr(parse_base(own)))
        .withColumn("_declared", F.expr(declared_base("_refs", "_page")))
        .withColumn("_base", F.expr(parse_base(f"coalesce(_declared, {own})")))
        .withColumn("links", F.expr(anchors_resolved("_refs", "_base")))
        .drop("_refs", "_page", "_declared", "_base")
    )


def extract_links(pages: DataFrame, base: str = "strict") -> DataFrame:
    """One row per resolvable ``a[href]``: ``src_id, src_url, pos, url``.

    ``pages`` has ``id`` (or ``page_id``), ``url``, ``html``; ``pos`` counts the page's links from 0.
    """
    page_id = "id" if "id" in pages.columns else "page_id"
    arrays = with_link_array(nonempty_pages(pages.select(page_id, "url", "html")), base)
    # The outer form keeps the optimizer from adding a size(links) > 0 filter below the
    # generator, which would walk every page a second time; the last filter drops its null rows.
    return arrays.select(
        F.col(page_id).alias("src_id"),
        F.col("url").alias("src_url"),
        F.posexplode_outer("links").alias("pos", "url"),
    ).filter(F.col("url") != "")


def filter_crawlable(links: DataFrame) -> DataFrame:
    """Keep URLs that start with ``http`` and do not end in a skipped extension."""
    return links.filter(is_crawlable(F.col("url")))
