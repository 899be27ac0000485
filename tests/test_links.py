"""Links, titles and URL resolution against independent implementations."""

import html as stdlib_html
import re
from html.parser import HTMLParser

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from linkloom.functions.entities import decode_entities
from linkloom.functions.html import title_of
from linkloom.functions.urls import clean_reference, host_of, is_crawlable, parse_base, resolve_all
from linkloom.operators.links import extract_links, filter_crawlable, nonempty_pages

PAGE = "http://a.example/dir/page.html?q=1#top"
PAGES = "page_id long, url string, html string"


def links(spark, html, base="strict", url=PAGE):
    df = spark.createDataFrame([(1, url, html)], PAGES)
    return [(r.pos, r.url) for r in extract_links(df, base).orderBy("pos").collect()]


def urls(spark, html, base="strict", url=PAGE):
    return [u for _, u in links(spark, html, base, url)]


# Each case: HTML, then the href values a parser must see.
HREFS = [
    ('<a href="http://x/1">', ["http://x/1"]),
    ("<a href='http://x/2'>", ["http://x/2"]),
    ("<a href=http://x/3>", ["http://x/3"]),
    ("<a href=http://x/3/>", ["http://x/3/"]),
    ('<A HREF = "http://x/4">', ["http://x/4"]),
    ('<a\n class="b"\thref="http://x/5"\nid=c>', ["http://x/5"]),
    ('<a class="b"href="http://x/6">', ["http://x/6"]),
    ('<a/href="http://x/7">', ["http://x/7"]),
    ('<a data-href="http://x/no">', []),
    ('<a hrefs="http://x/no" title="href=http://x/no">', []),
    ('<a href="http://x/first" href="http://x/second">', ["http://x/first"]),
    ("<a title='a > b' href=\"http://x/8\">", ["http://x/8"]),
    ('<abbr href="http://x/no"><link href="http://x/no">', []),
    ('<!-- <a href="http://x/no"> --><a href="http://x/9">', ["http://x/9"]),
    ('<!--><a href="http://x/10">', ["http://x/10"]),
    ('<script>var s = "<a href=\'http://x/no\'>";</script><a href="http://x/11">', ["http://x/11"]),
    ('<style><a href="http://x/no"></style><a href="http://x/12">', ["http://x/12"]),
    ('<textarea><a href="http://x/no"></textarea><a href="http://x/13">', ["http://x/13"]),
    ('<title><a href="http://x/no"></title><a href="http://x/14">', ["http://x/14"]),
    ('<img alt="<a href=\'http://x/no\'>"><a href="http://x/15">', ["http://x/15"]),
    ('<SCRIPT></scripty><a href="http://x/no"></SCRIPT ><a href="http://x/16">', ["http://x/16"]),
    ('<a href="http://x/17?a=1&amp;b=2&#38;c=3&copy=4">', ["http://x/17?a=1&b=2&c=3&copy=4"]),
    ('<a href=" http://x/1\n8 ">', ["http://x/18"]),
    ('1 < 2 <a href="http://x/19">', ["http://x/19"]),
    ('<a href="http://x/20"><a href="http://x/20">', ["http://x/20", "http://x/20"]),
    ('<!DOCTYPE html><?x <a href="http://x/no"?><a href="http://x/21">', ["http://x/21"]),
    ('<a href="http://x/no', []),
    ('<script><a href="http://x/no">', []),
    ('<!-- <a href="http://x/no">', []),
    ('<a href="http://x/é/𝄞">', ["http://x/é/𝄞"]),
    ('<a disabled href="http://x/22" x>', ["http://x/22"]),
    ('<a x = y href = http://x/23 >', ["http://x/23"]),
    ("", []),
    ("<p>none</p>", []),
    (None, []),
]


def test_hrefs(spark):
    df = spark.createDataFrame([(i, PAGE, html) for i, (html, _) in enumerate(HREFS)], PAGES)
    got = {i: [] for i in range(len(HREFS))}
    for r in extract_links(df).orderBy("src_id", "pos").collect():
        got[r.src_id].append(r.url)
    for i, (html, want) in enumerate(HREFS):
        assert got[i] == want, html


class _Collector(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs, self.title, self.in_title = [], None, False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.hrefs.append(dict(attrs)["href"])
        self.in_title = tag == "title" and self.title is None

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data

    def handle_endtag(self, tag):
        self.in_title = False


def test_pages_table_against_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    found = {}
    for r in extract_links(pages, "page").orderBy("src_id", "pos").collect():
        found.setdefault(r.src_id, []).append(r.url)
    titles = {r.page_id: r.t for r in pages.select("page_id", F.expr(title_of("html")).alias("t")).collect()}
    for page_id, row in rows.items():
        parser = _Collector()
        parser.feed(row.html)
        root = "/".join(row.url.split("/")[:3])
        assert found.get(page_id, []) == [root + h for h in parser.hrefs]
        assert titles[page_id] == " ".join((parser.title or "").split())


def test_pos_counts_all_links_of_a_page(spark):
    html = '<a href="/rel"><a href="http://x/1"><a>none</a><a href="#f"><a href="http://x/2">'
    assert links(spark, html) == [(1, "http://x/1"), (3, "http://x/2")]


def test_relative_links_need_a_base(spark):
    html = '<a href="/r"><a href="s?x"><a href="//h/p"><a href="?y"><a href="#f"><a href=""><a href><a href="mailto:m@x">'
    assert urls(spark, html) == ["mailto:m@x"]
    assert urls(spark, html, "page") == [
        "http://a.example/r",
        "http://a.example/dir/s?x",
        "http://h/p",
        "http://a.example/dir/page.html?y",
        "http://a.example/dir/page.html?q=1#f",
        PAGE,
        PAGE,
        "mailto:m@x",
    ]


def test_base_element(spark):
    html = '<base target="_blank"><base href="/no"><BASE HREF="http://b.example/x/y"><base href="http://c.example/"><a href="z">'
    assert urls(spark, html) == ["http://b.example/x/z"]
    relative = '<a href="z"><base href="../up/">'
    assert urls(spark, relative, "page") == ["http://a.example/up/z"]
    assert urls(spark, relative) == []
    assert urls(spark, '<a href="z">', "page", url="not a url") == []
    assert urls(spark, '<a href="z">', "page", url=None) == []


def test_wrong_base_mode(spark):
    with pytest.raises(ValueError):
        links(spark, "x", base="other")


BASES = ["http://a.com", "http://a.com/", "http://a.com/b/c/d", "https://a.com:8080/b/c/?q#f", "HTTP://A.com/b?x/y"]
REFS = [
    "", "g", "./g", "g/", "/g", "//g.com/h", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x=1", ".", "./",
    "..", "../", "../g", "../..", "../../", "../../g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y",
    "g?y/./x", "g#s/../x", "http://X.com", "HTTP://X.com/A", "http://x.com/a/../b/./c", "http://x.com/..a/.b",
    "https://x.com/a/..", "http:g", "ftp://f.com/a/../b", "a:b", "javascript:void(0)", "mailto:q@x.com",
    "http://x.com?a=/../b", "/a//../b", "/a/b/../../c", "http://x.com/a@b", "x y", "é/ü", "tel:+1", "/.",
    "/./a", "http://x.com/%2e%2e/a", "httpx://y/../z",
]


def _java(spark, base, ref):
    """The JVM's own URL class; a reference it has no handler for stays if it has a scheme."""
    url = spark._jvm.java.net.URL
    if ref.startswith("?") and base:
        ref = (url(base).getPath() or "/") + ref
    try:
        if not base:
            return url(ref).toExternalForm()
        # Dot segments at the root are dropped when there is a base.
        return re.sub(r"^(\w+://[^/?#]*)/(?:\.\.?/)+", r"\1/", url(url(base), ref).toExternalForm())
    except Py4JJavaError:
        scheme = ref.split(":")[0]
        return ref if ":" in ref and scheme[:1].isalpha() and scheme.isalnum() else ""


@pytest.mark.parametrize("base", [None, *BASES])
def test_resolution_against_java(spark, base):
    df = spark.createDataFrame([(r,) for r in REFS], "ref string")
    df = df.withColumn("base", F.expr(parse_base("'%s'" % base if base else "CAST(NULL AS STRING)")))
    got = df.withColumn("got", F.expr(f"get({resolve_all('array(ref)', 'base')}, 0)")).collect()
    for row in got:
        want = _java(spark, base, row.ref)
        assert row.got == want, (base, row.ref)


def test_user_information_goes_with_a_base(spark):
    html = '<a href="http://u:p@h.com/a/../b"><a href="http://h.com/@me">'
    assert urls(spark, html, "page") == ["http://h.com/a/../b", "http://h.com/@me"]
    assert urls(spark, html) == ["http://u:p@h.com/a/../b", "http://h.com/@me"]


def test_clean_reference(spark):
    df = spark.createDataFrame([("\x01 h\tt\r\nt\x1fp ",)], "r string")
    assert df.select(F.expr(clean_reference("r"))).first()[0] == "http"


CRAWLABLE = [
    ("http://x/a.pdf", False), ("http://x/a.PDF", False), ("http://x/a.docx", True), ("http://x/a.Doc", False),
    ("http://x/a.pdf?x=1", True), ("http://x/a.pdf#f", True), ("https://x/a.apk", False), ("http://x/pdf", True),
    ("ftp://x/a", False), ("HTTP://x/a", False), ("httpx://x", True), ("", False), ("http://x/a.jpg\n", True),
]


def test_crawlable(spark):
    df = spark.createDataFrame([(u,) for u, _ in CRAWLABLE], "url string")
    assert {r.url: r.k for r in df.select("url", is_crawlable(F.col("url")).alias("k")).collect()} == dict(CRAWLABLE)
    assert filter_crawlable(df).count() == sum(k for _, k in CRAWLABLE)


def test_nonempty(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", " ")], PAGES)
    assert [r.page_id for r in nonempty_pages(df).collect()] == [3]


TITLES = [
    ("<title>A</title>", "A"),
    ("<html><head>\n<meta charset=x><TITLE lang=en> A\n\t B&nbsp;&nbsp;C </TITLE>", "A B C"),
    ("<title>A</title><title>B</title>", "A"),
    ("<!-- <title>no</title> --><title>yes</title>", "yes"),
    ("<script>'<title>no</title>'</script><title>yes</title>", "yes"),
    ("<title>a &lt;b&gt; &amp;amp; &#233;&#xE9; &#x80; &notin; &notit; &ampx</title>", "a <b> &amp; éé € ∉ ¬it; &x"),
    ("<title>a<b>c</title>", "a<b>c"),
    ("<title></title>", ""),
    ("<p>text</p><svg><title>no</title></svg>", ""),
    ("<body><title>no</title>", ""),
    ("<html><head></head><title>late</title><body>", "late"),
    ("<title>open", "open"),
    ("<title>a​b­c</title>", "abc"),
    ("none", ""),
]


def test_titles(spark):
    df = spark.createDataFrame([(html,) for html, _ in TITLES], "html string")
    got = {r.html: r.t for r in df.select("html", F.expr(title_of("html")).alias("t")).collect()}
    assert got == dict(TITLES)


def test_entities_against_stdlib(spark):
    texts = [
        "&amp;&lt;&gt;&quot;&apos;", "&eacute;&Eacute;&copy;&copy &reg", "&CounterClockwiseContourIntegral;", "&#65;&#x41;&#X41;&#65",
        "&bogus; & &&amp;& &;", "&#; &#x; &#xZ;", "&#128;&#150;&#159;&#129;", "&#x1F600;", "&#1114112;&#99999999999999;", "&fjlig;&NotEqualTilde;",
        "&notin;&not;&notit;", "&frac12;&frac12x&sup2y", "&#xD800;",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", F.expr(decode_entities("t")).alias("d")).collect():
        want = stdlib_html.unescape(row.t)
        assert row.d.replace("\x81", "") == want.replace("\x81", ""), row.t


def test_entities_in_attributes(spark):
    cases = {"?a&copy=1": "?a&copy=1", "?a&copy;=1": "?a©=1", "?a&copyx": "?a&copyx", "&copy": "©", "&notit;": "&notit;", "&lt": "<"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", F.expr(decode_entities("t", in_attribute=True)).alias("d")).collect()
    assert {r.t: r.d for r in got} == cases


def test_host(spark):
    cases = {"http://a.b/c": "a.b", "https://u:p@h:80/x": "h", "x": None, "http://": None, "http://h?x": "h", None: None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.h for r in df.select("t", host_of(F.col("t")).alias("h")).collect()} == cases


def test_large_page_does_not_overflow_the_stack(spark):
    # Each construct repeated far more often than a recursive matcher could follow.
    many = 200_000
    html = "<p>" + " x='1'" * many + "<a href='http://x/1' " + "y=z " * many + ">" + "<!-- - -->" * many
    html += "<b>" * many + '<a href="http://x/2">' + "&amp;" * 10
    df = spark.range(1).select(F.lit(1).alias("page_id"), F.lit(PAGE).alias("url"), F.lit(html).alias("html"))
    assert [r.url for r in extract_links(df).collect()] == ["http://x/1", "http://x/2"]
    attrs = "<a " + "a" * 1_000_000 + " " + "b=c " * many + "href='http://x/3'>" + "<script>" + "x<" * many
    df = spark.range(1).select(F.lit(1).alias("page_id"), F.lit(PAGE).alias("url"), F.lit(attrs).alias("html"))
    assert [r.url for r in extract_links(df).collect()] == ["http://x/3"]
