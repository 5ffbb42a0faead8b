import pytest
from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.address import address
from ampora.operators import classify as C
from ampora.operators import discovery, html
from ampora.sources import files, sinks, workbook

LONG = "The plant near the coast will serve homes and displace carbon dioxide every year. " * 12


@pytest.mark.parametrize(
    ("text", "base", "expected"),
    [
        (" HTTPS://A.Example:443/x?utm_source=1&b=2&FROM=c#top ", None, "https://a.example/x?b=2"),
        ("a.example/x", None, "https://a.example/x"),
        ("../y.html", "https://a.example/n/1.html", "https://a.example/y.html"),
        ("//b.example/z", "https://a.example/", "https://b.example/z"),
        ("mailto:x@y", "https://a.example/", ""),
        ("javascript:void(0)", "https://a.example/", ""),
        ("http://a.example:8080", None, "http://a.example:8080/"),
        ("https://a.example/ü x", None, "https://a.example/%C3%BC%20x"),
        ("http://[bad", None, ""),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_address(text, base, expected):
    assert address(text, base) == expected


def test_title_and_date_precedence():
    page = lambda head, body="": f"<html><head><title>T</title>{head}</head><body>{body}</body></html>"
    ld = '<script type="application/ld+json">[{"@graph":[{"@type":["NewsArticle"],"headline":"H &amp; <b>x</b>","datePublished":"2024-05-06T10:00"}]}]</script>'
    both = html.parse(page(ld + '<meta property="og:title" content="O"><meta name="date" content="2024-05-05">', "<h1>One</h1>"), "https://a.example/1")
    assert both["title"] == "H & x" and both["date_candidates"] == ["2024-05-05", "2024-05-06"] and both["published_at"] == "2024-05-05" and both["page_type"] == "article"
    assert html.parse(page('<meta property="og:title" content="O">', "<h1>One</h1>"), "https://a.example/1")["title"] == "O"
    assert html.parse(page("", "<h1> One </h1>"), "https://a.example/1")["title"] == "One"
    assert html.parse(page(""), "https://a.example/1")["title"] == "T"
    assert html.parse("", "https://a.example/1")["title"] == "https://a.example/1"
    assert html.parse(page("", "on 3 of 2024年5月6日"), "https://a.example/2023/4/5/x.html")["published_at"] == "2023-04-05"
    assert html.parse(page("", "on 2024年5月6日"), "https://a.example/x")["published_at"] == "2024-05-06"
    assert html.parse(page("<script>var d='2024-05-06'</script>"), "https://a.example/x")["published_at"] is None


def test_content_and_types():
    article = html.parse(f"<body><nav>{'menu ' * 500}</nav><div class='content'><a href=/>{'link ' * 300}</a></div><article><h2>Head</h2><p>{LONG}</p></article></body>", "https://a.example/n/1.html")
    assert article["method"] == "content-density" and article["text"].startswith("Head") and "menu" not in article["text"] and article["page_type"] == "article"
    assert html.parse(f"<body><p>{LONG}</p></body>", "https://a.example/")["page_type"] == "homepage"
    listing = "<body>" + "".join(f"<article><time datetime='2024-01-0{i}'>x</time></article>" for i in range(1, 5)) + "</body>"
    assert html.parse(listing, "https://a.example/x")["page_type"] == "listing"
    roundup = html.parse(f"<body><main><h1>Weekly roundup</h1><p>{LONG}</p></main></body>", "https://a.example/n/1.html")
    assert roundup["page_type"] == "roundup"
    body = html.parse('<script type="application/ld+json">{"@type":"Article","articleBody":"' + LONG + '"}</script><body><p>short</p></body>', "https://a.example/x")
    assert body["method"] == "json-ld-articleBody" and body["text"] == LONG
    thick = html.parse("<body>" + "<div>entry of the menu</div>" * 200 + "</body>", "https://a.example/x")
    assert thick["fake_thick"] and thick["needs_render"]
    assert not article["fake_thick"]


@pytest.mark.parametrize("page", ["", "<", "<div>" * 20_000, "<p>" * 3_000 + "x", "<!doctype", "<![CDATA[x", "<a href='//[bad'>x</a>", "\x00<p>&#0;&#x110000;</p>", "x" * 2_000_000])
def test_odd_pages(page):
    got = html.parse(page, "https://a.example/x")
    assert len(got["text"]) <= html.MAX_TEXT and got["page_type"] in ("unknown", "article", "listing")
    html.Page(page).links("https://a.example/x")
    html.blocks(page)


def test_pages_as_frames(spark):
    rows = [("a", "https://a.example/n/1.html", "<h1>Ti</h1><p>xy</p>", "clash"), ("b", None, "<p>", "c"), ("c", "https://a.example/", None, "c")]
    pages = spark.createDataFrame(rows, "raw_path string, url string, html string, title string")
    assert [(r["raw_path"], r["title"]) for r in html.documents(pages).collect()] == [("a", "Ti")]
    assert html.links(pages).count() == 0 and html.documents(pages.limit(0)).count() == 0
    assert [tuple(r) for r in html.markdown(pages).where("raw_path = 'a'").orderBy("place").collect()] == [("a", 0, "# Ti"), ("a", 1, "xy")]


def test_blocks():
    page = "<body><p>out</p><article><h1>AB</h1><h1>AB</h1><p>One  two</p><p>One two</p><p>x</p><ul><li>item</li></ul><blockquote>said</blockquote><pre>code</pre></article></body>"
    assert html.blocks(page) == ["# AB", "One two", "- item", "> said", "```\ncode\n```"]


def test_archive_walk(spark):
    site = {
        "https://a.example/": [("/news/", "News", None), ("https://b.example/news/", "Other", None), ("/file.pdf", "File", None)],
        "https://a.example/news/": [("/news/index_1.html", "next", None), ("/art/2024/6/1/x.html", "A long title", "2024-06-01"), ("/news/", "News", None)],
        "https://a.example/news/index_1.html": [("/news/index_2.html", "next", None), ("/art/2023/6/1/y.html", "Another title", "2023-06-01")],
        "https://a.example/news/index_2.html": [("/art/2022/6/1/z.html", "Old", "2022-06-01")],
    }
    rows = [(p, address(h, p), label, hint) for p, links in site.items() for h, label, hint in links]
    links = spark.createDataFrame(rows, "from_url string, href string, label string, hint string")
    starts = spark.createDataFrame([("https://a.example/",)], "url string")
    found, visited = discovery.walk(links, starts, "2024-01-01", 10)
    # The second list page is older than the window, so the walk doesn't turn its page.
    assert {r["url"] for r in visited.collect()} == {"https://a.example/", "https://a.example/news/", "https://a.example/news/index_1.html"}
    assert {"https://a.example/art/2024/6/1/x.html", "https://a.example/art/2023/6/1/y.html"} <= {r["url"] for r in found.collect()}
    assert discovery.walk(links, starts, "2020-01-01", 10)[1].count() == 4
    assert discovery.walk(links.limit(0), starts, "2020-01-01", 10)[0].count() == 0


def test_robots_rules(spark):
    text = "User-agent: a\nUser-agent: *\nDisallow: /x # why\nAllow: /y\n\nUser-agent: b\nDisallow: /z\nnonsense\nUser-agent: *\nDisallow: /w\nDisallow:"
    rows = spark.createDataFrame([("h", text), ("g", None), ("f", "")], "host string, robots string")
    assert sorted(tuple(r) for r in files.robots_rules(rows).collect()) == [("h", "/w"), ("h", "/x")]


def test_until_older(spark):
    rows = spark.createDataFrame([(1, "2024-02-01"), (1, None), (2, "2023-01-01"), (2, "2024-01-02"), (3, "2023-01-01"), (4, "2024-05-01")], "page int, day string")
    assert sorted({r["page"] for r in files.until_older(rows, "day", "2024-01-01").collect()}) == [1, 2]
    assert files.until_older(rows.where("page < 3"), "day", "2024-01-01").count() == 4


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    rows = [("Spain", "a & <b>", 5, None, True), (None, None, None, None, None), ("", "x", 2.5, "y\nz", False), (None, None, 7, None, None)]
    assert workbook.write(path, ["Land\n", "Name", "MW", "Other", "Flag"], rows) == 4
    header, got = workbook.read(path)
    assert header == ["Land\n", "Name", "MW", "Other", "Flag"] and got[0] == ["Spain", "a & <b>", 5.0, None, True] and got[2][3] == "y\nz"
    fields = workbook.reference_rows(spark, path, {"country": ["Land"], "project_name": ["name"], "pv_capacity_mw": ["MW"]})
    assert sorted(tuple(r) for r in fields.na.fill("").collect()) == [("", "x", "2.5"), ("Spain", "a & <b>", "5")]
    assert workbook._letters(27) == "AB" and workbook._column("AB12") == 27


def test_workbook_export_shows_originals_where_foreign(spark, tmp_path):
    rows = spark.createDataFrame([("X", 1.0, {"country": "Y"}, True, "u1"), ("Z", None, None, False, "u2")], "country string, mw double, original map<string,string>, foreign boolean, url string")
    path = str(tmp_path / "b.xlsx")
    assert sinks.workbook_export(rows.withColumn("mw", F.when(F.col("foreign"), F.lit(None).cast("double")).otherwise(F.col("mw"))), ["country", "mw"], path) == 2
    assert workbook.read(path)[0] == ["country", "country (original)", "mw", "url"]


def test_rules_on_nulls_and_ties(spark):
    schema = "title string, text string, url string, page_type string, published string, failure string, error string"
    rows = [(None,) * 7, ("t", "", "u", "article", None, "TIMEOUT", None), ("中标光伏项目 100MW solar project under construction", "100MW under construction 中标光伏项目 " * 60, "https://a.example/news/1.html", "article", "2024", None, None)]
    df = spark.createDataFrame(rows, schema)
    q = [r["q"] for r in df.select(C.quality(*map(F.col, df.columns)).alias("q")).collect()]
    assert q[0]["reasons"] == ["EMPTY_BODY"] and q[1]["reasons"] == ["TIMEOUT"] and q[2]["reliable"] and q[2]["score"] >= 60
    f = [r["f"] for r in df.select(C.likelihood(F.col("title"), F.col("text"), F.col("url"), F.col("page_type"), F.col("published")).alias("f")).collect()]
    assert not f[0]["project"] and f[2]["project"] and f[2]["capacity"]
    s = [r["f"] for r in df.select(C.stated_fields(F.lit("印度尼西亚光伏 1.5GW 与储能 200MWh"), F.lit(None).cast("string")).alias("f")).collect()]
    assert s[0]["country"] == "印度尼西亚" and s[0]["pv_mw"] == 1500 and s[0]["storage_mwh"] == 200 and s[0]["kind"] == "光储"
    assert [r[0] for r in df.select(C.access_block(F.lit(200), F.col("title"), F.concat(F.lit("x" * 9000), F.lit("captcha")))).collect()] == [None] * 3


@pytest.mark.parametrize(("value", "expected"), [("2024-5", "2024-05-01"), ("on 3.4.2024", "2024-04-03"), ("Apr 5, 2024", "2024-04-05"), ("5 April 2024", "2024-04-05"), ("13-4-20245", None), ("2024年12月1日", "2024-12-01"), ("", None), (None, None), ("soon", None)])
def test_date_of(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(X.date_of(F.col("v"))).first()[0] == expected
    if value and not any(c.isalpha() and c.isascii() for c in value):
        assert html.date_in(value) == expected


def test_name_key_and_states(spark):
    df = spark.createDataFrame([("Ａlpha Solar-Park 2", "非原创"), ("solarpark 项目 pv", "转载"), (None, None), ("", "1")], "n string, o string")
    got = df.select(X.name_key(F.col("n")), X.name_tokens(F.col("n")), X.original_state(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [("alphapark2", ["alpha", "park"], True), ("solarpark项目", ["solarpark", "项目"], False), ("", [], None), ("", [], True)]
