from pyspark.sql import functions as F

from ampora.operators import resolve
from ampora.sources import files, sinks
from ampora.streaming import logs


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\na,"b,""c""",d\n\n')
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "a.csv")).collect()] == [("a", 'b,"c"', "d")]


def test_sitemap_and_feed(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a/1</loc><lastmod>2026-07-10</lastmod></url><url><loc>https://a/2</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a/3</loc></url></urlset>")
    assert sorted(r["loc"] for r in files.sitemap(spark, str(tmp_path / "s.xml"), "2026-07-01").collect()) == ["https://a/1", "https://a/3"]
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>t</title><link>https://a/1</link><pubDate>2026</pubDate></item></channel></rss>")
    assert [tuple(r) for r in files.feed_items(spark, str(tmp_path / "r.xml")).collect()] == [("https://a/1", "t", "2026")]


def test_recorded_pages_and_accounts(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"page":1,"total":2,"records":[{"id":"a"},{"id":"b"}]}')
    assert files.recorded_pages(spark, str(tmp_path / "p.json"), "struct<id:string>").count() == 2
    rows = spark.createDataFrame([("Name | gh_12ab",), ("# no",), ("",), ("gh_9,Other",), (None,)], "value string")
    assert sorted(tuple(r) for r in files.account_lines(rows).collect()) == [("gh_12ab", "Name", "wechat://ghid/gh_12ab"), ("gh_9", "Other", "wechat://ghid/gh_9")]


def test_robots_and_aliases(spark):
    pages = spark.createDataFrame([("h", "/private/a"), ("h", "/open"), ("g", "/private/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "/private/"), ("h", "")], "host string, disallow string")
    assert sorted(map(tuple, files.robots_allowed(pages, rules).collect())) == [("g", "/private/a"), ("h", "/open")]
    df = spark.createDataFrame([(1, 2)], ["Land ", "extra"])
    assert files.rename_by_alias(df, {"country": ["land"]}).columns == ["country"]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "html string")
    sinks.archive(pages, str(tmp_path / "arc"))
    sinks.archive(pages, str(tmp_path / "arc"))
    assert spark.read.parquet(str(tmp_path / "arc")).count() == 2
    projects = spark.createDataFrame([(1, "s", "review"), (2, "s", "approved"), (3, "t", "approved")], "row_id long, scan_id string, status string")
    try:
        sinks.snapshot(projects, "s", "n1", str(tmp_path / "snap"))
        raise AssertionError("an undecided scan was confirmed")
    except ValueError:
        pass
    sinks.snapshot(projects, "t", "n2", str(tmp_path / "snap"))
    assert sinks.json_export(spark, str(tmp_path / "snap"), "n2").first()[0] == '{"row_id":3,"scan_id":"t","status":"approved"}'
    assert sinks.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string"), ["x", "y"]).first()[0] == "| a\\|b |  |"


def test_resolve(spark):
    rows = [(1, "沙特阿拉伯哈登2吉瓦光伏电站项目", "沙特阿拉伯", 2000.0, None), (2, "沙特哈登2吉瓦光伏电站项目", "沙特", 2000.0, None), (3, "Alpha Solar Project", "Spain", 120.0, "x"), (4, "Alpha Solar Project", "Spain", 120.0, "x"), (5, "Alpha Solar Project", "越南", 120.0, "x"), (6, None, None, None, None), (7, "", "Spain", None, None)]
    got = {r["mention_id"]: r["entity_id"] for r in resolve.resolve(spark.createDataFrame(rows, "mention_id long, name string, country string, capacity double, party string")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 5
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.range(42).withColumnRenamed("id", "node")
    comp = {r["node"]: r["component"] for r in resolve.components(nodes, chain).collect()}
    assert {comp[i] for i in range(41)} == {0} and comp[41] == 41


def test_components_carry_no_plan_from_round_to_round(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    found = resolve.components(spark.range(10).withColumnRenamed("id", "node"), path)
    assert {r["node"]: r["component"] for r in found.collect()} == {**dict.fromkeys(range(9), 0), 9: 9}
    # What a checkpoint keeps of its plan grew from round to round.
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()


def test_resolve_scores_all_terms_and_loses_no_pair(spark):
    import itertools
    import random

    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    rows = [(1, "Kelmar Nord", "China", 10.0, None, None, "Olvik Grid", "Hafen"), (2, "Kelmar West Tal", "PR China", 10.2, None, None, "Olvik", "Alter Hafen"), (3, "Q", "Spain", None, 5.0, None, None, None), (4, "Very long Q7 name of a site", "Spain", None, None, None, None, None)]
    for i in range(5, 120):
        rows.append((i, " ".join(pick("Nord", "Tal", "Yengari", "Solar", "Bexgare", "哈登", "沙特哈登", "1", "x") for _ in range(rnd.randrange(1, 4))), pick("China", "PR China", "Spain", "TBD", None), pick(None, 10.0, 10.3, 50.0), pick(None, 5.0, 7.0), pick(None, 20.0), pick(None, "N/A", "Olvik", "Olvik Grid", "Ras"), pick(None, "Hafen", "Alter Hafen", "Tal 9")))
    schema = "mention_id long, name string, country string, capacity double, storage_power double, storage_energy double, party string, address string"
    got = {r["mention_id"]: r["entity_id"] for r in resolve.resolve(spark.createDataFrame(rows, schema)).collect()}

    def holds(a, b):
        return bool(a and b and (a in b or b in a))

    def score(x, y):
        (n, tn), (m, tm) = resolve.read(x[1]), resolve.read(y[1])
        c, e = resolve.read(x[2])[0], resolve.read(y[2])[0]
        if not n or not m or (c and e and not holds(c, e)):
            return 0
        g, h = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (n, m))
        name = 1 if holds(n, m) else max(len(set(tn) & set(tm)) / max(1, len(set(tn) | set(tm))), 2 * len(g & h) / max(1, len(g) + len(h)))
        both = [(p, q) for p, q in zip(x[3:6], y[3:6]) if p and q]
        near = sum(abs(p - q) / max(p, q) <= 0.05 for p, q in both) / len(both) if both else 0
        return 0.6 * name + 0.15 * bool(c and e) + 0.2 * near + 0.1 * sum(holds(resolve.read(x[k])[0], resolve.read(y[k])[0]) for k in (6, 7))

    label = {r[0]: r[0] for r in rows}
    for x, y in itertools.combinations(rows, 2):
        if score(x, y) >= 0.58:
            old, new = label[y[0]], label[x[0]]
            label = {k: new if v == old else v for k, v in label.items()}
    assert got[1] == got[2] and got[3] == got[4]
    for x, y in itertools.combinations(label, 2):
        assert (got[x] == got[y]) == (label[x] == label[y]), (rows[x - 1], rows[y - 1])


def test_streaming(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 11:00:00"), (3, "b", "2024-01-03 11:00:00")], "id long, url string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    logs.run_once(logs.deduplicated(stream, "url", "ts"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 2
    logs.run_once(logs.windowed_counts(stream, "ts", ["url"]), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "o2")).collect()] == [2]
