"""File sources of the pipeline as DataFrames: delimited text, sitemaps, feeds, recorded API pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A header-first delimited file with doubled quotes; a byte-order mark is dropped, blank lines give no row."""
    reader = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def sitemap(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """``loc, lastmod`` of sitemap files. lastmod isn't a publication date, so only its lower bound prunes; unknown ones stay."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.where(F.col("loc").isNotNull() & (F.lit(start is None) | F.col("lastmod").isNull() | (F.substring("lastmod", 1, 10) >= F.lit(start or ""))))


def feed_items(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """``url, title, published`` of RSS items or Atom entries."""
    if kind == "rss":
        rows = spark.read.format("xml").option("rowTag", "item").schema("link string, title string, pubDate string").load(path)
        return rows.select(F.col("link").alias("url"), "title", F.col("pubDate").alias("published"))
    link = T.StructType([T.StructField("_href", T.StringType())])
    schema = T.StructType([T.StructField("link", link), T.StructField("title", T.StringType()), T.StructField("updated", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.select(F.col("link._href").alias("url"), "title", F.col("updated").alias("published"))


def recorded_pages(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of recorded API pages: JSON files, one page each, with an array ``records`` of ``record`` structs."""
    schema = f"page int, total int, records array<{record}>"
    pages = spark.read.schema(schema).option("multiLine", True).json(path)
    return pages.select("page", "total", F.explode("records").alias("r")).select("page", "total", "r.*")


def account_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``ghid, name, url`` from pasted account lines, parted by a bar, comma or tab; blank lines and comments give none."""
    parts = F.split(F.trim(column), r"\s*[|,\t]\s*")
    rows = lines.where(F.trim(column).rlike(r"^[^#\s]")).select(parts.alias("p"))
    ghid = F.filter("p", lambda x: x.rlike("^gh_[0-9a-zA-Z]+$"))
    name = F.filter("p", lambda x: ~x.rlike("^gh_[0-9a-zA-Z]+$") & (x != ""))
    return rows.select(F.get(ghid, F.lit(0)).alias("ghid"), F.get(name, F.lit(0)).alias("name")).where("ghid IS NOT NULL").select("ghid", "name", F.concat(F.lit("wechat://ghid/"), F.url_encode("ghid")).alias("url"))


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with host, path) that no rule of its host (host, disallow) forbids: an equi join on the host, then a prefix test."""
    hits = pages.join(rules.where("disallow <> ''"), "host").where(F.col("path").startswith(F.col("disallow"))).select("host", "path").distinct()
    return pages.join(hits, ["host", "path"], "left_anti")


def rename_by_alias(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to the field whose label or alias they carry (line breaks and outer space don't matter); others drop out."""
    by = {a.replace("\n", "").strip().casefold(): field for field, names in aliases.items() for a in [field, *names]}
    chosen: dict[str, Column] = {}
    for c in rows.columns:
        field = by.get(c.replace("\n", "").strip().casefold())
        if field and field not in chosen:
            chosen[field] = F.col(f"`{c}`").alias(field)
    return rows.select(*chosen.values())


def robots_rules(texts: DataFrame) -> DataFrame:
    """``host, disallow`` of the group for all agents of each robots text (host, robots)."""
    pairs = texts.select("host", F.filter(F.transform(F.split("robots", r"\r?\n"), lambda x: F.transform(F.split(F.regexp_replace(x, r"#.*$", ""), ":", 2), lambda y: F.trim(y))), lambda p: F.size(p) == 2).alias("p"))
    # Walks a text's lines with the state (group is for all, last line named an agent, paths); a text is one row.
    start = F.struct(F.lit(False).alias("all"), F.lit(False).alias("agent"), F.array().cast("array<string>").alias("paths"))

    def step(state: Column, p: Column) -> Column:
        name = F.lower(p[0])
        agent = name == "user-agent"
        own = F.when(agent, (p[1] == "*") | (state["agent"] & state["all"])).otherwise(state["all"])
        paths = F.when(~agent & (name == "disallow") & state["all"] & (p[1] != ""), F.concat(state["paths"], F.array(p[1]))).otherwise(state["paths"])
        return F.struct(own.alias("all"), agent.alias("agent"), paths.alias("paths"))

    return pairs.select("host", F.explode(F.array_distinct(F.aggregate("p", start, step)["paths"])).alias("disallow"))


def until_older(pages: DataFrame, date: str, start: str) -> DataFrame:
    """The records of pages (page, ...) up to the first page on which every ``date`` lies before ``start``; null dates don't end it."""
    old = pages.groupBy("page").agg(F.bool_and(F.coalesce(F.col(date) < start, F.lit(False))).alias("old"))
    end = old.where("old").agg(F.min("page").alias("_end"))
    return pages.join(F.broadcast(end), F.lit(True)).where(F.col("_end").isNull() | (F.col("page") < F.col("_end"))).drop("_end")
