"""Files read and written, reviews, and streams, each query with its SQL form over the same rows.

What a query writes lies below the shared checkpoint folder, in a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.plans.registry import Registry
from ampora.session import checkpoint_dir, table
from ampora.sources import files, sinks, workbook
from ampora.streaming import logs

_R = Registry()
query, queries, oracle_sql = _R.query, _R.queries, _R.oracle_sql


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"


def _mark_up(rows, root: str, path: str) -> None:
    """Elements (column element) as files of about a thousand below one root element each."""
    files_ = max(1, -(-rows.count() // 1000))
    by = rows.groupBy(F.pmod(F.xxhash64("element"), F.lit(files_)).alias("file")).agg(F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list("element"), ""), F.lit(f"</{root}>")).alias("value"))
    by.write.partitionBy("file").text(path)


# --- files in -------------------------------------------------------------------------------------------------------


@query("SELECT source_id, source_name, coverage FROM sources")
def csv_sources(spark, d):
    """Sources written as delimited text and read back, quotes, commas and all."""
    path = _folder(spark)
    table(spark, d, "sources").select("source_id", "source_name", "coverage").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.csv_rows(spark, path, "source_id string, source_name string, coverage string")


@query(r"SELECT canonical_url AS loc, max(strftime(fetched_at, '%Y-%m-%d')) AS lastmod FROM documents WHERE canonical_url <> '' GROUP BY 1 HAVING max(strftime(fetched_at, '%Y-%m-%d')) >= '2024-06-01'")
def sitemap_entries(spark, d):
    """Addresses written as a sitemap and read back from a lower bound on."""
    path = _folder(spark)
    rows = table(spark, d, "documents").where("canonical_url <> ''").groupBy("canonical_url").agg(F.max(F.date_format("fetched_at", "yyyy-MM-dd")).alias("day"))
    safe = F.replace(F.col("canonical_url"), F.lit("&"), F.lit("&amp;"))
    _mark_up(rows.select(F.concat(F.lit("<url><loc>"), safe, F.lit("</loc><lastmod>"), "day", F.lit("</lastmod></url>")).alias("element")), "urlset", path)
    return files.sitemap(spark, path, "2024-06-01").select("loc", "lastmod")


@query(r"SELECT url, title, strftime(fetched_at, '%Y-%m-%d') AS published FROM dajiala_article WHERE url <> '' AND title IS NOT NULL AND fetched_at IS NOT NULL AND trim(title) = title")
def feed_entries(spark, d):
    """Articles written as a feed and read back."""
    path = _folder(spark)
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table(spark, d, "dajiala_article").where("url <> '' AND title IS NOT NULL AND fetched_at IS NOT NULL AND trim(title) = title")
    item = F.concat(F.lit("<item><title>"), safe("title"), F.lit("</title><link>"), safe("url"), F.lit("</link><pubDate>"), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("</pubDate></item>"))
    _mark_up(rows.select(item.alias("element")), "channel", path)
    return files.feed_items(spark, path).select("url", "title", "published")


@query(r"""
WITH p AS (SELECT record_id, (record_id // 20)::INT AS page, regexp_extract(recorded_at, '^20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) AS day FROM project_intel),
e AS (SELECT min(page) AS last FROM (SELECT page FROM p GROUP BY 1 HAVING bool_and(coalesce(nullif(day, '') < '2024-12-01', false))))
SELECT page, record_id FROM p, e WHERE last IS NULL OR page < last""")
def feed_pages(spark, d):
    """Recorded pages of twenty records, read up to the first page that is older than the window."""
    path = _folder(spark)
    rows = table(spark, d, "project_intel").select((F.col("record_id") / 20).cast("int").alias("page"), "record_id", F.nullif(F.regexp_extract("recorded_at", "^20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0), F.lit("")).alias("day"))
    rows.groupBy("page").agg(F.count("*").alias("total"), F.collect_list(F.struct("record_id", "day")).alias("records")).write.json(path)
    pages = spark.read.schema("page int, total int, records array<struct<record_id:bigint,day:string>>").json(path).select("page", F.explode("records").alias("r")).select("page", "r.*")
    return files.until_older(pages, "day", "2024-12-01").select("page", "record_id")


@query(r"SELECT DISTINCT ghid, account_name AS name, 'wechat://ghid/' || ghid AS url FROM dajiala_article WHERE regexp_full_match(ghid, 'gh_[0-9a-zA-Z]+') AND account_name <> ''")
def account_batch(spark, d):
    """Accounts pasted as lines and read back."""
    rows = table(spark, d, "dajiala_article").where("account_name <> ''").select("account_name", "ghid").distinct()
    return files.account_lines(rows.select(F.concat_ws(" | ", "account_name", "ghid").alias("value"))).where("name IS NOT NULL")


@query(r"""
WITH r AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM sources WHERE trust_level <= 3), d AS (SELECT doc_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM documents)
SELECT doc_id FROM d WHERE NOT (host IN (SELECT host FROM r) AND starts_with(path, '/news/'))""")
def robots_filter(spark, d):
    """Documents that their host's robots text allows: the group for all agents decides, others don't."""
    host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]+)", 1)
    robots = F.when(F.col("trust_level") <= 3, "User-agent: other\nUser-agent: *\nDisallow: /news/ # closed\nDisallow:\n").otherwise("User-agent: other\nDisallow: /\nUser-agent: *\nDisallow:\n")
    rules = files.robots_rules(table(spark, d, "sources").where("url IS NOT NULL").select(host("url").alias("host"), robots.alias("robots")))
    docs = table(spark, d, "documents").select("doc_id", host("url").alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    # The longest paths are few per host; an equi join on the host, then a prefix test.
    hits = docs.join(F.broadcast(rules), "host").where(F.startswith("path", "disallow")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select("doc_id")


@query(r"""
SELECT DISTINCT coalesce(nullif(fields_json->>'country', ''), NULL) AS country, nullif(fields_json->>'project_name', '') AS project_name, nullif(fields_json->>'owner', '') AS owner FROM projects
WHERE status = 'approved' AND score >= 80 AND trim(fields_json->>'country') = fields_json->>'country' AND coalesce(nullif(fields_json->>'project_name', ''), nullif(fields_json->>'country', '')) IS NOT NULL""")
def workbook_rows(spark, d):
    """Reference rows written as a workbook and read back by the labels of its header."""
    rows = table(spark, d, "projects").where("status = 'approved' AND score >= 80")
    f = lambda k: F.nullif(F.get_json_object("fields_json", f"$.{k}"), F.lit("")).alias(k)
    chosen = rows.select(f("country"), f("project_name"), f("owner")).where("trim(country) = country AND coalesce(project_name, country) IS NOT NULL").distinct()
    data = chosen.limit(workbook.MAX_ROWS + 1).collect()
    if len(data) > workbook.MAX_ROWS:
        return chosen  # more than a workbook may hold: the rows themselves
    path = os.path.join(tempfile.mkdtemp(prefix="ampora-"), "reference.xlsx")  # read again by this same process
    workbook.write(path, ["Land\n", "Projekt", "业主", "other"], [(*r, None) for r in data])
    return workbook.reference_rows(spark, path, {"country": ["Land"], "project_name": ["Projekt"], "owner": ["业主"]})


@query(r"SELECT DISTINCT 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' AS url FROM documents WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) <> '' AND 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' NOT IN (SELECT url FROM sources WHERE url IS NOT NULL AND enabled)")
def imported_sources(spark, d):
    """Hosts of documents that become sources because none that is enabled has their address."""
    new = table(spark, d, "documents").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("h")).where("h <> ''").distinct().select(F.concat(F.lit("https://"), "h", F.lit("/")).alias("url"))
    return new.join(F.broadcast(table(spark, d, "sources").where("enabled").select("url")), "url", "left_anti")


# --- files out ------------------------------------------------------------------------------------------------------


@query(r"""
WITH o AS (SELECT * FROM projects WHERE scan_id = (SELECT min(scan_id) FROM projects)), c AS (SELECT count(*) AS n, count(*) FILTER (status IN ('approved', 'auto_approved')) AS r FROM o)
SELECT unnest(['# Report', '- rows: ' || n, '- reviewed: ' || r, '- doubtful: ' || (n - r)]) AS line FROM c
UNION ALL SELECT '- ' || page_type || ': ' || count(*) FROM documents WHERE page_type IS NOT NULL GROUP BY page_type
UNION ALL SELECT unnest(['| country | owner | url | score | status |', '| --- | --- | --- | --- | --- |'])
UNION ALL SELECT '| ' || concat_ws(' | ', regexp_replace(replace(coalesce(fields_json->>'country', ''), '|', '\|'), '\s*\n\s*', ' ', 'g'), regexp_replace(replace(coalesce(fields_json->>'owner', ''), '|', '\|'), '\s*\n\s*', ' ', 'g'), coalesce(primary_url, ''), CAST(score AS VARCHAR), status) || ' |' FROM o
UNION ALL SELECT '- ' || lpad(row_id::VARCHAR, 20, '0') || ': ' || coalesce(nullif(array_to_string(list_transform(from_json(conflicts_json, '[{"field":"VARCHAR"}]'), lambda c: c.field), ', '), ''), 'to be confirmed') FROM o WHERE json_array_length(conflicts_json) > 0 OR status = 'review'""")
def report(spark, d):
    """The lines of the report on the first scan."""
    p = table(spark, d, "projects")
    first = p.agg(F.min("scan_id")).first()[0]
    coverage = table(spark, d, "documents").where("page_type IS NOT NULL").groupBy(F.col("page_type").alias("label")).agg(F.count("*").alias("n"))
    return sinks.report_lines(p.where(F.col("scan_id") == F.lit(first)), coverage, ["country", "owner"]).select("line")


@query(r"SELECT row_id, status, score FROM projects WHERE scan_id = (SELECT min(scan_id) FROM projects)")
def snapshot_export(spark, d):
    """A confirmed snapshot of the first scan, exported as JSON and read back."""
    p = table(spark, d, "projects")
    first, path = p.agg(F.min("scan_id")).first()[0], _folder(spark)
    sinks.snapshot(p.select("scan_id", "row_id", "status", "score"), first or "", "n1", path, include_flagged=True)
    out = f"{path}/json"
    sinks.json_export(spark, path, "n1").write.text(out)
    return spark.read.schema("row_id bigint, status string, score double").json(out)


@query("SELECT count(DISTINCT sha256(html)) AS pages, sum(length(html)) > 0 AS filled FROM page_capture WHERE html IS NOT NULL")
def archived_pages(spark, d):
    """Pages archived twice by their content's digest: each stands there once."""
    path, pages = _folder(spark), table(spark, d, "page_capture").select("html")
    sinks.archive(pages, path)
    sinks.archive(pages, path)
    return spark.read.parquet(path).agg(F.count("*").alias("pages"), (F.sum(F.length("html")) > 0).alias("filled"))


@query()
def export_registry(spark, d):
    """The files of an export with their sizes."""
    path = _folder(spark)
    table(spark, d, "scans").select("scan_id", "status").write.json(path)
    return sinks.registered_files(spark, path)


@query(r"""
WITH u AS (SELECT row_id, unnest(list_distinct(list_concat([primary_url], from_json(source_urls_json, '["VARCHAR"]')))) AS url FROM projects WHERE status = 'approved'),
m AS (SELECT d.doc_id, min(u.row_id) AS row_id FROM documents d JOIN u ON d.canonical_url = u.url GROUP BY 1)
SELECT m.doc_id, m.row_id, d.url, d.title, d.status_code, sha256(coalesce(d.text, '')) AS digest FROM m JOIN documents d USING (doc_id)""")
def evidence_manifest(spark, d):
    """The documents behind confirmed rows, each once, with what a bundle says of them."""
    urls = F.array_distinct(F.concat(F.array("primary_url"), F.from_json("source_urls_json", "array<string>")))
    by = table(spark, d, "projects").where("status = 'approved'").select("row_id", F.explode(urls).alias("canonical_url")).where("canonical_url IS NOT NULL").groupBy("canonical_url").agg(F.min("row_id").alias("row_id"))
    docs = table(spark, d, "documents").where("canonical_url IS NOT NULL").select("doc_id", "canonical_url", "url", "title", "status_code", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return docs.join(by, "canonical_url").select("doc_id", "row_id", "url", "title", "status_code", "digest")


@query(r"""SELECT d.doc_id, coalesce(s.source_name, '') AS account, coalesce(d.published_at, '') AS published, coalesce(d.title, '') AS title, md5(trim(regexp_replace(coalesce(d.text, ''), '^[^\n]*：[^\n]*\n正文：\s*', ''), ' ' || chr(10) || chr(9) || chr(13) || '　')) AS body FROM documents d LEFT JOIN sources s USING (source_id)""")
def full_texts(spark, d):
    """Account, date, title and body of every document."""
    names = table(spark, d, "sources").select("source_id", "source_name").dropDuplicates(["source_id"])
    docs = table(spark, d, "documents").select("doc_id", "source_id", "published_at", "title", "text").join(names, "source_id", "left")
    body = X.bare(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[^\n]*：[^\n]*\n正文：\s*", ""))
    empty = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return docs.select("doc_id", empty("source_name", "account"), empty("published_at", "published"), empty("title", "title"), F.md5(body.cast("binary")).alias("body"))


# --- rows written again ---------------------------------------------------------------------------------------------


@query(r"""
WITH n AS (SELECT row_id, 'approved' AS status, revision + 1 AS revision, TIMESTAMP '2030-01-01' AS updated_at FROM projects WHERE row_id % 3 = 0), a AS (SELECT row_id, status, revision, updated_at FROM projects UNION ALL SELECT * FROM n)
SELECT row_id, status, revision FROM a QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY updated_at DESC NULLS LAST, revision DESC) = 1""")
def replaced_rows(spark, d):
    """Rows replaced by newer ones of the same key, others kept."""
    old = table(spark, d, "projects").select("row_id", "status", "revision", "updated_at")
    new = old.where("row_id % 3 = 0").select("row_id", F.lit("approved").alias("status"), (F.col("revision") + 1).alias("revision"), F.lit("2030-01-01").cast("timestamp").cast(old.schema["updated_at"].dataType).alias("updated_at"))
    return latest(old.unionByName(new), ["row_id"], ["updated_at", "revision"])


def latest(rows, keys: list[str], order: list[str]):
    """The last row of each key by ``order`` (nulls first), found with partial maxima."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}") for c in rest if c not in order or c == "revision"])


@query(r"""
WITH p AS (SELECT row_id, json_merge_patch(fields_json, '{"country":"X","stage":"new"}') AS j FROM projects)
SELECT row_id, j->>'country' AS country, j->>'stage' AS stage, j->>'owner' AS owner, len(json_keys(j)) AS fields FROM p""")
def patched_fields(spark, d):
    """Each row's fields with a patch over them: its values win, others stay."""
    patch = F.create_map(F.lit("country"), F.lit("X"), F.lit("stage"), F.lit("new"))
    fields = F.from_json("fields_json", "map<string,string>")
    kept = F.map_filter(fields, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    rows = table(spark, d, "projects").select("row_id", F.map_concat(kept, patch).alias("m"))
    return rows.select("row_id", F.col("m")["country"].alias("country"), F.col("m")["stage"].alias("stage"), F.try_element_at("m", F.lit("owner")).alias("owner"), F.size("m").alias("fields"))


@query(r"""
SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 'approved' WHEN row_id % 4 = 1 THEN 'rejected' ELSE status END AS status, CASE WHEN row_id % 4 < 2 THEN revision + 1 ELSE revision END AS revision FROM projects""")
def review_decisions(spark, d):
    """Rows after single decisions: the decided ones get their new status and one revision more."""
    p = table(spark, d, "projects").select("row_id", "status", "revision")
    decisions = p.where("row_id % 4 < 2").select("row_id", F.when(F.col("row_id") % 4 == 0, "approved").otherwise("rejected").alias("decision"))
    return decided(p, decisions)


def decided(rows, decisions):
    """``rows`` (row_id, status, revision) after ``decisions`` (row_id, decision), one per row."""
    joined = rows.join(decisions, "row_id", "left")
    return joined.select("row_id", F.coalesce("decision", "status").alias("status"), (F.col("revision") + F.col("decision").isNotNull().cast("int")).alias("revision"))


@query(r"""
WITH s AS (SELECT source_id, source_name, enabled FROM sources WHERE source_id <> 'src-05'), n AS (SELECT 'src-99' AS source_id, 'new' AS source_name, true AS enabled)
SELECT source_id, source_name, CASE WHEN source_id = 'src-01' THEN NOT enabled ELSE enabled END AS enabled FROM (SELECT * FROM s UNION ALL SELECT * FROM n)""")
def changed_sources(spark, d):
    """Sources after one is deleted, one changed and one added."""
    s = table(spark, d, "sources").select("source_id", "source_name", "enabled").where("source_id <> 'src-05'")
    new = spark.createDataFrame([("src-99", "new", True)], "source_id string, source_name string, enabled boolean")
    return s.unionByName(new).withColumn("enabled", F.when(F.col("source_id") == "src-01", ~F.col("enabled")).otherwise(F.col("enabled")))


# What may follow a state of the queue.
STATES = {"pending": ("running",), "running": ("done", "failed", "pending"), "failed": ("pending",), "done": ()}


@query(r"""
WITH e AS (SELECT doc_id, source_id, ['pending', 'running', 'done', 'failed'][1 + doc_id % 4] AS state, lag(['pending', 'running', 'done', 'failed'][1 + doc_id % 4]) OVER (PARTITION BY source_id, doc_id // 4 ORDER BY doc_id) AS before FROM documents)
SELECT coalesce(before, '') AS before, state, count(*) AS n, count(*) FILTER (before IS NOT NULL AND NOT list_contains(CASE before WHEN 'pending' THEN ['running'] WHEN 'running' THEN ['done', 'failed', 'pending'] WHEN 'failed' THEN ['pending'] ELSE CAST([] AS VARCHAR[]) END, state)) AS invalid FROM e GROUP BY 1, 2""")
def queue_transitions(spark, d):
    """Changes of state in the queue with those that aren't allowed."""
    names = F.array(*map(F.lit, ("pending", "running", "done", "failed")))
    # A work item is four steps here, so its window is small however many items a source has.
    rows = table(spark, d, "documents").select("doc_id", "source_id", names[(F.col("doc_id") % 4).cast("int")].alias("state"), F.floor(F.col("doc_id") / 4).alias("item"))
    steps = rows.withColumn("before", F.lag("state").over(W.partitionBy("source_id", "item").orderBy("doc_id")))
    allowed = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for pair in STATES.items() for x in pair))
    bad = F.col("before").isNotNull() & ~F.array_contains(allowed[F.col("before")], F.col("state"))
    return steps.groupBy(F.coalesce("before", F.lit("")).alias("before"), "state").agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid"))


@query(r"""SELECT row_id, greatest(score, CASE WHEN row_id % 2 = 0 THEN 70.0 END) AS score, len(list_distinct(list_concat(from_json(source_urls_json, '["VARCHAR"]'), ['https://deep.example/1']))) AS urls FROM projects""")
def deepened_rows(spark, d):
    """Rows after a second, targeted pass: the better score, the union of addresses."""
    urls = F.array_union(F.coalesce(F.from_json("source_urls_json", "array<string>"), F.array().cast("array<string>")), F.array(F.lit("https://deep.example/1")))
    return table(spark, d, "projects").select("row_id", F.greatest("score", F.when(F.col("row_id") % 2 == 0, 70.0)).alias("score"), F.size(urls).alias("urls"))


# --- streams --------------------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT event_id) AS events FROM events")
def stream_deduplicated(spark, d):
    """Events seen once by key within the watermark, from a stream run to its end."""
    path = _folder(spark)
    source = f"{d}/events.parquet"
    events = spark.read.parquet(source)
    time = next(c for c, t in events.dtypes if t.startswith("timestamp"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(os.path.dirname(source), pathGlobFilter="events.parquet") if os.path.isfile(source) else spark.readStream.schema(events.schema).parquet(source)
    logs.run_once(logs.deduplicated(stream.select("event_id", time), "event_id", time, "3650 days"), f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("events"))
