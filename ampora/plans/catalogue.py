"""Queries of the document pipeline's own operators, each with its SQL form over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.operators import resolve, units
from ampora.operators.classify import article_url
from ampora.session import checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL form."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _ok():
    return (F.col("status_code") == 200) & F.col("failure_code").isNull()


# --- aggregations -------------------------------------------------------------------------------------------------------


@query("SELECT source_id, count(*) AS pages, count(*) FILTER (status_code = 200 AND failure_code IS NULL) AS succeeded, count(*) * 1.0 / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY source_id")
def source_distribution(spark, d):
    """Pages and successes of each source with its share of all pages."""
    by = table(spark, d, "documents").groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(_ok()).alias("succeeded"))
    # The window runs over one row per source, after the aggregation.
    return by.withColumn("share", F.col("pages") * 1.0 / F.sum("pages").over(W.partitionBy()))


@query("SELECT failure_code, count(*) AS n FROM documents WHERE failure_code IS NOT NULL GROUP BY 1")
def failure_histogram(spark, d):
    """Failures by code."""
    return table(spark, d, "documents").where("failure_code IS NOT NULL").groupBy("failure_code").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS pages, count(*) FILTER (status_code = 200 AND failure_code IS NULL) AS fetched, count(*) FILTER (text IS NOT NULL AND length(text) > 0) AS with_text, count(*) FILTER (published_at IS NOT NULL) AS dated, count(raw_path) AS captured, count(DISTINCT canonical_url) AS addresses FROM documents")
def audit_funnel(spark, d):
    """What is left of all pages after each stage, in one pass."""
    c = F.col
    return table(spark, d, "documents").agg(F.count("*").alias("pages"), F.count_if(_ok()).alias("fetched"), F.count_if(c("text").isNotNull() & (F.length("text") > 0)).alias("with_text"), F.count("published_at").alias("dated"), F.count("raw_path").alias("captured"), F.countDistinct("canonical_url").alias("addresses"))


@query("SELECT source_id, count(*) AS total, count(*) FILTER (failure_code IS NULL) AS succeeded, count(failure_code) AS failed, bool_and(failure_code IS NULL) AS all_settled, max(attempt_count) AS most_attempts FROM documents GROUP BY 1")
def source_coverage(spark, d):
    """Coverage of each source."""
    f = F.col("failure_code")
    return table(spark, d, "documents").groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(f.isNull()).alias("succeeded"), F.count(f).alias("failed"), F.bool_and(f.isNull()).alias("all_settled"), F.max("attempt_count").alias("most_attempts"))


@query("SELECT page_type, fetch_mode, count(*) AS n FROM documents GROUP BY ALL")
def page_type_counts(spark, d):
    """Documents by page type and way of fetching."""
    return table(spark, d, "documents").groupBy("page_type", "fetch_mode").agg(F.count("*").alias("n"))


@query("SELECT status, count(*) AS n, coalesce(sum(revision), 0)::BIGINT AS revisions, max(score) AS best FROM projects GROUP BY 1")
def project_status_counts(spark, d):
    """Projects by status."""
    return table(spark, d, "projects").groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("revision"), F.lit(0)).cast("bigint").alias("revisions"), F.max("score").alias("best"))


@query("SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'sources', count(*) FROM sources WHERE enabled UNION ALL SELECT 'feed', count(*) FROM project_intel UNION ALL SELECT 'articles', count(*) FROM dajiala_article")
def dashboard(spark, d):
    """The dashboard's counts."""
    one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    parts = [one("documents", table(spark, d, "documents")), one("projects", table(spark, d, "projects")), one("sources", table(spark, d, "sources").where("enabled")), one("feed", table(spark, d, "project_intel")), one("articles", table(spark, d, "dajiala_article"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL")
def context_rollup(spark, d):
    """Events by type and a value of their JSON context."""
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def daily_event_counts(spark, d):
    """Events of each day."""
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT l_orderkey, count(*) AS parts, count(DISTINCT l_partkey) AS distinct_parts, count(*) FILTER (l_linenumber = 1) AS primaries FROM lineitem GROUP BY 1")
def bridge_counts(spark, d):
    """Members of each many-to-many bridge with its primaries."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.countDistinct("l_partkey").alias("distinct_parts"), F.count_if(F.col("l_linenumber") == 1).alias("primaries"))


# --- joins --------------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.title, coalesce(s.source_name, d.source_id, 'unknown') AS source_name, s.trust_level FROM documents d LEFT JOIN sources s USING (source_id)")
def articles_with_source(spark, d):
    """Documents with their source's name."""
    s = table(spark, d, "sources").select("source_id", "source_name", "trust_level")
    return table(spark, d, "documents").select("doc_id", "title", "source_id").join(s, "source_id", "left").select("doc_id", "title", F.coalesce("source_name", "source_id", F.lit("unknown")).alias("source_name"), "trust_level")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND NOT EXISTS (SELECT 1 FROM page_capture p WHERE p.raw_path = documents.raw_path)")
def without_capture(spark, d):
    """Documents whose page isn't archived."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND length(text) > 0").select("doc_id", "raw_path")
    # Two thirds have no path: they never meet the join, where they would be one key.
    missing = docs.where("raw_path IS NOT NULL").join(table(spark, d, "page_capture").select("raw_path"), "raw_path", "left_anti")
    return docs.where("raw_path IS NULL").select("doc_id").unionByName(missing.select("doc_id"))


@query("SELECT raw_path, status_code FROM page_capture p WHERE EXISTS (SELECT 1 FROM documents d WHERE d.raw_path = p.raw_path)")
def captures_in_use(spark, d):
    """Archived pages that a document still uses."""
    return table(spark, d, "page_capture").select("raw_path", "status_code").join(table(spark, d, "documents").select("raw_path"), "raw_path", "left_semi")


@query("SELECT d.doc_id, coalesce(p.url, d.url) AS url, coalesce(p.content_type, d.content_type) AS content_type FROM documents d LEFT JOIN page_capture p USING (raw_path)")
def coalescing_lookup(spark, d):
    """The archived page's address, else the document's."""
    p = table(spark, d, "page_capture").select("raw_path", F.col("url").alias("p_url"), F.col("content_type").alias("p_type"))
    docs = table(spark, d, "documents").select("doc_id", "raw_path", "url", "content_type")
    found = docs.where("raw_path IS NOT NULL").join(p, "raw_path", "left").select("doc_id", F.coalesce("p_url", "url").alias("url"), F.coalesce("p_type", "content_type").alias("content_type"))
    return found.unionByName(docs.where("raw_path IS NULL").select("doc_id", "url", "content_type"))


@query("WITH x AS (SELECT scan_id, unnest(source_ids) AS source_id, unnest(range(len(source_ids))) AS pos FROM scans) SELECT scan_id, pos::INT AS pos, source_id, source_name FROM x JOIN sources USING (source_id)")
def scan_sources(spark, d):
    """A scan's sources in the order given; unknown ids drop out."""
    x = table(spark, d, "scans").select("scan_id", F.posexplode("source_ids").alias("pos", "source_id"))
    return x.join(table(spark, d, "sources").select("source_id", "source_name"), "source_id").select("scan_id", "pos", "source_id", "source_name")


@query(r"SELECT doc_id, s.source_id AS by_host FROM documents d LEFT JOIN sources s ON regexp_extract(d.url, '^https?://([^/]+)', 1) = regexp_extract(s.url, '^https?://([^/]+)', 1)")
def source_by_host(spark, d):
    """The source that a document's host belongs to."""
    host = lambda c: F.regexp_extract(c, r"^https?://([^/]+)", 1)
    s = table(spark, d, "sources").select(F.col("source_id").alias("by_host"), host("url").alias("h"))
    return table(spark, d, "documents").select("doc_id", host("url").alias("h")).join(s, "h", "left").select("doc_id", "by_host")


@query("SELECT start_date, end_date, list_sort(list_distinct(source_ids)) AS source_set, count(*) AS scans, min(scan_id) AS first_scan FROM scans GROUP BY ALL")
def same_source_sets(spark, d):
    """Scans over the same dates and the same set of sources."""
    return table(spark, d, "scans").groupBy("start_date", "end_date", F.array_sort(F.array_distinct("source_ids")).alias("source_set")).agg(F.count("*").alias("scans"), F.min("scan_id").alias("first_scan"))


@query("SELECT d.doc_id, contains(d.text, s.source_name) AS named FROM documents d JOIN sources s USING (source_id) WHERE d.text IS NOT NULL")
def hint_containment(spark, d):
    """Whether a document's text holds its source's name."""
    s = table(spark, d, "sources").select("source_id", "source_name")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "source_id", "text").join(s, "source_id").select("doc_id", F.col("text").contains(F.col("source_name")).alias("named"))


@query("WITH u AS (SELECT row_id, unnest(from_json(source_urls_json, '[\"VARCHAR\"]')) AS url, primary_url FROM projects) SELECT row_id, count(*) AS urls, count(DISTINCT url) AS distinct_urls, bool_or(url = primary_url) AS has_primary FROM u GROUP BY 1")
def evidence_bridge(spark, d):
    """A project's source addresses, and whether the primary one is among them."""
    u = table(spark, d, "projects").select("row_id", "primary_url", F.explode(F.from_json("source_urls_json", "array<string>")).alias("url"))
    return u.groupBy("row_id").agg(F.count("*").alias("urls"), F.countDistinct("url").alias("distinct_urls"), F.bool_or(F.col("url") == F.col("primary_url")).alias("has_primary"))


@query("WITH x AS (SELECT scan_id, unnest(list_distinct(source_ids)) AS s, len(list_distinct(source_ids)) AS n FROM scans) SELECT a.scan_id AS scan_a, b.scan_id AS scan_b, count(*) AS shared, count(*) * 1.0 / (min(a.n) + min(b.n) - count(*)) AS jaccard FROM x a JOIN x b ON a.s = b.s AND a.scan_id < b.scan_id GROUP BY ALL")
def source_set_overlap(spark, d):
    """How much two scans' sets of sources overlap (the scans are few and their number is fixed)."""
    x = table(spark, d, "scans").select("scan_id", F.explode(F.array_distinct("source_ids")).alias("s"), F.size(F.array_distinct("source_ids")).alias("n"))
    j = x.alias("a").join(x.alias("b"), F.expr("a.s = b.s AND a.scan_id < b.scan_id"))
    return j.groupBy(F.col("a.scan_id").alias("scan_a"), F.col("b.scan_id").alias("scan_b")).agg(F.count("*").alias("shared"), (F.count("*") * 1.0 / (F.min("a.n") + F.min("b.n") - F.count("*"))).alias("jaccard"))


# --- ranking, order, windows --------------------------------------------------------------------------------------------


@query("SELECT doc_id, canonical_url FROM (SELECT doc_id, canonical_url, row_number() OVER (PARTITION BY canonical_url ORDER BY fetched_at, doc_id) AS n FROM documents) WHERE n = 1")
def first_write_wins(spark, d):
    """The first document of each canonical address; min over a struct combines before the shuffle, so hot addresses cost nothing."""
    first = F.min(F.struct(F.coalesce(F.col("fetched_at").cast("string"), F.lit("9999")).alias("t"), "doc_id")).alias("f")
    return table(spark, d, "documents").groupBy("canonical_url").agg(first).select("f.doc_id", "canonical_url")


@query("SELECT _index, record_id FROM (SELECT _index, record_id, row_number() OVER (PARTITION BY _index ORDER BY ingested_at DESC, record_id DESC) AS n FROM project_intel) WHERE n = 1")
def latest_delivery(spark, d):
    """The latest delivery of each feed record."""
    return table(spark, d, "project_intel").groupBy("_index").agg(F.max(F.struct("ingested_at", "record_id")).alias("m")).select("_index", "m.record_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def log_sequence(spark, d):
    """Log lines numbered within their scan."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", n.cast("bigint").alias("sequence"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 20")
def log_page_after_cursor(spark, d):
    """One page of the log after a cursor (the limit is the feature)."""
    return table(spark, d, "events").where("event_id > 100").orderBy("event_id").limit(20).select("event_id", "user_id", "event_type")


@query("SELECT scan_id, created_at, status FROM scans ORDER BY created_at DESC, scan_id LIMIT 6")
def recent_scans(spark, d):
    """The six latest scans (the limit is the feature)."""
    return table(spark, d, "scans").orderBy(F.desc("created_at"), "scan_id").limit(6).select("scan_id", "created_at", "status")


_SCORE_SQL = r"(CASE WHEN regexp_matches(url, '/(news|detail)/|\.html') THEN 45 ELSE 0 END + CASE WHEN regexp_matches(coalesce(title, ''), '(?i)MW|solar|储能|光伏|wind') THEN 22 ELSE 0 END - CASE WHEN regexp_matches(url, '/about|/list') THEN 30 ELSE 0 END + CASE WHEN published_at IS NOT NULL THEN 20 ELSE 0 END)"


def _score():
    title = F.coalesce("title", F.lit(""))
    return F.when(F.col("url").rlike(r"/(news|detail)/|\.html"), 45).otherwise(0) + F.when(title.rlike("(?i)MW|solar|储能|光伏|wind"), 22).otherwise(0) - F.when(F.col("url").rlike("/about|/list"), 30).otherwise(0) + F.when(F.col("published_at").isNotNull(), 20).otherwise(0)


@query(f"SELECT source_id, doc_id, score, n FROM (SELECT source_id, doc_id, {_SCORE_SQL} AS score, row_number() OVER (PARTITION BY source_id ORDER BY {_SCORE_SQL} DESC, doc_id) AS n FROM documents) WHERE n <= 5")
def candidate_rank_topn(spark, d):
    """The five best candidates of each source; the rank filter prunes before the shuffle (WindowGroupLimit)."""
    s = table(spark, d, "documents").select("source_id", "doc_id", _score().alias("score"))
    n = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), "doc_id"))
    return s.withColumn("n", n).where("n <= 5").select("source_id", "doc_id", "score", F.col("n").cast("bigint").alias("n"))


@query("WITH o AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source_id FROM documents)), q AS (SELECT source_id, greatest(1, 250 // n + CASE WHEN i < 250 % n THEN 1 ELSE 0 END) AS quota FROM o), r AS (SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS k FROM documents) SELECT source_id, doc_id FROM r JOIN q USING (source_id) WHERE k <= quota")
def fair_quota(spark, d):
    """A budget of 250 pages shared fairly by the sources."""
    docs = table(spark, d, "documents").select("source_id", "doc_id")
    ids = docs.select("source_id").distinct()  # one row per source: the windows below are small
    o = ids.select("source_id", (F.row_number().over(W.orderBy("source_id")) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    q = o.select("source_id", F.greatest(F.lit(1), F.floor(F.lit(250) / F.col("n")) + F.when(F.col("i") < F.lit(250) % F.col("n"), 1).otherwise(0)).alias("quota"))
    k = F.row_number().over(W.partitionBy("source_id").orderBy("doc_id"))
    # No quota exceeds the budget, so the first filter prunes before the join.
    return docs.withColumn("k", k).where("k <= 250").join(q, "source_id").where("k <= quota").select("source_id", "doc_id")


@query("SELECT project_name, country, record_id FROM (SELECT project_name, country, record_id, row_number() OVER (PARTITION BY project_name, country ORDER BY record_id) AS n FROM project_intel) WHERE n = 1")
def first_per_signature(spark, d):
    """The first feed record of each name and country."""
    return table(spark, d, "project_intel").groupBy("project_name", "country").agg(F.min("record_id").alias("record_id"))


@query("SELECT user_id, event_id, spent FROM (SELECT user_id, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events) WHERE spent <= 100000")
def running_cost_cap(spark, d):
    """The calls of each scan until its budget is spent."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w).alias("spent")).where("spent <= 100000")


@query("SELECT before, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY ALL")
def state_transitions(spark, d):
    """How often each state follows each other."""
    lag = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_type", lag.alias("before")).groupBy("before", "event_type").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT user_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1) // 20 AS page FROM events) SELECT user_id, page::BIGINT AS page, min(ts) AS oldest, max(ts) AS newest, bool_and(ts < TIMESTAMP '2024-01-15') AS all_older FROM r GROUP BY ALL")
def early_stop_pages(spark, d):
    """Pages of 20 log lines, and whether a page is wholly older than a date."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    r = table(spark, d, "events").select("user_id", "ts", F.floor((n - 1) / 20).alias("page"))
    return r.groupBy("user_id", "page").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.bool_and(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("all_older"))


@query("WITH f AS (SELECT user_id, event_id, ts, value < 20 AS failed, lag(value < 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, coalesce(failed AND before, false) AS opens, coalesce(max(CASE WHEN failed AND before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::INT AS disabled FROM f")
def circuit_breaker(spark, d):
    """Where two failures in a row open an origin's circuit, and whether it has ever opened before."""
    o = W.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value") < 20).alias("failed")).withColumn("before", F.lag("failed").over(o))
    opens = F.coalesce(F.col("failed") & F.col("before"), F.lit(False))
    return f.select("user_id", "event_id", opens.alias("opens"), F.max(F.when(opens, 1).otherwise(0)).over(o.rowsBetween(W.unboundedPreceding, 0)).alias("disabled"))


# --- scalar functions ---------------------------------------------------------------------------------------------------

_CANON = r"""regexp_replace(trim(url), '#.*$', '')"""


@query(rf"""WITH a AS (SELECT doc_id, {_CANON} AS u FROM documents), b AS (SELECT doc_id, CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN u ELSE 'https://' || u END AS u FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '(?i)([?&])(utm_[^=&]*|spm|from|source|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]$', '') AS u FROM b)
SELECT doc_id, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE '' END AS canonical FROM c""")
def canonical_urls(spark, d):
    """Addresses without fragment and tracking parameters."""
    return table(spark, d, "documents").select("doc_id", X.canonical_url(F.col("url")).alias("canonical"))


@query(r"""
WITH p AS (SELECT doc_id, string_split_regex(regexp_extract(published_at, '20[0-9]{2}[年./-][0-9]{1,2}([月./-][0-9]{1,2})?', 0), '[^0-9]+') AS y,
  string_split_regex(regexp_extract(' ' || published_at || ' ', '[^0-9]([0-9]{1,2}[./-][0-9]{1,2}[./-]20[0-9]{2})[^0-9]', 1), '[^0-9]+') AS z,
  try_strptime(trim(published_at), ['%b %-d, %Y', '%B %-d, %Y', '%-d %b %Y', '%-d %B %Y', '%b %-d %Y', '%-d-%b-%y', '%-d-%b-%Y']) AS n FROM documents)
SELECT doc_id, CASE WHEN len(y) >= 2 THEN y[1] || '-' || lpad(y[2], 2, '0') || '-' || CASE WHEN len(y) > 2 THEN lpad(y[3], 2, '0') ELSE '01' END
  WHEN len(z) = 3 THEN z[3] || '-' || lpad(z[2], 2, '0') || '-' || lpad(z[1], 2, '0') ELSE strftime(n, '%Y-%m-%d') END AS day FROM p""")
def date_from_text(spark, d):
    """The first date that published_at shows."""
    return table(spark, d, "documents").select("doc_id", X.date_of(F.col("published_at")).alias("day"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS cleaned FROM documents")
def text_cleanup(spark, d):
    """Texts with their white space put right, as a digest."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("cleaned"))


@query(r"""WITH a AS (SELECT doc_id, text, strpos(lower(text), 'mw') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_replace(CASE WHEN p > 0 THEN substr(text, greatest(p - 90, 1), p + 2 + 150 - greatest(p - 90, 1)) ELSE substr(text, 1, 240) END, '\s+', ' ', 'g')) AS snippet FROM a""")
def evidence_snippet(spark, d):
    """The text around the first capacity."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.snippet(F.col("text"), "mw").alias("snippet"))


@query(r"SELECT doc_id, trim(regexp_extract(title, '^(.*?)(?:[|｜]| [-–—] |$)', 1)) AS name FROM documents WHERE title IS NOT NULL")
def clean_name(spark, d):
    """A title without what follows a bar or a spaced dash."""
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", F.trim(F.regexp_extract("title", r"^(.*?)(?:[|｜]| [-–—] |$)", 1)).alias("name"))


@query(r"""SELECT doc_id, substr(regexp_replace(title, '[\\/:*?"<>|]', '_', 'g'), 1, 100) AS file_name, replace(replace(title, '|', '\|'), chr(10), ' ') AS cell FROM documents WHERE title IS NOT NULL""")
def safe_names(spark, d):
    """Titles as file names and as table cells."""
    t = F.col("title")
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", F.substring(F.regexp_replace(t, r'[\\/:*?"<>|]', "_"), 1, 100).alias("file_name"), F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")).alias("cell"))


@query(r"""WITH a AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE AS l, length(regexp_replace(text, '[^\x{3400}-\x{9fff}]', '', 'g')) AS h, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN l > 100 AND h / l < 0.15 THEN CASE WHEN w / l >= 0.55 THEN 'en' ELSE 'foreign' END ELSE 'zh' END AS kind FROM a""")
def language_letters(spark, d):
    """A rough language by letters."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.language_by_letters(F.col("text")).alias("kind"))


@query("WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) AS start FROM documents WHERE text IS NOT NULL) SELECT doc_id, start::BIGINT AS start, md5(substr(text, start + 1, 1000)) AS chunk FROM c")
def chunk_overlap(spark, d):
    """Texts in chunks of 1,000 characters that overlap by 200."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(800)))
    return t.select("doc_id", "text", starts.alias("start")).select("doc_id", F.col("start").cast("bigint").alias("start"), F.md5(F.substring(F.col("text"), F.col("start") + 1, F.lit(1000))).alias("chunk"))


@query(r"""SELECT row_id, len(list_distinct(list_transform(regexp_extract_all(source_urls_json || ' ' || coalesce(primary_url, ''), 'https?://[^\s"\]]+'), lambda u: regexp_replace(u, '[.,;)]+$', '')))) AS urls FROM projects""")
def url_extraction(spark, d):
    """The distinct addresses in a JSON text."""
    found = F.regexp_extract_all(F.concat_ws(" ", "source_urls_json", F.coalesce("primary_url", F.lit(""))), F.lit(r'(https?://[^\s"\]]+)'), F.lit(1))
    return table(spark, d, "projects").select("row_id", F.size(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;)]+$", "")))).cast("bigint").alias("urls"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(error, '(?i)198\.1[89]\.|EACCES|EPERM|proxy|代理') THEN 'PROXY_OR_DNS' WHEN regexp_matches(error, '(?i)timeout|aborted') THEN 'TIMEOUT' WHEN regexp_matches(error, '(?i)ENOTFOUND|EAI_AGAIN|fetch failed|ECONN') THEN 'NETWORK' ELSE 'FETCH_ERROR' END AS code FROM documents WHERE error IS NOT NULL")
def error_codes(spark, d):
    """Failures by message."""
    return table(spark, d, "documents").where("error IS NOT NULL").select("doc_id", X.error_code(F.col("error")).alias("code"))


@query(r"SELECT doc_id, regexp_matches(url, '(?i)\.(jpe?g|png|gif|svg|webp|ico|css|js|woff2?|ttf|zip|rar|pdf|xlsx?|docx?|pptx?|mp4|mp3)($|\?)') AS is_binary, regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '(?i)\.(?:s?html?|pdf)$|/details?/|/content[_/-]|/articles?/|/news/|/20[0-9]{2}[-/]') AS is_article, regexp_extract(url, '^([a-z]+://[^/]+)', 1) = regexp_extract(canonical_url, '^([a-z]+://[^/]+)', 1) AS same_origin FROM documents")
def url_predicates(spark, d):
    """Binary, article-like and same-origin addresses."""
    u = F.col("url")
    origin = lambda c: F.regexp_extract(c, "^([a-z]+://[^/]+)", 1)
    return table(spark, d, "documents").select("doc_id", u.rlike(X.BINARY).alias("is_binary"), article_url(u).alias("is_article"), (origin("url") == origin("canonical_url")).alias("same_origin"))


@query("SELECT doc_id, CASE WHEN d.fetched_at IS NULL OR s.scan_id IS NULL THEN 'date_unknown' WHEN strftime(d.fetched_at, '%Y-%m-%d') BETWEEN s.start_date AND s.end_date THEN 'within_range' ELSE 'outside_range' END AS date_status FROM documents d LEFT JOIN scans s USING (scan_id)")
def date_status(spark, d):
    """Whether a document falls in its scan's window, by inclusive comparison of ISO dates."""
    s = table(spark, d, "scans").select("scan_id", "start_date", "end_date", F.lit(1).alias("known"))
    j = table(spark, d, "documents").select("doc_id", "scan_id", "fetched_at").join(s, "scan_id", "left")
    day = F.date_format("fetched_at", "yyyy-MM-dd")
    return j.select("doc_id", F.when(F.col("fetched_at").isNull() | F.col("known").isNull(), "date_unknown").when(day.between(F.col("start_date"), F.col("end_date")), "within_range").otherwise("outside_range").alias("date_status"))


@query(r"SELECT doc_id, list_sum(list_transform(regexp_extract_all(text, '(\d{1,9}) ?MW', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS mw, len(regexp_extract_all(text, '(\d{1,9}) ?MW', 1)) AS n FROM documents WHERE text IS NOT NULL")
def quantity_extract(spark, d):
    """The capacities that a text states."""
    found = F.regexp_extract_all("text", F.lit(r"(\d{1,9}) ?MW"), F.lit(1))
    total = F.aggregate(F.transform(found, lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.when(F.size(found) > 0, total).alias("mw"), F.size(found).cast("bigint").alias("n"))


# A number, a multiplier and one of 16 units that no letter follows. RE2 has no lookahead, so the next character is taken too; a
# mark before each number keeps it from being the next number's first digit.
_UNIT = "kwh|mwh|gwh|twh|kw|mw|gw|tw|千瓦时|兆瓦时|吉瓦时|太瓦时|千瓦|兆瓦|吉瓦|太瓦"
_QUANTITY = rf"(?i)[0-9][0-9,.]*[\s\x{{a0}}\x{{3000}}]*(?:thousand|million|billion|万|亿)?[\s\x{{a0}}\x{{3000}}]*(?:{_UNIT})(?:[^A-Za-z]|$)"


@query(
    rf"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([^0-9,.])([0-9])', '\1|\2', 'g'), '{_QUANTITY}'), lambda x: lower(x)) AS found FROM documents WHERE text IS NOT NULL),
    v AS (SELECT doc_id, list_filter(list_transform(found, lambda x: {{'unit': regexp_extract(x, '{_UNIT}'), 'v': TRY_CAST(replace(regexp_extract(x, '[0-9][0-9,.]*'), ',', '') AS DOUBLE)
        * CASE regexp_extract(x, 'thousand|million|billion|万|亿') WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN '万' THEN 1e4 WHEN '亿' THEN 1e8 ELSE 1e0 END
        * CASE substr(regexp_extract(x, '{_UNIT}'), 1, 1) WHEN 'k' THEN 1e-3 WHEN '千' THEN 1e-3 WHEN 'g' THEN 1e3 WHEN '吉' THEN 1e3 WHEN 't' THEN 1e6 WHEN '太' THEN 1e6 ELSE 1e0 END}}), lambda q: q.v > 0) AS q FROM m)
    SELECT doc_id, round(list_sum(list_transform(list_filter(q, lambda e: NOT regexp_matches(e.unit, 'h$|时$')), lambda e: e.v)), 3) AS power_mw, round(list_sum(list_transform(list_filter(q, lambda e: regexp_matches(e.unit, 'h$|时$')), lambda e: e.v)), 3) AS energy_mwh, len(q) AS n FROM v"""
)
def stated_quantities(spark, d):
    """The power and the energy that a text states, in MW and MWh: numbers with multipliers in English and Chinese units."""
    found = F.regexp_extract_all(F.regexp_replace("text", r"([^0-9,.])([0-9])", "$1|$2"), F.lit(_QUANTITY), F.lit(0))

    def read(x):
        x = F.lower(x)
        unit, times = F.regexp_extract(x, f"({_UNIT})", 1), F.regexp_extract(x, "(thousand|million|billion|万|亿)", 1)
        number = F.replace(F.regexp_extract(x, "([0-9][0-9,.]*)", 1), F.lit(","), F.lit("")).try_cast("double")
        many = F.when(times == "thousand", 1e3).when(times == "million", 1e6).when(times == "billion", 1e9).when(times == "万", 1e4).when(times == "亿", 1e8).otherwise(1.0)
        size = F.substring(unit, 1, 1)
        factor = F.when(size.isin("k", "千"), 1e-3).when(size.isin("g", "吉"), 1e3).when(size.isin("t", "太"), 1e6).otherwise(1.0)
        return F.struct(unit.rlike("h$|时$").alias("energy"), (number * many * factor).alias("v"))

    def total(energy):
        own = F.filter("q", lambda e: e["energy"] == F.lit(energy))
        return F.when(F.size(own) > 0, F.round(F.aggregate(own, F.lit(0.0), lambda a, e: a + e["v"]), 3))

    q = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.filter(F.transform(found, read), lambda e: e["v"] > 0).alias("q"))
    return q.select("doc_id", total(False).alias("power_mw"), total(True).alias("energy_mwh"), F.size("q").cast("bigint").alias("n"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1 AS is_first FROM documents")
def content_archive(spark, d):
    """Content addresses, and which document first wrote each."""
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = t.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    # Joined by document, not by digest: all empty texts share one.
    return t.join(first.select(F.col("first_id").alias("doc_id"), F.lit(True).alias("f")), "doc_id", "left").select("doc_id", "digest", F.coalesce("f", F.lit(False)).alias("is_first"))


# --- JSON, maps, entities, review -----------------------------------------------------------------------------------------


@query("SELECT row_id, coalesce(len(from_json(conflicts_json, '[{\"field\":\"VARCHAR\"}]')), 0) AS conflicts, coalesce(json_extract_string(fields_json, '$.country'), '') AS country FROM projects")
def tolerant_json(spark, d):
    """JSON columns decoded with defaults."""
    c = F.coalesce(F.size(F.from_json("conflicts_json", "array<struct<field:string>>")), F.lit(0))
    return table(spark, d, "projects").select("row_id", F.greatest(c, F.lit(0)).cast("bigint").alias("conflicts"), F.coalesce(F.get_json_object("fields_json", "$.country"), F.lit("")).alias("country"))


@query("WITH k AS (SELECT row_id, fields_json, unnest(json_keys(fields_json)) AS field FROM projects) SELECT field, count(*) AS n, count(json_extract_string(fields_json, '$.\"' || field || '\"')) AS filled FROM k GROUP BY 1")
def field_completeness(spark, d):
    """How often each field is given and filled."""
    k = table(spark, d, "projects").select(F.explode(F.from_json("fields_json", "map<string,string>")).alias("field", "value"))
    return k.groupBy("field").agg(F.count("*").alias("n"), F.count("value").alias("filled"))


@query("WITH u AS (SELECT row_id, canonical_key, score, updated_at, unnest(from_json(source_urls_json, '[\"VARCHAR\"]')) AS url FROM projects WHERE canonical_key IS NOT NULL), a AS (SELECT canonical_key, count(DISTINCT url) AS urls FROM u GROUP BY 1), p AS (SELECT canonical_key, count(*) AS revision, max(score) AS score, arg_min(primary_url, (updated_at, row_id)) AS first_url FROM projects WHERE canonical_key IS NOT NULL GROUP BY 1) SELECT canonical_key, revision, score, first_url, coalesce(urls, 0) AS urls FROM p LEFT JOIN a USING (canonical_key)")
def merge_projects(spark, d):
    """Rows of one project merged: union of addresses, best score, first address, number of revisions."""
    p = table(spark, d, "projects").where("canonical_key IS NOT NULL")
    u = p.select("canonical_key", F.explode(F.from_json("source_urls_json", "array<string>")).alias("url")).groupBy("canonical_key").agg(F.countDistinct("url").alias("urls"))
    m = p.groupBy("canonical_key").agg(F.count("*").alias("revision"), F.max("score").alias("score"), F.min(F.when(F.col("primary_url").isNotNull(), F.struct("updated_at", "row_id", "primary_url"))).alias("f"))
    m = m.select("canonical_key", "revision", "score", F.col("f.primary_url").alias("first_url"))
    return m.join(u, "canonical_key", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))


_N = r"regexp_replace(lower(coalesce(json_extract_string(fields_json, '$.project_name'), '')), '[^\p{L}\p{N}]', '', 'g')"


@query(rf"""WITH a AS (SELECT row_id, canonical_key, {_N} AS n FROM projects WHERE canonical_key IS NOT NULL), b AS (SELECT row_id, n, lag(n) OVER (PARTITION BY canonical_key ORDER BY row_id) AS m FROM a),
g AS (SELECT row_id, n, m, list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i, 2))) AS x, list_distinct(list_transform(range(1, length(m)), lambda i: substr(m, i, 2))) AS y FROM b WHERE m IS NOT NULL)
SELECT row_id, CASE WHEN n = '' OR m = '' THEN 0.0 WHEN n = m OR contains(n, m) OR contains(m, n) THEN 1.0 WHEN len(x) + len(y) > 0 THEN len(list_intersect(x, y)) * 2.0 / (len(x) + len(y)) ELSE 0.0 END AS similarity FROM g""")
def name_similarity(spark, d):
    """Each project name's similarity with the one before it in its group (Dice over bigrams)."""
    p = table(spark, d, "projects").where("canonical_key IS NOT NULL").select("row_id", "canonical_key", X.plain(F.coalesce(F.get_json_object("fields_json", "$.project_name"), F.lit(""))).alias("n"))
    b = p.withColumn("m", F.lag("n").over(W.partitionBy("canonical_key").orderBy("row_id"))).where("m IS NOT NULL")
    n, m = F.col("n"), F.col("m")
    return b.select("row_id", F.when((n == "") | (m == ""), 0.0).when((n == m) | n.contains(m) | m.contains(n), 1.0).otherwise(X.dice(X.bigrams(n), X.bigrams(m))).alias("similarity"))


@query("SELECT scan_id, count(*) AS projects, count(*) FILTER (status NOT IN ('approved', 'auto_approved')) AS unresolved, count(*) FILTER (status NOT IN ('approved', 'auto_approved')) = 0 AS can_confirm FROM projects GROUP BY 1")
def snapshot_guard(spark, d):
    """Whether a scan's projects are all decided, so that a snapshot may be taken."""
    open_ = F.count_if(~F.col("status").isin("approved", "auto_approved"))
    return table(spark, d, "projects").groupBy("scan_id").agg(F.count("*").alias("projects"), open_.alias("unresolved"), (open_ == 0).alias("can_confirm"))


@query("SELECT row_id, scan_id, status AS before, CASE WHEN status IN ('approved', 'auto_approved') THEN status ELSE 'approved' END AS after FROM projects WHERE status NOT IN ('approved', 'auto_approved')")
def bulk_approve_delta(spark, d):
    """The audit rows of approving everything; a second run changes nothing."""
    return table(spark, d, "projects").where("status NOT IN ('approved', 'auto_approved')").select("row_id", "scan_id", F.col("status").alias("before"), F.lit("approved").alias("after"))


@query("SELECT row_id FROM projects p WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.scan_id = p.scan_id AND s.status = 'completed')")
def cascade_delete(spark, d):
    """What is left after the completed scans are deleted."""
    gone = table(spark, d, "scans").where("status = 'completed'").select("scan_id")
    return table(spark, d, "projects").select("row_id", "scan_id").join(gone, "scan_id", "left_anti").select("row_id")


@query("SELECT 'document' AS kind, doc_id AS id, title, url, NULL::BIGINT AS read_count FROM documents UNION ALL SELECT 'article', article_id, title, url, read_count FROM dajiala_article")
def evolved_union(spark, d):
    """Two sources with different columns in one table; what one lacks is null."""
    a = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "title", "url")
    b = table(spark, d, "dajiala_article").select(F.lit("article").alias("kind"), F.col("article_id").alias("id"), "title", "url", "read_count")
    return a.unionByName(b, allowMissingColumns=True)


@query(r"SELECT record_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN project_name <> '' THEN '# ' || project_name END, CASE WHEN country <> '' THEN 'Country: ' || country END, CASE WHEN capacity <> '' THEN 'Capacity: ' || capacity END, CASE WHEN developer <> '' THEN 'Developer: ' || developer END, nullif(content, ''))) AS body FROM project_intel")
def feed_documents(spark, d):
    """Feed records as documents of labelled sections, as a digest."""
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    body = F.concat_ws("\n\n", part("# ", "project_name"), part("Country: ", "country"), part("Capacity: ", "capacity"), part("Developer: ", "developer"), F.nullif("content", F.lit("")))
    return table(spark, d, "project_intel").select("record_id", F.md5(body).alias("body"))


@query(r"SELECT raw_path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS headline, len(regexp_extract_all(html, '<(p|li|td|h[1-4])[ >]')) AS blocks FROM page_capture")
def page_titles(spark, d):
    """Titles, headlines and numbers of blocks of archived pages."""
    h = F.col("html")
    return table(spark, d, "page_capture").select("raw_path", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, "<h1[^>]*>([^<]*)</h1>", 1).alias("headline"), F.size(F.regexp_extract_all(h, F.lit("(<(p|li|td|h[1-4])[ >])"), F.lit(1))).cast("bigint").alias("blocks"))


@query("WITH x AS (SELECT DISTINCT unnest(list_concat([primary_url], from_json(source_urls_json, '[\"VARCHAR\"]'))) AS url FROM projects) SELECT url FROM x WHERE url LIKE 'http%'")
def all_addresses(spark, d):
    """The distinct web addresses of all projects."""
    urls = F.concat(F.array("primary_url"), F.coalesce(F.from_json("source_urls_json", "array<string>"), F.array().cast("array<string>")))
    return table(spark, d, "projects").select(F.explode(urls).alias("url")).where("url LIKE 'http%'").distinct()

# --- further operators ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN status_code = 429 THEN 'RATE_LIMITED' WHEN regexp_matches(lower(substr(coalesce(text, ''), 1, 8000)), 'captcha|verifying your connection|you are human|人机验证') THEN 'BOT_CHALLENGE' WHEN regexp_matches(lower(substr(coalesce(text, ''), 1, 8000)), 'access denied|forbidden|acceso denegado|访问受限') THEN 'ACCESS_DENIED' WHEN status_code IN (401, 403) THEN 'ACCESS_DENIED' END AS block FROM documents")
def access_block(spark, d):
    """How a page was blocked, first rule wins."""
    t = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 8000))
    block = F.when(F.col("status_code") == 429, "RATE_LIMITED").when(t.rlike("captcha|verifying your connection|you are human|人机验证"), "BOT_CHALLENGE").when(t.rlike("access denied|forbidden|acceso denegado|访问受限"), "ACCESS_DENIED").when(F.col("status_code").isin(401, 403), "ACCESS_DENIED")
    return table(spark, d, "documents").select("doc_id", block.alias("block"))


@query("WITH c AS (SELECT row_id, unnest(from_json(conflicts_json, '[{\"field\":\"VARCHAR\",\"values\":[\"VARCHAR\"]}]')) AS c FROM projects) SELECT c.field AS field, count(*) AS n, sum(len(c.\"values\"))::BIGINT AS stated FROM c GROUP BY 1")
def conflict_fields(spark, d):
    """Conflicts by field and the values stated."""
    c = table(spark, d, "projects").select(F.explode(F.from_json("conflicts_json", "array<struct<field:string,values:array<string>>>")).alias("c"))
    return c.groupBy("c.field").agg(F.count("*").alias("n"), F.sum(F.size("c.values")).cast("bigint").alias("stated"))


@query("WITH v AS (SELECT canonical_key, row_id, try_cast(json_extract_string(fields_json, '$.pv_capacity_mw') AS DOUBLE) AS mw FROM projects WHERE canonical_key IS NOT NULL), l AS (SELECT row_id, mw, lag(mw) OVER (PARTITION BY canonical_key ORDER BY row_id) AS before FROM v WHERE mw IS NOT NULL) SELECT row_id, abs(mw - before) <= 0.02 * greatest(1.0, abs(mw), abs(before)) AS equivalent FROM l WHERE before IS NOT NULL")
def equivalent_values(spark, d):
    """Whether a stated capacity agrees within two per cent with the one stated before it."""
    v = table(spark, d, "projects").where("canonical_key IS NOT NULL").select("canonical_key", "row_id", F.expr("try_cast(get_json_object(fields_json, '$.pv_capacity_mw') AS double)").alias("mw")).where("mw IS NOT NULL")
    l = v.withColumn("before", F.lag("mw").over(W.partitionBy("canonical_key").orderBy("row_id"))).where("before IS NOT NULL")
    return l.select("row_id", (F.abs(F.col("mw") - F.col("before")) <= 0.02 * F.greatest(F.lit(1.0), F.abs("mw"), F.abs("before"))).alias("equivalent"))


@query(r"SELECT record_id, CAST(regexp_extract(capacity, '^(\d{1,9}) ?(MW|GW|kW)$', 1) AS BIGINT) * CASE regexp_extract(capacity, '^(\d{1,9}) ?(MW|GW|kW)$', 2) WHEN 'GW' THEN 1000000 WHEN 'MW' THEN 1000 ELSE 1 END AS kw FROM project_intel WHERE regexp_matches(capacity, '^(\d{1,9}) ?(MW|GW|kW)$')")
def unit_factor_table(spark, d):
    """Plain capacities by a table of factors (p1 has the general form)."""
    part = lambda g: F.regexp_extract("capacity", r"^(\d{1,9}) ?(MW|GW|kW)$", g)
    factor = F.when(part(2) == "GW", 1_000_000).when(part(2) == "MW", 1000).otherwise(1)
    return table(spark, d, "project_intel").where(F.col("capacity").rlike(r"^(\d{1,9}) ?(MW|GW|kW)$")).select("record_id", (part(1).cast("bigint") * factor).cast("bigint").alias("kw"))


@query("SELECT url, arg_max(article_id, (fetched_at, article_id)) AS article_id, count(*) AS fetches, max(read_count) AS reads FROM dajiala_article WHERE url IS NOT NULL AND url <> '' GROUP BY url")
def article_deduplication(spark, d):
    """The latest fetch of each article."""
    m = F.max(F.struct(F.coalesce(F.col("fetched_at").cast("string"), F.lit("")).alias("t"), "article_id")).alias("m")
    g = table(spark, d, "dajiala_article").where("url IS NOT NULL AND url <> ''").groupBy("url").agg(m, F.count("*").alias("fetches"), F.max("read_count").alias("reads"))
    return g.select("url", "m.article_id", "fetches", "reads")


@query("SELECT CASE WHEN original IS NULL THEN 'unknown' WHEN original THEN 'original' ELSE 'copy' END AS kind, count(*) AS n, count(DISTINCT account_id) AS accounts, coalesce(sum(read_count), 0)::BIGINT AS reads FROM dajiala_article GROUP BY 1")
def original_flags(spark, d):
    """Articles by the tri-state mark of originality."""
    kind = F.when(F.col("original").isNull(), "unknown").when(F.col("original"), "original").otherwise("copy")
    return table(spark, d, "dajiala_article").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("account_id").alias("accounts"), F.coalesce(F.sum("read_count"), F.lit(0)).cast("bigint").alias("reads"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> '' AND (i = 1 OR x[i] <> x[i - 1])))::BIGINT AS blocks FROM l")
def consecutive_blocks(spark, d):
    """The lines of a text without empty ones and those equal to the line before."""
    x = F.split("text", "\n")
    # Each line beside the one before it; the first stands beside an empty one.
    beside = F.arrays_zip(x.alias("line"), F.concat(F.array(F.lit("")), x).alias("before"))
    kept = F.filter(beside, lambda z: (z["line"] != "") & (z["line"] != z["before"]))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(kept).cast("bigint").alias("blocks"))


@query("WITH p AS (SELECT scan_id, count(*) AS projects FROM projects GROUP BY 1), s AS (SELECT scan_id, created_at, coalesce(projects, 0) AS projects FROM scans LEFT JOIN p USING (scan_id)), b AS (SELECT scan_id, projects, lag(projects) OVER (ORDER BY created_at, scan_id) AS before FROM s) SELECT scan_id, projects, before, CASE WHEN before IS NULL THEN 'no_baseline' WHEN projects < before THEN 'regressed' WHEN projects > before THEN 'improved' ELSE 'stable' END AS status FROM b")
def recall_status(spark, d):
    """Each scan's yield against the scan before (scans are few)."""
    p = table(spark, d, "projects").groupBy("scan_id").agg(F.count("*").alias("projects"))
    s = table(spark, d, "scans").select("scan_id", "created_at").join(p, "scan_id", "left").withColumn("projects", F.coalesce("projects", F.lit(0)))
    b = s.withColumn("before", F.lag("projects").over(W.orderBy("created_at", "scan_id")))
    status = F.when(F.col("before").isNull(), "no_baseline").when(F.col("projects") < F.col("before"), "regressed").when(F.col("projects") > F.col("before"), "improved").otherwise("stable")
    return b.select("scan_id", "projects", "before", status.alias("status"))


@query("SELECT row_id, len(list_filter(['country', 'project_name', 'published_month'], lambda f: coalesce(json_extract_string(fields_json, '$.' || f), '') = ''))::BIGINT AS missing FROM projects")
def missing_required(spark, d):
    """How many of a project's required fields are empty."""
    fields = ("country", "project_name", "published_month")
    gone = [F.when(F.coalesce(F.get_json_object("fields_json", f"$.{f}"), F.lit("")) == "", 1).otherwise(0) for f in fields]
    return table(spark, d, "projects").select("row_id", (gone[0] + gone[1] + gone[2]).cast("bigint").alias("missing"))


@query("SELECT row_id, json_extract_string(fields_json, '$.country') AS country, json_extract_string(fields_json, '$.project_name') AS project_name, json_extract_string(fields_json, '$.owner') AS owner, json_extract_string(fields_json, '$.developer') AS developer, json_extract_string(fields_json, '$.epc') AS epc FROM projects")
def export_columns(spark, d):
    """The field map projected onto the export's columns."""
    f = F.from_json("fields_json", "country string, project_name string, owner string, developer string, epc string")
    return table(spark, d, "projects").select("row_id", f.alias("f")).select("row_id", "f.*")


@query("SELECT article_id, title FROM dajiala_article WHERE fetched_at >= TIMESTAMP '2025-01-01' AND fetched_at < TIMESTAMP '2026-01-01' AND title <> '' AND url <> ''")
def articles_in_window(spark, d):
    """Articles of a date window with title and address; the window reaches the scan."""
    return table(spark, d, "dajiala_article").where("fetched_at >= TIMESTAMP_NTZ '2025-01-01' AND fetched_at < TIMESTAMP_NTZ '2026-01-01' AND title <> '' AND url <> ''").select("article_id", "title")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS newest FROM events")
def running_newest(spark, d):
    """The running maximum of each key."""
    return table(spark, d, "events").select("user_id", "event_id", F.max("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)).alias("newest"))


@query("SELECT d.doc_id, d.canonical_url, d.title, s.source_name, d.published_at, length(d.text) AS chars FROM documents d LEFT JOIN sources s USING (source_id) WHERE d.text IS NOT NULL AND d.failure_code IS NULL")
def fulltext_export(spark, d):
    """The export's rows; narrow columns reach the scan."""
    s = table(spark, d, "sources").select("source_id", "source_name")
    return table(spark, d, "documents").where("text IS NOT NULL AND failure_code IS NULL").join(s, "source_id", "left").select("doc_id", "canonical_url", "title", "source_name", "published_at", F.length("text").cast("bigint").alias("chars"))


@query("SELECT s.scan_id, count(DISTINCT d.doc_id) AS documents, count(DISTINCT d.doc_id) FILTER (d.failure_code IS NOT NULL) AS failed, min(d.fetched_at) AS first_fetch, max(d.fetched_at) AS last_fetch FROM scans s LEFT JOIN documents d USING (scan_id) GROUP BY 1")
def scan_progress(spark, d):
    """Each scan's progress; documents are aggregated before the join."""
    g = table(spark, d, "documents").groupBy("scan_id").agg(F.count("*").alias("documents"), F.count("failure_code").alias("failed"), F.min("fetched_at").alias("first_fetch"), F.max("fetched_at").alias("last_fetch"))
    return table(spark, d, "scans").select("scan_id").join(g, "scan_id", "left").select("scan_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("failed", F.lit(0)).alias("failed"), "first_fetch", "last_fetch")


@query()
def resolve_entities(spark, d):
    """Project rows resolved to entities by name, country, capacities, party and address (iterative, no SQL form)."""
    get = lambda f: F.get_json_object("fields_json", f"$.{f}")
    t = table(spark, d, "projects")
    # The stated amounts in kW and kWh, one column per field; of several the least.
    stated = units.project_amounts(t).groupBy("row_key").agg(*[F.min(F.when(F.col("field") == field, F.col("value"))).alias(c) for c, field in (("capacity", "pv_capacity_mw"), ("storage_power", "storage_power_mw"), ("storage_energy", "storage_capacity_mwh"))])
    owner = F.when(F.trim(get("owner")) != "", get("owner"))
    mentions = t.select(F.col("row_id").alias("mention_id"), get("project_name").alias("name"), get("country").alias("country"), F.coalesce(owner, get("developer")).alias("party"), get("address").alias("address")).join(stated.withColumnRenamed("row_key", "mention_id"), "mention_id", "left")
    return resolve.resolve(mentions)


@query("SELECT min(event_id) AS first_id, user_id FROM events GROUP BY user_id")
def stream_first_per_key(spark, d):
    """The first event of each key, as a stream that is run to its end into the shared folder and read back."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    # Complete mode keeps one row of state per key; the last batch holds the answer.
    target = f"{folder}/out"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(target)
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("first_id", "user_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
