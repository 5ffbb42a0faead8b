"""Queries that judge documents and project rows by rules, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.terms import ARTICLE_URL, BLOCKS, COMMON_TITLE_TERM, COUNTRIES, DOMESTIC, ENERGY, GENERIC_TITLE, LISTING_URL, MILESTONE, PRODUCT_URL, PROJECT
from ampora.operators import classify as C
from ampora.plans.registry import Registry
from ampora.session import spread, table

_R = Registry()
query, queries, oracle_sql = _R.query, _R.queries, _R.oracle_sql

_I = lambda x, p: f"regexp_matches({x}, '(?i){p}')"
_SQUASH = lambda x: rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"
_PATH = r"regexp_extract(coalesce(url, ''), '^https?://[^/?#]+([^?#]*)', 1)"


def _documents(spark, d, *columns):
    return spread(table(spark, d, "documents").select("doc_id", *columns))


@query(rf"""
WITH d AS (SELECT doc_id, url, page_type, failure_code, error, published_at, coalesce(text, '') AS t, {_SQUASH("text")} AS body, {_SQUASH("title")} AS title, {_I(_PATH, ARTICLE_URL)} AS shaped FROM documents),
s AS (SELECT *, title || ' ' || substr(body, 1, 12000) AS sample, trim(regexp_split_to_array(title, '--|[-–—|｜]')[1]) AS sig FROM d),
k AS (SELECT *, list_filter(regexp_extract_all(sig, '[\p{{L}}\p{{N}}]{{4,}}'), lambda t: NOT regexp_matches(t, '(?i){COMMON_TITLE_TERM}')) AS terms, len(regexp_extract_all(regexp_replace(body, ' ', '  ', 'g') || ' ', '(?:^|\s)\d{{1,2}}[-/.]\d{{1,2}}\s')) AS dates FROM s),
r AS (SELECT *, length(body) < 350 AS short, shaped AND {_I("title", GENERIC_TITLE)} AS generic, length(body) < 1400 AND dates >= 5 AS listing,
  coalesce(shaped AND length(sig) >= 18 AND len(terms) >= 2 AND len(list_filter(terms, lambda t: contains(lower(body), lower(t)))) / nullif(len(terms), 0)::DOUBLE < 0.34, false) AS mismatch FROM k),
p AS (SELECT *, least(45, floor(length(t) / 180.0 + 0.5)) + CASE WHEN page_type IN ('article', 'document') THEN 25 ELSE 0 END + CASE WHEN shaped THEN 10 ELSE 0 END + CASE WHEN published_at IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN {_I("sample", ENERGY)} THEN 8 ELSE 0 END + CASE WHEN {_I("sample", PROJECT)} THEN 8 ELSE 0 END - CASE WHEN short THEN 35 ELSE 0 END - CASE WHEN generic THEN 30 ELSE 0 END - CASE WHEN mismatch THEN 35 ELSE 0 END - CASE WHEN listing THEN 35 ELSE 0 END AS score FROM r)
SELECT doc_id, CASE WHEN error IS NOT NULL OR body = '' THEN 0 ELSE CAST(greatest(0, least(100, score)) AS INT) END AS score,
  CASE WHEN error IS NOT NULL OR body = '' THEN false ELSE score >= 45 AND NOT mismatch END AS reliable,
  CASE WHEN error IS NOT NULL OR body = '' THEN coalesce(failure_code, 'EMPTY_BODY') ELSE array_to_string(list_filter([CASE WHEN short THEN 'BODY_TOO_SHORT' END, CASE WHEN generic THEN 'GENERIC_ARTICLE_TITLE' END, CASE WHEN mismatch THEN 'TITLE_BODY_MISMATCH' END, CASE WHEN listing THEN 'LISTING_BODY' END], lambda v: v IS NOT NULL), ',') END AS reasons
FROM p""")
def content_quality(spark, d):
    """The quality of each document's content with what speaks against it."""
    c = F.col
    q = C.quality(c("title"), c("text"), c("url"), c("page_type"), c("published_at"), c("failure_code"), c("error"))
    rows = _documents(spark, d, "title", "text", "url", "page_type", "published_at", "failure_code", "error").select("doc_id", q.alias("q"))
    return rows.select("doc_id", "q.score", "q.reliable", F.array_join("q.reasons", ",").alias("reasons"))


_FLAGS = rf"""
d AS (SELECT doc_id, title, url, page_type, published_at, coalesce(text, '') AS t, coalesce(title, '') || chr(10) || substr(coalesce(text, ''), 1, 20000) AS sample, {_PATH} AS path FROM documents),
f AS (SELECT *, {_I("sample", ENERGY)} AS energy, {_I("sample", PROJECT)} AS concrete, {_I("sample", r"\d+(?:\.\d+)?\s*(?:GW|MW|GWh|MWh|兆瓦|吉瓦|兆瓦时|吉瓦时)")} AS capacity, {_I("path", PRODUCT_URL)} AS product, {_I("path", LISTING_URL)} AS listing, {_I("path", ARTICLE_URL)} AS shaped, {_I("sample", "中标|开工|投产|并网|合同|award|construction|commission")} AS event FROM d),
l AS (SELECT *, NOT product AND (page_type IN ('article', 'document', 'roundup') OR (page_type = 'unknown' AND length(t) >= 350 AND NOT listing AND (published_at IS NOT NULL OR (shaped AND energy AND concrete AND capacity)))) AS eligible FROM f),
p AS (SELECT *, eligible AND energy AND concrete AND (capacity OR event) AS project FROM l)"""


@query(f"WITH {_FLAGS} SELECT doc_id, energy, concrete, capacity, eligible, product, project FROM p")
def project_likelihood(spark, d):
    """What in each document speaks for a project report."""
    c = F.col
    flags = C.likelihood(c("title"), c("text"), c("url"), c("page_type"), c("published_at"))
    return _documents(spark, d, "title", "text", "url", "page_type", "published_at").select("doc_id", flags.alias("f")).select("doc_id", "f.*")


def assessed(documents):
    """``classification, confidence, language`` of documents by rules (title, text, url, page_type, published_at)."""
    c = F.col
    f = C.likelihood(c("title"), c("text"), c("url"), c("page_type"), c("published_at"))
    sample = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 20_000))
    rows = documents.withColumn("_f", f).withColumn("language", X.language_by_letters(sample))
    kind = lambda name, confidence: F.struct(F.lit(name).alias("classification"), F.lit(confidence).alias("confidence"))
    judged = F.when(~F.col("_f.eligible"), kind("non_project", 0.96)).when(~F.col("_f.energy"), kind("non_project", 0.86)).when(c("page_type") == "roundup", kind("uncertain", 0.5)).when(~F.col("_f.project"), kind("uncertain", 0.55))
    return rows.withColumn("_a", judged.when(F.col("_f.capacity"), kind("project_report", 0.78)).otherwise(kind("project_report", 0.65))).select(*documents.columns, "_a.*", "language")


@query(rf"""
WITH {_FLAGS}, n AS (SELECT doc_id, sample, length(regexp_replace(sample, '[^\p{{L}}]', '', 'g'))::DOUBLE AS letters, length(regexp_replace(sample, '[^\x{{3400}}-\x{{9fff}}]', '', 'g')) AS han, length(regexp_replace(sample, '[^A-Za-z]', '', 'g')) AS latin FROM d)
SELECT p.doc_id, CASE WHEN NOT eligible OR NOT energy THEN 'non_project' WHEN page_type = 'roundup' OR NOT project THEN 'uncertain' ELSE 'project_report' END AS classification,
  CASE WHEN NOT eligible THEN 0.96 WHEN NOT energy THEN 0.86 WHEN page_type = 'roundup' THEN 0.5 WHEN NOT project THEN 0.55 WHEN capacity THEN 0.78 ELSE 0.65 END::DOUBLE AS confidence,
  CASE WHEN letters > 100 AND han / letters < 0.15 THEN CASE WHEN latin / letters >= 0.55 THEN 'en' ELSE 'foreign' END ELSE 'zh' END AS language FROM p JOIN n USING (doc_id)""")
def rule_assessments(spark, d):
    """Each document's class by rules, with its confidence and language by letters."""
    return assessed(_documents(spark, d, "title", "text", "url", "page_type", "published_at")).select("doc_id", "classification", "confidence", "language")


@query(f"WITH {_FLAGS} SELECT CASE WHEN NOT eligible OR NOT energy THEN 'non_project' WHEN page_type = 'roundup' OR NOT project THEN 'uncertain' ELSE 'project_report' END AS classification, count(*) AS n FROM p GROUP BY 1")
def classification_counts(spark, d):
    """Documents by class."""
    return assessed(_documents(spark, d, "title", "text", "url", "page_type", "published_at")).groupBy("classification").agg(F.count("*").alias("n"))


_S, _B = "(?:光伏|太阳能|solar|photovoltaic)", "(?:储能|battery|storage)"
_P, _E, _N = "(GW|MW|兆瓦|吉瓦)", "(GWh|MWh|兆瓦时|吉瓦时)", r"(\d+(?:\.\d+)?)\s*"


def _cap(pattern: str) -> str:
    pick = f"regexp_extract(w, '(?i){pattern}', ['n', 'u'])"
    return f"CASE WHEN {pick}.n <> '' THEN CAST({pick}.n AS DOUBLE) * CASE WHEN contains(lower({pick}.u), 'gw') THEN 1000 ELSE 1 END END"


_COUNTRY = "coalesce(list_filter([" + ", ".join(f"'{c}'" for c in COUNTRIES) + "], lambda c: contains(w, c))[1], '')"


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(title, '') || chr(10) || coalesce(text, '') AS w FROM documents),
c AS (SELECT doc_id, w, {_COUNTRY} AS country, coalesce({_cap(rf"{_S}[^\n。]{{0,60}}?{_N}{_P}")}, {_cap(rf"{_N}{_P}[^\n。]{{0,40}}?{_S}")}) AS pv_mw,
  coalesce({_cap(rf"{_B}[^\n。]{{0,60}}?{_N}{_E}")}, {_cap(rf"{_N}{_E}[^\n。]{{0,40}}?{_B}")}) AS storage_mwh, {_cap(rf"{_B}[^\n。]{{0,60}}?{_N}{_P}(?:[^时]|$)")} AS storage_mw FROM d)
SELECT doc_id, country, pv_mw, storage_mwh, storage_mw, regexp_extract(w, '(?i){MILESTONE}', 0) AS progress,
  CASE WHEN pv_mw IS NOT NULL AND storage_mwh IS NOT NULL THEN '光储' WHEN pv_mw IS NOT NULL THEN '光伏' WHEN storage_mwh IS NOT NULL OR storage_mw IS NOT NULL THEN '储能' WHEN regexp_matches(w, '(?i)风电|wind') THEN '风电' ELSE '' END AS kind,
  CASE WHEN regexp_matches(w, '(?i)EPC') THEN 'EPC' ELSE '' END AS category FROM c""")
def rule_fields(spark, d):
    """Country, capacities, milestone and type that each document's words give."""
    rows = _documents(spark, d, "title", "text")
    return rows.select("doc_id", C.stated_fields(F.col("title"), F.col("text")).alias("f")).select("doc_id", "f.*")


@query(rf"""
WITH p AS (SELECT p.row_id, p.fields_json AS f, p.primary_url, s.url AS source_url FROM projects p LEFT JOIN sources s USING (source_id)),
h AS (SELECT row_id, f, coalesce(f->>'project_name', '') <> '' AS name, coalesce(f->>'country', '') <> '' OR coalesce(f->>'address', '') <> '' AS place, coalesce(f->>'pv_capacity_mw', '') <> '' OR coalesce(f->>'storage_capacity_mwh', '') <> '' OR coalesce(f->>'storage_power_mw', '') <> '' AS capacity,
  coalesce(f->>'owner', '') <> '' OR coalesce(f->>'developer', '') <> '' OR coalesce(f->>'epc', '') <> '' OR coalesce(f->>'chinese_client', '') <> '' AS party, coalesce(f->>'progress', '') <> '' AS progress, coalesce(f->>'published_month', '') <> '' AS dated,
  regexp_extract(primary_url, '^https?://([^/?#:]+)', 1) AS a, regexp_extract(source_url, '^https?://([^/?#:]+)', 1) AS b FROM p)
SELECT row_id, CAST(20 * name::INT + 15 * place::INT + 25 * capacity::INT + 15 * party::INT + 10 * progress::INT + 10 * dated::INT + 5 * coalesce(a <> '' AND a = b, false)::INT AS INT) AS points,
  regexp_matches(trim(coalesce(f->>'country', '')), '(?i){DOMESTIC}') AS domestic FROM h""")
def result_points(spark, d):
    """The points of each project row by what it states, and whether its country is the domestic one."""
    field = lambda f: F.coalesce(F.get_json_object("fields_json", f"$.{f}"), F.lit("")) != ""
    host = lambda u: F.regexp_extract(u, r"^https?://([^/?#:]+)", 1)
    sources = table(spark, d, "sources").select("source_id", F.col("url").alias("source_url")).dropDuplicates(["source_id"])
    rows = table(spark, d, "projects").select("row_id", "source_id", "fields_json", "primary_url").join(sources, "source_id", "left")
    has = {"name": field("project_name"), "place": field("country") | field("address"), "capacity": field("pv_capacity_mw") | field("storage_capacity_mwh") | field("storage_power_mw"), "party": field("owner") | field("developer") | field("epc") | field("chinese_client"), "progress": field("progress"), "date": field("published_month")}
    same = (host(F.col("primary_url")) != "") & (host(F.col("primary_url")) == host(F.col("source_url")))
    return rows.select("row_id", C.result_score(has, same).cast("int").alias("points"), C.is_domestic(F.get_json_object("fields_json", "$.country")).alias("domestic"))


_BLOCK = " ".join(f"WHEN regexp_matches(sample, '(?i){p}') THEN '{k}'" for k, p in BLOCKS.items())


@query(f"""
WITH d AS (SELECT doc_id, status_code, failure_code, error, title, coalesce(title, '') || chr(10) || substr(coalesce(text, ''), 1, 8000) AS sample FROM documents)
SELECT doc_id, CASE WHEN status_code = 429 THEN 'RATE_LIMITED' {_BLOCK} WHEN status_code IN (401, 403) THEN 'ACCESS_DENIED' END AS code,
  coalesce(failure_code IN ('ACCESS_DENIED', 'BOT_CHALLENGE', 'RATE_LIMITED'), false) OR regexp_matches(coalesce(title, '') || chr(10) || coalesce(error, ''), '(?i)access denied|request (?:has been )?blocked|verify (?:that )?you are human|captcha|拒绝访问|访问被拒绝|验证码') AS blocked FROM d""")
def access_codes(spark, d):
    """The code of each page that turns its reader away, and whether diagnostics count it as blocked."""
    c = F.col
    said = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("error", F.lit("")))
    blocked = F.coalesce(c("failure_code").isin("ACCESS_DENIED", "BOT_CHALLENGE", "RATE_LIMITED"), F.lit(False)) | said.rlike(r"(?i)access denied|request (?:has been )?blocked|verify (?:that )?you are human|captcha|拒绝访问|访问被拒绝|验证码")
    return table(spark, d, "documents").select("doc_id", C.access_block(c("status_code"), c("title"), c("text")).alias("code"), blocked.alias("blocked"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, error, CASE WHEN regexp_extract(published_at, '20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) <> '' THEN regexp_extract(published_at, '20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) END AS p, regexp_extract(coalesce(title, ''), '20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) AS q FROM documents),
s AS (SELECT *, CASE WHEN p IS NOT NULL AND q <> '' AND p <> q THEN 'date_conflict' WHEN p IS NULL THEN 'date_unknown' WHEN p BETWEEN '2024-01-01' AND '2025-06-30' THEN 'within_range' ELSE 'outside_range' END AS status FROM d)
SELECT doc_id, status, error IS NULL AND t <> '' AND status <> 'outside_range' AS retained, error IS NULL AND t <> '' AND status IN ('date_unknown', 'date_conflict') AS warned FROM s""")
def date_states(spark, d):
    """Whether each document's date lies in the range, is unknown or contradicts another, and whether the document stays."""
    day = lambda x: F.nullif(F.regexp_extract(x, r"20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))
    candidates = F.array_distinct(F.array_compact(F.array(day(F.col("published_at")), F.when(day(F.col("published_at")).isNotNull(), day(F.col("title"))))))
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "error", candidates.alias("dates"))
    status = date_status(F.col("dates"), "2024-01-01", "2025-06-30")
    ok = F.col("error").isNull() & (F.col("t") != "")
    return rows.withColumn("status", status).select("doc_id", "status", (ok & (F.col("status") != "outside_range")).alias("retained"), (ok & F.col("status").isin("date_unknown", "date_conflict")).alias("warned"))


def date_status(dates, start: str, end: str):
    """The state of an array of date candidates against a range: more than one contradict, none is unknown."""
    first = F.get(dates, F.lit(0))
    return F.when(F.size(dates) > 1, "date_conflict").when(first.isNull(), "date_unknown").when(first.between(start, end), "within_range").otherwise("outside_range")


@query(r"""
WITH d AS (SELECT CASE WHEN regexp_extract(published_at, '20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) <> '' THEN regexp_extract(published_at, '20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) END AS p, regexp_extract(coalesce(title, ''), '20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) AS q FROM documents)
SELECT count(*) FILTER (p IS NOT NULL AND q <> '' AND p <> q) AS conflict, count(*) FILTER (p IS NULL) AS unknown, count(*) FILTER (p BETWEEN '2024-01-01' AND '2025-06-30' AND NOT (q <> '' AND p <> q)) AS within, count(*) FILTER (p IS NOT NULL AND NOT (p BETWEEN '2024-01-01' AND '2025-06-30') AND NOT (q <> '' AND p <> q)) AS outside FROM d""")
def date_counters(spark, d):
    """Documents by the state of their date, in one pass."""
    n = lambda s: F.count_if(F.col("status") == s)
    return date_states(spark, d).agg(n("date_conflict").alias("conflict"), n("date_unknown").alias("unknown"), n("within_range").alias("within"), n("outside_range").alias("outside"))
