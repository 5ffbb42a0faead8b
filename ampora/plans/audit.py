"""Checks, diagnoses and state of a run, each query with its SQL form."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.terms import ARCHIVE_PATH, CONTENT_PATH, DOMESTIC, ENERGY, PROJECT
from ampora.operators import classify as C
from ampora.operators import search
from ampora.plans.classify import assessed
from ampora.plans.registry import Registry
from ampora.plans.texts import _key_sql
from ampora.session import checkpoint_dir, spread, table
from ampora.streaming import logs

_R = Registry()
query, queries, oracle_sql = _R.query, _R.queries, _R.oracle_sql


def _field(name: str):
    return F.get_json_object("fields_json", f"$.{name}")


# --- measurements ---------------------------------------------------------------------------------------------------

_UNITS = "kwh|mwh|gwh|twh|kw|mw|gw|tw|千瓦时|兆瓦时|吉瓦时|太瓦时|千瓦|兆瓦|吉瓦|太瓦"
_AMOUNT = rf"(?i)([0-9][0-9,.]*)\s*(thousand|million|billion|万|亿)?\s*({_UNITS})(?:[^A-Za-z]|$)"


def first_quantity(text, energy: bool):
    """Of the amounts in ``text`` the first of energy (MWh) or power (MW): ``source, value``; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(0))
    part = lambda x, g: F.lower(F.regexp_extract(x, _AMOUNT, g))
    times = lambda m: F.when(m == "thousand", 1e3).when(m == "million", 1e6).when(m == "billion", 1e9).when(m == "万", 1e4).when(m == "亿", 1e8).otherwise(1.0)
    size = lambda u: F.when(F.substring(u, 1, 1).isin("k", "千"), 1e-3).when(F.substring(u, 1, 1).isin("g", "吉"), 1e3).when(F.substring(u, 1, 1).isin("t", "太"), 1e6).otherwise(1.0)
    amount = lambda x: F.struct(part(x, 3).rlike("wh$|时$").alias("energy"), (F.replace(part(x, 1), F.lit(","), F.lit("")).try_cast("double") * times(part(x, 2)) * size(part(x, 3))).alias("v"))
    fitting = F.filter(F.transform(found, amount), lambda q: (q["energy"] == F.lit(energy)) & (q["v"] > 0))
    return X.half_up(F.get(fitting, F.lit(0))["v"], 6)


_SIZE = "CASE WHEN regexp_matches(lower(q.u), '^[k千]') THEN 1e-3 WHEN regexp_matches(lower(q.u), '^[g吉]') THEN 1e3 WHEN regexp_matches(lower(q.u), '^[t太]') THEN 1e6 ELSE 1.0 END"
_TIMES = "CASE lower(q.m) WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN '万' THEN 1e4 WHEN '亿' THEN 1e8 ELSE 1.0 END"


def _first_sql(text: str, energy: bool) -> str:
    pick = rf"list_transform(list_transform(regexp_extract_all({text}, '{_AMOUNT}', 0), lambda x: regexp_extract(x, '{_AMOUNT}', ['n', 'm', 'u'])), lambda q: {{'e': regexp_matches(lower(q.u), 'wh$|时$'), 'v': TRY_CAST(replace(q.n, ',', '') AS DOUBLE) * {_TIMES} * {_SIZE}}})"
    return f"floor(list_filter({pick}, lambda y: y.e = {str(energy).lower()} AND y.v > 0)[1].v * 1e6 + 0.5) / 1e6"


# The measured fields, whether they are energies, and what is beyond any one project.
MEASURED = {"pv_capacity_mw": (False, 100_000), "storage_power_mw": (False, 100_000), "storage_capacity_mwh": (True, 1_000_000)}


@query(" UNION ALL ".join(rf"""
SELECT row_id, '{f}' AS field, CASE WHEN NOT coalesce(raw > 0, false) THEN 'no number' WHEN v IS NULL THEN 'no evidence' WHEN v > {bound} THEN 'implausible' WHEN abs(raw - v) / greatest(1.0, abs(v)) > 0.02 THEN 'corrected' ELSE 'verified' END AS outcome, CASE WHEN raw > 0 AND v <= {bound} THEN v END AS value
FROM (SELECT row_id, TRY_CAST(fields_json->>'{f}' AS DOUBLE) AS raw, {_first_sql(f"coalesce(fields_json->>'{f}', '') || ' ; ' || coalesce(evidence_json->>'{f}', '')", energy)} AS v FROM projects)""" for f, (energy, bound) in MEASURED.items()))
def measured_fields(spark, d):
    """Each measured field against the first fitting amount in its own text and evidence: verified, corrected or refused, with the value."""
    parts = []
    for f, (energy, bound) in MEASURED.items():
        raw = _field(f).try_cast("double")
        said = F.concat(F.coalesce(_field(f), F.lit("")), F.lit(" ; "), F.coalesce(F.get_json_object("evidence_json", f"$.{f}"), F.lit("")))
        v = F.col("v")
        outcome = F.when(~F.coalesce(F.col("raw") > 0, F.lit(False)), "no number").when(v.isNull(), "no evidence").when(v > bound, "implausible").when(F.abs(F.col("raw") - v) / F.greatest(F.lit(1.0), F.abs(v)) > 0.02, "corrected").otherwise("verified")
        rows = table(spark, d, "projects").select("row_id", raw.alias("raw"), first_quantity(said, energy).alias("v"))
        parts.append(rows.select("row_id", F.lit(f).alias("field"), outcome.alias("outcome"), F.when((F.col("raw") > 0) & (v <= bound), v).alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(r"""
WITH r AS (SELECT row_id, TRY_CAST(fields_json->>'pv_capacity_mw' AS DOUBLE) AS v, canonical_key FROM projects), t AS (SELECT row_id, lower(evidence_json) AS e FROM projects),
p AS (SELECT r.row_id, e, v, regexp_replace(printf('%.2f', v), '0+$', '') AS two FROM r JOIN t USING (row_id) WHERE v > 0)
SELECT row_id, regexp_matches(e, '(^|[^0-9.])' || replace(regexp_replace(two, '\.$', ''), '.', '\.') || '\s*(mw|兆瓦)') OR (v >= 1000 AND regexp_matches(e, '(^|[^0-9.])' || replace(regexp_replace(regexp_replace(printf('%.5f', v / 1000), '0+$', ''), '\.$', ''), '.', '\.') || '\s*(gw|吉瓦)')) AS told FROM p""")
def capacities_in_text(spark, d):
    """Whether each row's capacity stands in its evidence, as MW or from a thousand on as GW."""
    v = _field("pv_capacity_mw").try_cast("double")
    plain = lambda x, n: F.regexp_replace(F.regexp_replace(F.format_string(f"%.{n}f", x), r"0+$", ""), r"\.$", "")
    pattern = lambda x, n, unit: F.concat(F.lit(r"(^|[^0-9.])"), F.replace(plain(x, n), F.lit("."), F.lit("\\.")), F.lit(rf"\s*({unit})"))
    rows = table(spark, d, "projects").select("row_id", F.lower("evidence_json").alias("e"), v.alias("v")).where("v > 0")
    giga = (F.col("v") >= 1000) & F.regexp_like("e", pattern(F.col("v") / 1000, 5, "gw|吉瓦"))
    return rows.select("row_id", (F.regexp_like("e", pattern(F.col("v"), 2, "mw|兆瓦")) | giga).alias("told"))


# --- assessments ----------------------------------------------------------------------------------------------------


@query(r"""
WITH m AS (SELECT p.row_id, s.time_zone, unnest(json_keys(fields_json)) AS field, fields_json, evidence_json FROM projects p JOIN sources s USING (source_id) WHERE s.country NOT IN ('China', '中国')),
v AS (SELECT row_id, field, trim(coalesce(fields_json->>('$."' || field || '"'), '')) AS value, trim(coalesce(evidence_json->>('$."' || field || '"'), '')) AS evidence FROM m)
SELECT row_id, field, CASE WHEN evidence = '' THEN 'evidence' ELSE 'field_translation' END AS gap FROM v WHERE value <> '' AND (evidence = '' OR (field IN ('project_name', 'country', 'address', 'progress', 'category', 'project_type') AND regexp_matches(value, '[A-Za-z]{4}') AND NOT regexp_matches(value, '[\x{3400}-\x{9fff}]')))""")
def bilingual_gaps(spark, d):
    """What foreign sources' rows lack for two languages: evidence of a value, a translation of a text field."""
    foreign = table(spark, d, "sources").where("country NOT IN ('China', '中国')").select("source_id").dropDuplicates()
    rows = table(spark, d, "projects").join(F.broadcast(foreign), "source_id", "left_semi").select("row_id", F.explode(F.from_json("fields_json", "map<string,string>")).alias("field", "value"), F.from_json("evidence_json", "map<string,string>").alias("e"))
    value, evidence = F.trim(F.coalesce("value", F.lit(""))), F.trim(F.coalesce(F.try_element_at("e", F.col("field")), F.lit("")))
    latin = F.col("field").isin("project_name", "country", "address", "progress", "category", "project_type") & value.rlike("[A-Za-z]{4}") & ~value.rlike(r"[\x{3400}-\x{9fff}]")
    return rows.where((value != "") & ((evidence == "") | latin)).select("row_id", "field", F.when(evidence == "", "evidence").otherwise("field_translation").alias("gap"))


@query(rf"""
WITH h AS (SELECT row_id, primary_url, trim(fields_json->>'project_name') AS name, {_key_sql("fields_json->>'project_name'")} AS k FROM projects WHERE status IN ('approved', 'auto_approved')),
d AS (SELECT doc_id, source_id, lower(coalesce(title, '') || chr(10) || coalesce(text, '')) AS body FROM documents),
s AS (SELECT h.*, p.source_id FROM h JOIN projects p USING (row_id) WHERE length(h.name) >= 4 AND h.k <> '')
SELECT s.row_id, count(DISTINCT d.doc_id) AS documents, min(d.doc_id) AS first_doc FROM s JOIN d ON d.source_id = s.source_id AND contains(d.body, lower(s.name)) GROUP BY 1""")
def verified_hints(spark, d):
    """Confirmed rows whose name stands word for word in documents of their own source.

    All names are looked for at once, so each document is read once whatever their number, and only the names it holds leave it.
    """
    name = F.trim(_field("project_name"))
    hints = spread(table(spark, d, "projects").where("status IN ('approved', 'auto_approved') AND source_id IS NOT NULL").select("row_id", "source_id", "fields_json")).select("row_id", "source_id", name.alias("name"), X.name_key(_field("project_name")).alias("k")).where("length(name) >= 4 AND k <> ''")
    body = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("body")
    docs = spread(table(spark, d, "documents").where("source_id IS NOT NULL").select("doc_id", "source_id", "title", "text")).select("doc_id", "source_id", body)
    hits = search.holders(docs, hints.select("source_id", F.lower("name").alias("name"))).withColumnRenamed("name", "low")
    found = hits.groupBy("source_id", "low").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))
    return hints.withColumn("low", F.lower("name")).join(found, ["source_id", "low"]).select("row_id", "documents", "first_doc")


@query(rf"""
WITH m AS (SELECT scan_id, row_id, regexp_matches(trim(coalesce(fields_json->>'country', '')), '(?i){DOMESTIC}') AS own FROM projects)
SELECT scan_id, count(*) FILTER (NOT own) AS kept, count(*) FILTER (own) AS dropped, CASE WHEN count(*) FILTER (NOT own) = 0 THEN 'non_project' ELSE 'project_report' END AS classification FROM m GROUP BY 1""")
def domestic_filter(spark, d):
    """What of each scan lies abroad; a scan of nothing but domestic rows is no report."""
    own = C.is_domestic(_field("country"))
    by = table(spark, d, "projects").select("scan_id", own.alias("own")).groupBy("scan_id").agg(F.count_if(~F.col("own")).alias("kept"), F.count_if("own").alias("dropped"))
    return by.select("scan_id", "kept", "dropped", F.when(F.col("kept") == 0, "non_project").otherwise("project_report").alias("classification"))


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(title, '') || chr(10) || substr(coalesce(text, ''), 1, 20000) AS s, error IS NULL AND coalesce(text, '') <> '' AS ok, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM documents)
SELECT doc_id, ok AND regexp_matches(s, '(?i){ENERGY}') AND regexp_matches(s, '(?i){PROJECT}') AS relevant, regexp_matches(p, '(?i){CONTENT_PATH}') AS content_path, regexp_matches(p, '(?i){ARCHIVE_PATH}') AS archive_path FROM d""")
def candidate_relevance(spark, d):
    """Whether each readable document speaks of energy and of a project, and what its path says."""
    s = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 20_000))
    ok = F.col("error").isNull() & (F.coalesce("text", F.lit("")) != "")
    p = C.path_of(F.col("url"))
    return table(spark, d, "documents").select("doc_id", (ok & s.rlike(f"(?i){ENERGY}") & s.rlike(f"(?i){PROJECT}")).alias("relevant"), p.rlike(f"(?i){CONTENT_PATH}").alias("content_path"), p.rlike(f"(?i){ARCHIVE_PATH}").alias("archive_path"))


@query(r"""
WITH v AS (SELECT row_id, row_id % 5 AS k, score FROM projects)
SELECT row_id, CASE k WHEN 0 THEN 'project_report' WHEN 1 THEN 'non_project' ELSE 'uncertain' END AS classification, CASE WHEN k = 4 OR score IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, score / 50)) END AS confidence, k < 3 AS complete FROM v""")
def normalised_assessments(spark, d):
    """Model answers brought to form: a known class, a confidence from 0 to 1 (0.5 where it is none), and whether they were complete."""
    k = F.col("row_id") % 5
    kind = F.when(k == 0, "project_report").when(k == 1, "non_project").when(k == 2, "uncertain").when(k == 3, "sure")
    answer = F.to_json(F.struct(kind.alias("classification"), F.when(k == 4, "high").otherwise((F.col("score") / 50).cast("string")).alias("confidence"), F.lit("because").alias("reasoning"), F.lit("zh").alias("language")))
    said = F.from_json("answer", "classification string, confidence string, reasoning string, language string")
    rows = table(spark, d, "projects").select("row_id", answer.alias("answer")).select("row_id", said.alias("a"))
    known = F.coalesce(F.col("a.classification").isin("project_report", "non_project", "uncertain"), F.lit(False))
    number = F.col("a.confidence").try_cast("double")
    complete = known & number.isNotNull() & (F.length(F.trim("a.reasoning")) >= 4) & F.col("a.language").isNotNull()
    return rows.select("row_id", F.when(known, F.col("a.classification")).otherwise("uncertain").alias("classification"), F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.5).alias("confidence"), complete.alias("complete"))


@query(r"""
WITH f AS (SELECT record_id, {'country': trim(coalesce(country, '')), 'project_name': trim(coalesce(project_name, '')), 'owner': trim(coalesce(developer_display, developer, owner, '')), 'address': coalesce(nullif(trim(location), ''), trim(region), ''), 'progress': trim(coalesce(stage, '')), 'project_type': coalesce(nullif(trim(industry), ''), trim(technology), ''), 'event_date': trim(coalesce(cod_date, ''))} AS m FROM project_intel)
SELECT record_id, m.country AS country, m.owner AS owner, m.address AS address, m.project_type AS project_type, (m.country <> '')::INT + (m.project_name <> '')::INT + (m.owner <> '')::INT + (m.address <> '')::INT + (m.progress <> '')::INT + (m.project_type <> '')::INT + (m.event_date <> '')::INT AS filled FROM f""")
def record_assessments(spark, d):
    """What each feed record states by field, empty ones left out of the count."""
    t = lambda *c: X.bare(F.coalesce(*c, F.lit("")))
    either = lambda a, b: F.coalesce(F.nullif(X.bare(F.col(a)), F.lit("")), X.bare(F.col(b)), F.lit(""))
    m = {"country": t("country"), "project_name": t("project_name"), "owner": t("developer_display", "developer", "owner"), "address": either("location", "region"), "progress": t("stage"), "project_type": either("industry", "technology"), "event_date": t("cod_date")}
    fields = F.map_filter(F.create_map(*(x for k, v in m.items() for x in (F.lit(k), v))), lambda k, v: v != "")
    rows = table(spark, d, "project_intel").select("record_id", fields.alias("f"))
    get = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit("")).alias(k)
    return rows.select("record_id", get("country"), get("owner"), get("address"), get("project_type"), F.size("f").alias("filled"))


# --- diagnoses ------------------------------------------------------------------------------------------------------

# What to do about a failure, by its message, in order.
REMEDIES = (("credentials", r"HTTP (401|403)|api.?key|unauthor|forbidden|blocked"), ("address", r"HTTP 404|not found|deployment"), ("quota", r"HTTP 429|quota|rate.?limit|insufficient"), ("schema", r"HTTP 400|schema|response_format|invalid_request"), ("network", r"timeout|fetch failed|ENOTFOUND|ECONN"))
_REMEDY = " ".join(f"WHEN regexp_matches(error, '(?i){p}') THEN '{k}'" for k, p in REMEDIES)


@query(f"SELECT doc_id, CASE {_REMEDY} ELSE 'details' END AS remedy, coalesce(failure_code IN ('TIMEOUT', 'RATE_LIMITED') OR regexp_matches(error, '(?i)HTTP 5'), false) AS retry FROM documents WHERE error IS NOT NULL")
def remedies(spark, d):
    """What to do about each failure, the first rule that its message meets, and whether to try again."""
    e, kind = F.col("error"), F.lit("details")
    for name, pattern in reversed(REMEDIES):
        kind = F.when(e.rlike(f"(?i){pattern}"), name).otherwise(kind)
    retry = F.coalesce(F.col("failure_code").isin("TIMEOUT", "RATE_LIMITED") | e.rlike("(?i)HTTP 5"), F.lit(False))
    return table(spark, d, "documents").where("error IS NOT NULL").select("doc_id", kind.alias("remedy"), retry.alias("retry"))


@query(r"""
WITH l AS (SELECT event_id, event_type AS stage, CASE WHEN value < 5 THEN 'error' WHEN value < 10 THEN 'warn' ELSE 'info' END AS level FROM events)
SELECT CASE WHEN stage = 'error' AND level IN ('warn', 'error') THEN 'DISCOVERY_ERROR' WHEN stage = 'click' AND level = 'error' THEN 'MODEL_EXTRACTION_ERROR' WHEN level = 'error' THEN 'FETCH_ERROR' ELSE '' END AS code, count(*) AS n FROM l GROUP BY 1""")
def failure_logs(spark, d):
    """Log lines by the failure that they tell of: stage and level decide, in order."""
    v, stage = F.col("value"), F.col("event_type")
    level = F.when(v < 5, "error").when(v < 10, "warn").otherwise("info")
    code = F.when((stage == "error") & level.isin("warn", "error"), "DISCOVERY_ERROR").when((stage == "click") & (level == "error"), "MODEL_EXTRACTION_ERROR").when(level == "error", "FETCH_ERROR").otherwise("")
    return table(spark, d, "events").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(r"""
WITH p AS (SELECT s.scan_id, s.start_date, s.end_date, s.status, len(s.source_ids) AS selected, (SELECT count(*) FROM projects p WHERE p.scan_id = s.scan_id AND p.score > 90) AS results FROM scans s),
d AS (SELECT scan_id, count(*) AS fetched, count(DISTINCT source_id) AS scanned, count(*) FILTER (page_type = 'article') AS within FROM documents GROUP BY 1)
SELECT scan_id, CASE WHEN results > 0 THEN 'results' WHEN coalesce(within, 0) = 0 AND start_date = end_date THEN 'nothing on the day' WHEN coalesce(within, 0) = 0 THEN 'nothing in range' WHEN scanned < selected THEN 'sources left' ELSE 'no evidence' END AS insight, coalesce(fetched, 0) AS fetched FROM p LEFT JOIN d USING (scan_id)""")
def empty_scan_insights(spark, d):
    """Why a scan has no result, by its counters, the first rule that holds."""
    results = table(spark, d, "projects").where("score > 90").groupBy("scan_id").agg(F.count("*").alias("results"))
    counts = table(spark, d, "documents").groupBy("scan_id").agg(F.count("*").alias("fetched"), F.countDistinct("source_id").alias("scanned"), F.count_if(F.col("page_type") == "article").alias("within"))
    j = table(spark, d, "scans").select("scan_id", "start_date", "end_date", F.size("source_ids").alias("selected")).join(results, "scan_id", "left").join(counts, "scan_id", "left")
    none = F.coalesce("within", F.lit(0)) == 0
    insight = F.when(F.col("results") > 0, "results").when(none & (F.col("start_date") == F.col("end_date")), "nothing on the day").when(none, "nothing in range").when(F.col("scanned") < F.col("selected"), "sources left").otherwise("no evidence")
    return j.select("scan_id", insight.alias("insight"), F.coalesce("fetched", F.lit(0)).alias("fetched"))


@query(r"""
WITH m AS (SELECT DISTINCT source_name AS id FROM sources)
SELECT id, regexp_matches(lower(id), 'power|watt|grid') AS structured, NOT regexp_matches(lower(id), 'watch|review') AS json_mode, regexp_replace(regexp_replace('https://h.example/v1/', '/+$', '') || '/' || regexp_replace('/v1/' || url_encode(id), '^/+', ''), '/v1/v1/', '/v1/') AS url FROM m""")
def catalogue_entries(spark, d):
    """Entries of a catalogue with what their names allow, and their address joined without doubling the version."""
    name = F.lower("id")
    rows = table(spark, d, "sources").select(F.col("source_name").alias("id")).distinct()
    url = joined_url(F.lit("https://h.example/v1/"), F.concat(F.lit("/v1/"), X.encoded(F.col("id"))))
    return rows.select("id", name.rlike("power|watt|grid").alias("structured"), (~name.rlike("watch|review")).alias("json_mode"), url.alias("url"))


def joined_url(base, suffix, versions: tuple[str, ...] = ("v1", "v1beta")):
    """Base and suffix as one address; a version that ends one and begins the other stands once."""
    b, s = F.regexp_replace(base, r"/+$", ""), F.regexp_replace(suffix, r"^/+", "")
    rest = s
    for v in reversed(versions):
        rest = F.when(F.lower(b).endswith(f"/{v}") & F.lower(s).startswith(f"{v}/"), F.substring(s, F.lit(len(v) + 2), F.length(s))).otherwise(rest)
    return F.concat(b, F.lit("/"), rest)


@query(r"""
WITH p AS (SELECT row_id, json_keys(fields_json) AS ks, fields_json FROM projects)
SELECT row_id, array_to_string(list_sort(list_filter(ks, lambda k: regexp_matches(k, '(?i)^(country|owner|address)$'))), ',') AS bound, array_to_string(list_sort(list_filter(['country', 'epc', 'developer'], lambda k: NOT list_contains(ks, k))), ',') AS missing,
  json_extract_string(conflicts_json, '$[0].values[1]') AS second_value FROM (SELECT p.*, conflicts_json FROM p JOIN projects USING (row_id))""")
def bound_arguments(spark, d):
    """Which of a call's arguments each row binds and which required ones it lacks; and a value deep inside by its path."""
    keys = F.map_keys(F.from_json("fields_json", "map<string,string>"))
    bound = F.filter(keys, lambda k: k.rlike("(?i)^(country|owner|address)$"))
    missing = F.array_except(F.array(F.lit("country"), F.lit("epc"), F.lit("developer")), keys)
    return table(spark, d, "projects").select("row_id", F.array_join(F.array_sort(bound), ",").alias("bound"), F.array_join(F.array_sort(missing), ",").alias("missing"), by_path("conflicts_json", "0.values.1").alias("second_value"))


def by_path(column: str, path: str):
    """The value at a dotted path of names and places in arrays, as text; null where the path ends before."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return F.get_json_object(column, "$" + steps)


@query(r"""
WITH a AS (SELECT article_id, to_json({'data': {'items': [{'link': {'href': url}, 'name': title, 'snippet': substr(content, 1, 40)}]}}) AS payload FROM dajiala_article WHERE url <> '')
SELECT article_id, payload->>'$.data.items[0].link.href' AS url, payload->>'$.data.items[0].name' AS title, payload->>'$.data.items[0].snippet' AS snippet FROM a""")
def search_results(spark, d):
    """Rows of a recorded search answer by the paths that its connector configures."""
    paths = {"url": "data.items.0.link.href", "title": "data.items.0.name", "snippet": "data.items.0.snippet"}
    item = F.struct(F.struct(F.col("url").alias("href")).alias("link"), F.col("title").alias("name"), F.substring("content", 1, 40).alias("snippet"))
    rows = table(spark, d, "dajiala_article").where("url <> ''").select("article_id", F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("data"))).alias("payload"))
    return rows.select("article_id", *[by_path("payload", p).alias(k) for k, p in paths.items()])


# --- state of a run -------------------------------------------------------------------------------------------------


@query(r"""
WITH c AS (SELECT source_id, canonical_url AS url, ['rss', 'sitemap', 'archive'][1 + min(doc_id) % 3] AS method, min(doc_id) AS first FROM documents WHERE canonical_url <> '' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id, method ORDER BY first) AS i FROM c) SELECT source_id, method, count(*) AS found, count(*) FILTER (i <= 10) AS pooled FROM n GROUP BY 1, 2""")
def method_pools(spark, d):
    """Addresses found by each method of discovery, and how many its pool of ten takes."""
    method = F.array(F.lit("rss"), F.lit("sitemap"), F.lit("archive"))[(F.min("doc_id") % 3).cast("int")]
    urls = table(spark, d, "documents").where("canonical_url <> ''").groupBy("source_id", "canonical_url").agg(method.alias("method"))
    return urls.groupBy("source_id", "method").agg(F.count("*").alias("found")).withColumn("pooled", F.least("found", F.lit(10)).cast("bigint"))


@query(r"""
WITH b AS (SELECT source_id, max(fetched_at) AS last FROM documents GROUP BY 1), a AS (SELECT max(fetched_at) AS now FROM documents)
SELECT source_id, date_diff('day', CAST(last AS DATE), CAST(now AS DATE)) AS idle_days, date_diff('day', CAST(last AS DATE), CAST(now AS DATE)) > 30 AS stalled FROM b, a""")
def stalled_sources(spark, d):
    """Days since each source's last page, and whether the watchdog would stop it."""
    last = table(spark, d, "documents").groupBy("source_id").agg(F.max("fetched_at").alias("last"))
    # One row per source: the newest of all is a window over those.
    idle = F.datediff(F.max("last").over(W.partitionBy()), F.col("last"))
    return last.select("source_id", idle.cast("bigint").alias("idle_days"), (idle > 30).alias("stalled"))


@query(r"""
SELECT doc_id, CASE WHEN attempt_count >= 3 AND error IS NOT NULL THEN 'failed' WHEN error IS NOT NULL OR text IS NULL THEN 'pending' ELSE 'done' END AS state, CASE WHEN error IS NOT NULL THEN sha256(url || ':' || error) END AS failed_digest FROM documents""")
def recovered_queue(spark, d):
    """The queue after a crash: what ran is pending again, what failed often enough stays so; failed documents by their digest."""
    e = F.col("error")
    state = F.when((F.col("attempt_count") >= 3) & e.isNotNull(), "failed").when(e.isNotNull() | F.col("text").isNull(), "pending").otherwise("done")
    return table(spark, d, "documents").select("doc_id", state.alias("state"), F.when(e.isNotNull(), F.sha2(F.concat("url", F.lit(":"), "error"), 256)).alias("failed_digest"))


@query(r"""
WITH p AS (SELECT row_id, revision, status, row_number() OVER (ORDER BY row_id) AS n FROM projects WHERE row_id % 50 = 0)
SELECT row_id, CASE WHEN status = 'review' THEN 'proposed' WHEN status IN ('approved', 'auto_approved') THEN 'applied' ELSE 'rejected' END AS state, CASE WHEN status IN ('approved', 'auto_approved') THEN revision + 1 ELSE revision END AS version, status = 'review' AS open FROM p""")
def proposals(spark, d):
    """Proposed changes with their state: an applied one makes a new version, only an open one can be decided."""
    s = F.col("status")
    applied = s.isin("approved", "auto_approved")
    state = F.when(s == "review", "proposed").when(applied, "applied").otherwise("rejected")
    return table(spark, d, "projects").where("row_id % 50 = 0").select("row_id", state.alias("state"), F.when(applied, F.col("revision") + 1).otherwise(F.col("revision")).alias("version"), (s == "review").alias("open"))


@query(r"SELECT scan_id, start_date <= end_date AND regexp_full_match(start_date, '\d{4}-\d{2}-\d{2}') AND regexp_full_match(end_date, '\d{4}-\d{2}-\d{2}') AND len(source_ids) BETWEEN 1 AND 200 AS valid FROM scans")
def valid_requests(spark, d):
    """Whether each scan's request is one: ISO dates in order, between one and two hundred sources."""
    iso = lambda c: F.coalesce(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    return table(spark, d, "scans").select("scan_id", ((F.col("start_date") <= F.col("end_date")) & iso("start_date") & iso("end_date") & F.size("source_ids").between(1, 200)).alias("valid"))


@query("SELECT source_id, source_name, enabled FROM sources WHERE source_id = 'src-03' UNION ALL (SELECT source_id, source_name, enabled FROM sources WHERE enabled AND source_id <> 'src-03' ORDER BY source_name, source_id LIMIT 5)")
def source_lookup(spark, d):
    """A source by its key, and the first enabled ones by name."""
    s = table(spark, d, "sources").select("source_id", "source_name", "enabled")
    return s.where("source_id = 'src-03'").unionByName(s.where("enabled AND source_id <> 'src-03'").orderBy("source_name", "source_id").limit(5))


@query(r"""
WITH h AS (SELECT canonical_key, row_id, fields_json->>'project_name' AS name FROM projects WHERE canonical_key IS NOT NULL AND fields_json->>'project_name' <> ''),
f AS (SELECT canonical_key, min(row_id) AS first FROM h GROUP BY 1)
SELECT b.row_id, a.name AS first_name, a.name = b.name AS same FROM h b JOIN f USING (canonical_key) JOIN h a ON a.row_id = f.first WHERE b.row_id <> a.row_id""")
def hint_names(spark, d):
    """Each row's name beside the first that its project was given."""
    rows = table(spark, d, "projects").select("canonical_key", "row_id", _field("project_name").alias("name")).where("canonical_key IS NOT NULL AND name <> ''")
    first = rows.groupBy("canonical_key").agg(F.min_by("name", "row_id").alias("first_name"), F.min("row_id").alias("first"))
    return rows.join(first, "canonical_key").where("row_id <> first").select("row_id", "first_name", (F.col("first_name") == F.col("name")).alias("same"))


@query(r"""
WITH d AS (SELECT doc_id, title, coalesce(title, '') || chr(10) || substr(coalesce(text, ''), 1, 20000) AS s FROM documents)
SELECT regexp_matches(s, '(?i)光伏|储能|新能源|太阳能|风电|电站|EPC|solar|photovoltaic|battery|storage|renewable|wind\s*(?:farm|power|energy)|energy project') AS energy, count(*) AS n FROM d GROUP BY 1""")
def stream_assessments(spark, d):
    """Documents assessed as a stream run to its end: those that speak of energy and those that don't."""
    path = f"{checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "title", "text", "url", "page_type", "published_at")
    docs.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    judged = assessed(stream).select("doc_id", C.likelihood(F.col("title"), F.col("text"), F.col("url"), F.col("page_type"), F.col("published_at"))["energy"].alias("energy"))
    logs.run_once(judged, f"{path}/rows", f"{path}/state")
    return spark.read.schema("doc_id bigint, energy boolean").parquet(f"{path}/rows").groupBy("energy").agg(F.count("*").alias("n"))


# --- small rules ----------------------------------------------------------------------------------------------------


@query(r"""
SELECT scan_id, date_diff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) + 1 AS days, greatest(1, least(3650, date_diff('day', CAST(start_date AS DATE), DATE '2026-07-31') + 2)) AS period_days, CAST(ceil(date_diff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) / 30.0) AS BIGINT) AS months FROM scans""")
def scan_periods(spark, d):
    """The length of each scan's range in days and months, and the days that an account's history must reach back, from one to ten years."""
    day = lambda c: F.col(c).try_cast("date")
    n = F.datediff(day("end_date"), day("start_date"))
    back = F.datediff(F.lit("2026-07-31").cast("date"), day("start_date")) + 2
    return table(spark, d, "scans").select("scan_id", (n + 1).cast("bigint").alias("days"), F.greatest(F.lit(1), F.least(F.lit(3650), back)).cast("bigint").alias("period_days"), F.ceil(n / 30.0).cast("bigint").alias("months"))


@query(r"""
WITH r AS (SELECT p.row_id, p.status, json_array_length(conflicts_json) AS c, len(json_keys(evidence_json)) AS e, primary_url FROM projects p)
SELECT count(*) AS rows, count(*) FILTER (status IN ('approved', 'auto_approved')) AS confirmed, count(*) FILTER (status = 'review') AS review, count(*) FILTER (c > 0) AS in_conflict, count(*) FILTER (e = 0) AS without_evidence, count(*) FILTER (primary_url IS NULL) AS without_address, round(count(*) FILTER (status IN ('approved', 'auto_approved')) * 100.0 / count(*), 2) AS confirmed_percent FROM r""")
def acceptance_stats(spark, d):
    """The counts by which a run is accepted, in one pass."""
    ok = F.col("status").isin("approved", "auto_approved")
    keys = F.coalesce(F.size(F.map_keys(F.from_json("evidence_json", "map<string,string>"))), F.lit(0))
    return table(spark, d, "projects").agg(F.count("*").alias("rows"), F.count_if(ok).alias("confirmed"), F.count_if(F.col("status") == "review").alias("review"), F.count_if(F.json_array_length("conflicts_json") > 0).alias("in_conflict"), F.count_if(keys == 0).alias("without_evidence"), F.count_if(F.col("primary_url").isNull()).alias("without_address"), F.round(F.count_if(ok) * 100.0 / F.count("*"), 2).alias("confirmed_percent"))


@query(r"""
WITH l AS (SELECT row_id, list_concat(from_json(source_urls_json, '["VARCHAR"]'), [primary_url], from_json(source_urls_json, '["VARCHAR"]')) AS u FROM projects WHERE primary_url IS NOT NULL)
SELECT row_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS urls FROM l""")
def ordered_distinct(spark, d):
    """Each row's addresses once, in the order in which they first stand."""
    urls = F.from_json("source_urls_json", "array<string>")
    return table(spark, d, "projects").where("primary_url IS NOT NULL").select("row_id", F.array_join(F.array_distinct(F.concat(urls, F.array("primary_url"), urls)), " ").alias("urls"))


@query(r"""
WITH t AS (SELECT row_id, source_urls_json || ' see ' || coalesce(primary_url, '') || '). ' AS s FROM projects),
u AS (SELECT row_id, list_distinct(list_transform(regexp_extract_all(s, 'https?://[^\s"''<>，。；]+'), lambda x: regexp_replace(x, '[),.;:!?\]]+$', ''))) AS u FROM t)
SELECT row_id, array_to_string(list_sort(u), ' ') AS urls FROM u""")
def extracted_urls(spark, d):
    """The web addresses in each row's JSON and text, without the marks that end a sentence, five hundred at most by the rule."""
    text = F.concat("source_urls_json", F.lit(" see "), F.coalesce("primary_url", F.lit("")), F.lit("). "))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>，。；]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"[),.;:!?\]]+$", ""))
    return table(spark, d, "projects").select("row_id", F.array_join(F.array_sort(F.slice(F.array_distinct(found), 1, 500)), " ").alias("urls"))


@query(r"""
WITH p AS (SELECT doc_id, regexp_extract(published_at, '^20[0-9]{2}-[0-9]{2}-[0-9]{2}', 0) AS day FROM documents)
SELECT doc_id FROM p WHERE coalesce(day, '') = '' OR day BETWEEN '2024-01-01' AND '2025-06-30'""")
def hint_filter(spark, d):
    """Documents whose stated day is unknown or in the range."""
    day = F.regexp_extract(F.coalesce("published_at", F.lit("")), "^20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0)
    return table(spark, d, "documents").select("doc_id", day.alias("day")).where((F.col("day") == "") | F.col("day").between("2024-01-01", "2025-06-30")).select("doc_id")
