"""Queries of the scalar operators: names, dates, addresses, quantities and payloads, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.terms import NAME_STOP_WORDS, PROJECT_SIGNAL
from ampora.plans.registry import Registry
from ampora.session import spread, table

_R = Registry()
query, queries, oracle_sql = _R.query, _R.queries, _R.oracle_sql

# SQL: plain forms of full-width signs, which is what the tables hold of compatibility forms.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_Q = lambda s: s.replace("'", "''")
_WORDS = "|".join(NAME_STOP_WORDS)
_LIST = ", ".join(f"'{w}'" for w in NAME_STOP_WORDS)


def _plain_sql(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '{_Q(_WIDE)}', '{_Q(_NARROW)}')"


def _key_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({_plain_sql(x)}), '\b(?:{_WORDS})\b', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(rf"""
SELECT row_id, {_key_sql("fields_json->>'project_name'")} AS name_key,
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({_plain_sql("fields_json->>'project_name'")}, '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2 AND t NOT IN ({_LIST})))), ' ') AS name_tokens
FROM projects""")
def name_keys(spark, d):
    """The comparable form and the tokens of every project's name."""
    name = F.get_json_object("fields_json", "$.project_name")
    rows = spread(table(spark, d, "projects").select("row_id", "fields_json"))
    return rows.select("row_id", X.name_key(name).alias("name_key"), F.array_join(F.array_sort(X.name_tokens(name)), " ").alias("name_tokens"))


@query(r"""
WITH r AS (SELECT record_id, regexp_extract(translate(recorded_at, './', '--'), '(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})', ['y', 'm', 'd']) AS p FROM project_intel)
SELECT record_id, CASE WHEN p.y = '' THEN '' ELSE p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') END AS day FROM r""")
def recorded_dates(spark, d):
    """The day on which each feed record was made."""
    return table(spark, d, "project_intel").select("record_id", X.recorded_date(F.col("recorded_at")).alias("day"))


@query(r"""
WITH r AS (SELECT article_id, published_at, regexp_extract(translate(published_at, './', '--'), '(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})', ['y', 'm', 'd']) AS p,
    CASE WHEN regexp_full_match(trim(published_at), '[0-9]+(\.[0-9]+)?') THEN CAST(trim(published_at) AS DOUBLE) END AS n FROM dajiala_article),
m AS (SELECT *, CASE WHEN n > 10000000000 THEN n WHEN n > 0 THEN n * 1000 END AS ms FROM r)
SELECT article_id, CASE WHEN p.y <> '' THEN p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0')
  WHEN ms < 2e14 THEN strftime(epoch_ms(CAST(floor(ms) AS BIGINT)) + INTERVAL 8 HOUR, '%Y-%m-%d') END AS day FROM m""")
def article_dates(spark, d):
    """The day on which each article was published, from a text or a number of seconds or milliseconds."""
    return table(spark, d, "dajiala_article").select("article_id", X.article_date(F.col("published_at")).alias("day"))


@query(r"""
WITH f AS (SELECT DISTINCT published_at AS v FROM documents WHERE published_at IS NOT NULL),
p AS (SELECT v, string_split_regex(regexp_extract(v, '20[0-9]{2}[年./-][0-9]{1,2}([月./-][0-9]{1,2})?', 0), '[^0-9]+') AS y,
  string_split_regex(regexp_extract(' ' || v || ' ', '[^0-9]([0-9]{1,2}[./-][0-9]{1,2}[./-]20[0-9]{2})[^0-9]', 1), '[^0-9]+') AS z,
  coalesce(try_strptime(trim(v), ['%b %-d, %Y', '%B %-d, %Y', '%-d %b %Y', '%-d %B %Y', '%b %-d %Y', '%-d-%b-%y', '%-d-%b-%Y'])) AS n FROM f)
SELECT v AS value, CASE WHEN len(y) >= 2 THEN y[1] || '-' || lpad(y[2], 2, '0') || '-' || CASE WHEN len(y) > 2 THEN lpad(y[3], 2, '0') ELSE '01' END
  WHEN len(z) = 3 THEN z[3] || '-' || lpad(z[2], 2, '0') || '-' || lpad(z[1], 2, '0') ELSE strftime(n, '%Y-%m-%d') END AS day FROM p""")
def dates_of_texts(spark, d):
    """The date that each notation of documents states, in three steps: year first, day first, English month."""
    values = table(spark, d, "documents").select(F.col("published_at").alias("value")).where("value IS NOT NULL").distinct()
    return values.select("value", X.date_of(F.col("value")).alias("day"))


@query(r"""
SELECT row_id, array_to_string(list_filter(list_transform(from_json(source_urls_json, '["VARCHAR"]'), lambda u: trim(u)), lambda u: u <> ''), '、') AS urls FROM projects""")
def joined_urls(spark, d):
    """The addresses of each project as one text."""
    return table(spark, d, "projects").select("row_id", F.coalesce(X.joined_values(F.from_json("source_urls_json", "array<string>")), F.lit("")).alias("urls"))


@query(r"""
SELECT doc_id, regexp_replace(url || '&token=' || hash || '#a', '([?&]token=)[^&#]*', '\1***', 'g') AS shown,
  lower(trim(coalesce(lang, ''))) <> '' AND NOT regexp_matches(lower(trim(lang)), '^zh(-|$)') AS is_foreign FROM documents""")
def redacted_addresses(spark, d):
    """Addresses with a secret parameter hidden, and whether the document's label names a foreign language."""
    return table(spark, d, "documents").select("doc_id", X.redacted(F.concat("url", F.lit("&token="), "hash", F.lit("#a"))).alias("shown"), X.is_foreign(F.trim("lang")).alias("is_foreign"))


@query(r"""
SELECT record_id, CASE WHEN coalesce(_index, '') = '' THEN 'https://feed.example/records' ELSE 'https://feed.example/records/' || url_encode(trim(_index) || ' ' || coalesce(country, '')) END AS url,
  array_to_string(list_filter([project_name, country, capacity, owner, developer], lambda v: v IS NOT NULL AND v <> ''), ' ') AS reference_query FROM project_intel""")
def record_addresses(spark, d):
    """The address of each record, its parts encoded, and the search text made of its attributes."""
    base = "https://feed.example/records"
    index = F.coalesce("_index", F.lit(""))
    url = F.when(index == "", F.lit(base)).otherwise(F.concat(F.lit(base + "/"), X.encoded(F.concat(F.trim(index), F.lit(" "), F.coalesce("country", F.lit(""))))))
    parts = F.filter(F.array("project_name", "country", "capacity", "owner", "developer"), lambda v: v.isNotNull() & (v != ""))
    return table(spark, d, "project_intel").select("record_id", url.alias("url"), F.array_join(parts, " ").alias("reference_query"))


@query(r"""
SELECT article_id, CASE WHEN s LIKE '%原创%' OR s IN ('1', 'true') THEN true WHEN s LIKE '%转载%' OR s IN ('0', 'false') THEN false END AS original, coalesce(trim(author), '') AS author, TRY_CAST(trim(category) AS DOUBLE) AS category_number
FROM (SELECT *, CASE WHEN category = 'news' THEN CAST(original AS VARCHAR) WHEN original THEN '原创' WHEN NOT original THEN '非原创' ELSE '转载' END AS s FROM dajiala_article)""")
def original_states(spark, d):
    """Whether articles are original, by three notations, with coerced texts and numbers."""
    original = F.col("original")
    noted = F.when(F.col("category") == "news", original.cast("string")).when(original, "原创").when(~original, "非原创").otherwise("转载")
    return table(spark, d, "dajiala_article").select("article_id", X.original_state(noted).alias("original"), F.coalesce(F.trim("author"), F.lit("")).alias("author"), F.trim("category").try_cast("double").alias("category_number"))


_BODY = r"(?:^|\n)正文：[ \t]*\n"


@query(r"""
WITH a AS (SELECT article_id, '微信公众号：' || account_name || chr(10) || '作者：' || author || chr(10) || chr(10) || '正文：' || chr(10) || content AS md FROM dajiala_article)
SELECT article_id, CASE WHEN strpos(md, chr(10) || '正文：' || chr(10)) > 0 THEN trim(substr(md, strpos(md, chr(10) || '正文：' || chr(10)) + 5), ' ' || chr(10) || chr(9) || '　') ELSE md END AS body FROM a""")
def article_bodies(spark, d):
    """The text behind the body's marker of each article's document."""
    md = F.concat_ws("\n", F.concat(F.lit("微信公众号："), "account_name"), F.concat(F.lit("作者："), "author"), F.lit(""), F.lit("正文："), F.col("content"))
    rows = table(spark, d, "dajiala_article").where("account_name IS NOT NULL AND author IS NOT NULL AND content IS NOT NULL").select("article_id", md.alias("md"))
    body = F.regexp_replace(F.element_at(F.split("md", _BODY, 2), -1), r"^[\s　]+|[\s　]+$", "")
    return rows.select("article_id", F.when(F.col("md").rlike(_BODY), body).otherwise(F.col("md")).alias("body"))


_HALF = "(floor({x} * 1e6 + 0.5) / 1e6)"
_NUM = "TRY_CAST(fields_json->>'{f}' AS DOUBLE)"


@query(rf"""
WITH n AS (SELECT row_id, {_NUM.format(f="pv_capacity_mw")} AS pv, {_NUM.format(f="storage_power_mw")} AS sp, {_NUM.format(f="storage_capacity_mwh")} AS sc FROM projects)
SELECT row_id,
  array_to_string(list_filter([CASE WHEN pv > 0 THEN 'pv_capacity_mw:' || CAST(CAST(floor(pv * 10 + 0.5) AS BIGINT) AS VARCHAR) END, CASE WHEN sp > 0 THEN 'storage_power_mw:' || CAST(CAST(floor(sp * 10 + 0.5) AS BIGINT) AS VARCHAR) END, CASE WHEN sc > 0 THEN 'storage_capacity_mwh:' || CAST(CAST(floor(sc * 10 + 0.5) AS BIGINT) AS VARCHAR) END], lambda v: v IS NOT NULL), ',') AS tenths,
  coalesce(sc > 1e6, false) OR coalesce(pv > 1e5, false) OR coalesce(sp > 1e5, false) AS implausible,
  CASE WHEN sp > 0 AND sc > 0 THEN {_HALF.format(x="(sc / sp)")} END AS hours,
  CASE WHEN sp > 0 AND sc > 0 THEN sc / sp < 0.05 OR sc / sp > 72 ELSE false END AS odd_duration,
  CASE WHEN pv IS NULL OR isnan(pv) THEN 0.5 ELSE greatest(0.0, least(1.0, pv / 1000)) END AS clamped
FROM n""")
def capacity_checks(spark, d):
    """Signature, bounds, storage hours and a clamped share of each project's stated capacities."""
    number = lambda f: F.get_json_object("fields_json", f"$.{f}").try_cast("double").alias(f)
    rows = table(spark, d, "projects").select("row_id", number("pv_capacity_mw"), number("storage_power_mw"), number("storage_capacity_mwh"))
    pv, sp, sc = F.col("pv_capacity_mw"), F.col("storage_power_mw"), F.col("storage_capacity_mwh")
    tenth = lambda name: F.when(F.col(name) > 0, F.concat(F.lit(f"{name}:"), F.floor(F.col(name) * 10 + 0.5).cast("string")))
    hours = F.when((sp > 0) & (sc > 0), sc / sp)
    return rows.select(
        "row_id",
        F.array_join(F.array_compact(F.array(*(tenth(n) for n in ("pv_capacity_mw", "storage_power_mw", "storage_capacity_mwh")))), ",").alias("tenths"),
        (F.coalesce(sc > 1e6, F.lit(False)) | F.coalesce(pv > 1e5, F.lit(False)) | F.coalesce(sp > 1e5, F.lit(False))).alias("implausible"),
        X.half_up(hours, 6).alias("hours"),
        F.coalesce((hours < 0.05) | (hours > 72), F.lit(False)).alias("odd_duration"),
        F.when(pv.isNull() | F.isnan(pv), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pv / 1000))).alias("clamped"),
    )


def _field(name: str):
    return F.get_json_object("fields_json", f"$.{name}")


def _real_sql(f: str) -> str:
    return f"nullif(trim(fields_json->>'{f}'), '')"


@query(rf"""
WITH n AS (SELECT row_id, coalesce({_real_sql("epc")}, {_real_sql("chinese_client")}, {_real_sql("developer")}, {_real_sql("owner")}, '?') AS party, coalesce({_real_sql("country")}, {_real_sql("address")}, '?') AS region,
   {_NUM.format(f="pv_capacity_mw")} AS pv, {_NUM.format(f="storage_power_mw")} AS sp, {_NUM.format(f="storage_capacity_mwh")} AS sc, {_real_sql("project_type")} AS kind FROM projects),
c AS (SELECT *, CASE WHEN sc >= 1000 THEN regexp_replace(printf('%.1f', floor(sc / 100 + 0.5) / 10), '\.0$', '') || 'GWh' WHEN sc > 0 THEN regexp_replace(printf('%.1f', floor(sc * 10 + 0.5) / 10), '\.0$', '') || 'MWh'
   WHEN pv >= 1000 THEN regexp_replace(printf('%.1f', floor(pv / 100 + 0.5) / 10), '\.0$', '') || 'GW' WHEN pv > 0 THEN regexp_replace(printf('%.1f', floor(pv * 10 + 0.5) / 10), '\.0$', '') || 'MW'
   WHEN sp >= 1000 THEN regexp_replace(printf('%.1f', floor(sp / 100 + 0.5) / 10), '\.0$', '') || 'GW' WHEN sp > 0 THEN regexp_replace(printf('%.1f', floor(sp * 10 + 0.5) / 10), '\.0$', '') || 'MW' ELSE '?' END AS scale FROM n)
SELECT row_id, party || '+' || region || '+' || scale || '+' || coalesce(kind, CASE WHEN sc IS NOT NULL AND pv IS NOT NULL THEN '光伏配储' WHEN sc IS NOT NULL OR sp IS NOT NULL THEN '储能电站' WHEN pv IS NOT NULL THEN '光伏项目' ELSE '新能源项目' END) AS name,
  array_to_string(list_filter([CASE WHEN pv > 0 THEN printf('%.1f', pv) || ' MW' END, CASE WHEN sc > 0 THEN printf('%.1f', sc) || ' MWh' END], lambda v: v IS NOT NULL), ' / ') AS label FROM c""")
def synthesised_names(spark, d):
    """A name made of party, region, scale and type for each project, and its capacities as a label."""
    number = lambda f: _field(f).try_cast("double")
    real = lambda f: F.nullif(X.bare(_field(f)), F.lit(""))
    rows = table(spark, d, "projects").select("row_id", F.coalesce(real("epc"), real("chinese_client"), real("developer"), real("owner"), F.lit("?")).alias("party"), F.coalesce(real("country"), real("address"), F.lit("?")).alias("region"), number("pv_capacity_mw").alias("pv"), number("storage_power_mw").alias("sp"), number("storage_capacity_mwh").alias("sc"), real("project_type").alias("kind"))
    pv, sp, sc = F.col("pv"), F.col("sp"), F.col("sc")
    scale = F.coalesce(*(F.nullif(X.compact_capacity(v, u), F.lit("")) for v, u in ((sc, "MWh"), (pv, "MW"), (sp, "MW"))), F.lit("?"))
    kind = F.coalesce("kind", F.when(sc.isNotNull() & pv.isNotNull(), "光伏配储").when(sc.isNotNull() | sp.isNotNull(), "储能电站").when(pv.isNotNull(), "光伏项目").otherwise("新能源项目"))
    label = F.array_join(F.array_compact(F.array(F.when(pv > 0, F.format_string("%.1f MW", pv)), F.when(sc > 0, F.format_string("%.1f MWh", sc)))), " / ")
    return rows.select("row_id", F.concat_ws("+", "party", "region", scale, kind).alias("name"), label.alias("label"))


# --- quantities in a feed's capacities ------------------------------------------------------------------------------

_CAPACITY = r"(?i)(\d[\d,.]*)\s*(GWh|MWh|GW|MW|吉瓦时|兆瓦时|吉瓦|兆瓦)"
_STORAGE, _SOLAR = r"(?i)储能|光储|电池|battery|storage", r"(?i)光伏|光储|太阳能|solar|photovoltaic|\bpv\b"


@query(r"""
WITH r AS (SELECT record_id, trim(coalesce(capacity, '')) AS cap, trim(coalesce(industry, '')) || ' ' || trim(coalesce(technology, '')) || ' ' || trim(coalesce(project_name, '')) AS ctx FROM project_intel),
m AS (SELECT *, regexp_extract_all(cap, '(?i)(\d[\d,.]*)\s*(GWh|MWh|GW|MW|吉瓦时|兆瓦时|吉瓦|兆瓦)', 1) AS nums, regexp_extract_all(cap, '(?i)(\d[\d,.]*)\s*(GWh|MWh|GW|MW|吉瓦时|兆瓦时|吉瓦|兆瓦)', 2) AS units FROM r),
q AS (SELECT *, list_filter(list_transform(list_zip(nums, units), lambda x: {'v': TRY_CAST(replace(x[1], ',', '') AS DOUBLE) * CASE WHEN regexp_matches(lower(x[2]), '^g|吉瓦') THEN 1000 ELSE 1 END, 'e': regexp_matches(lower(x[2]), 'wh|瓦时')}), lambda y: y.v > 0) AS vals FROM m)
SELECT record_id, CASE WHEN regexp_matches(ctx, '(?i)光伏|光储|太阳能|solar|photovoltaic|\bpv\b') THEN list_filter(vals, lambda y: NOT y.e)[1].v END AS pv_mw,
 CASE WHEN regexp_matches(ctx, '(?i)储能|光储|电池|battery|storage') THEN list_filter(vals, lambda y: y.e)[1].v END AS storage_mwh,
 CASE WHEN regexp_matches(ctx, '(?i)储能|光储|电池|battery|storage') THEN list_filter(vals, lambda y: NOT y.e)[1].v END AS storage_mw FROM q""")
def parsed_capacities(spark, d):
    """The first power and energy of each record's capacity, taken for the kinds of plant that its context names."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = table(spark, d, "project_intel").select("record_id", text("capacity").alias("cap"), F.concat_ws(" ", text("industry"), text("technology"), text("project_name")).alias("ctx"))
    pairs = F.arrays_zip(F.regexp_extract_all("cap", F.lit(_CAPACITY), 1), F.regexp_extract_all("cap", F.lit(_CAPACITY), 2))
    value = lambda x: F.struct((F.replace(x["n"], F.lit(","), F.lit("")).try_cast("double") * F.when(F.lower(x["u"]).rlike("^g|吉瓦"), 1000).otherwise(1)).alias("v"), F.lower(x["u"]).rlike("wh|瓦时").alias("e"))
    rows = rows.withColumn("p", F.transform(pairs, lambda x: F.struct(x["0"].alias("n"), x["1"].alias("u")))).withColumn("vals", F.filter(F.transform("p", value), lambda y: y["v"] > 0))
    first = lambda energy: F.get(F.filter("vals", lambda y: y["e"] == F.lit(energy)), F.lit(0))["v"]
    solar, storage = F.col("ctx").rlike(_SOLAR), F.col("ctx").rlike(_STORAGE)
    return rows.select("record_id", F.when(solar, first(False)).alias("pv_mw"), F.when(storage, first(True)).alias("storage_mwh"), F.when(storage, first(False)).alias("storage_mw"))


@query(rf"""
WITH p AS (SELECT row_id, trim(coalesce(fields_json->>'project_name', '')) AS name, [{", ".join(_key_sql(f"fields_json->>'{f}'") for f in ("epc", "chinese_client", "developer", "owner"))}] AS parties FROM projects),
k AS (SELECT *, {_key_sql("name")} AS name_key, regexp_matches(name, '(?i){PROJECT_SIGNAL}') OR regexp_matches(name, '(?i)\d+(?:\.\d+)?\s*(?:GW|MW|GWh|MWh|兆瓦|吉瓦)') AS signal FROM p)
SELECT row_id, name = '' OR list_contains(list_filter(parties, lambda x: x <> ''), name_key) OR (regexp_matches(name, '(?i)首页|官网|集团有限公司\s*$|股份有限公司\s*$|corporation\s*$|company\s*$') AND NOT signal) AS invalid_name,
  name <> '' AND NOT regexp_matches(name, '(?i)首页|官网|^项目[_-]|共建一带一路项目|https?://') AND NOT (regexp_matches(name, '(?i)集团有限公司\s*$|股份有限公司\s*$|corporation\s*$|company\s*$|limited\s*$') AND NOT signal) AS eligible FROM k""")
def name_validity(spark, d):
    """Whether a project's name is one: not empty, not a party's, not a bare company's or a page's title."""
    name = F.trim(F.coalesce(_field("project_name"), F.lit("")))
    rows = spread(table(spark, d, "projects").select("row_id", "fields_json")).select("row_id", name.alias("name"), X.name_key(name).alias("name_key"), *(X.name_key(_field(f)).alias(f"p_{f}") for f in ("epc", "chinese_client", "developer", "owner")))
    n = F.col("name")
    signal = n.rlike(f"(?i){PROJECT_SIGNAL}") | n.rlike(r"(?i)\d+(?:\.\d+)?\s*(?:GW|MW|GWh|MWh|兆瓦|吉瓦)")
    party = F.array_contains(F.filter(F.array("p_epc", "p_chinese_client", "p_developer", "p_owner"), lambda x: x != ""), F.col("name_key"))
    company = n.rlike(r"(?i)首页|官网|集团有限公司\s*$|股份有限公司\s*$|corporation\s*$|company\s*$")
    page = n.rlike(r"(?i)首页|官网|^项目[_-]|共建一带一路项目|https?://")
    generic = n.rlike(r"(?i)集团有限公司\s*$|股份有限公司\s*$|corporation\s*$|company\s*$|limited\s*$")
    return rows.select("row_id", ((n == "") | party | (company & ~signal)).alias("invalid_name"), ((n != "") & ~page & ~(generic & ~signal)).alias("eligible"))


# --- JSON and maps --------------------------------------------------------------------------------------------------


def recovered_json(text):
    """The first of a model's answer, its part from the first { to the last }, and that from the first [ to the last ], which is JSON; null where none is."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?i:json)?\s*", ""), r"```$", ""))
    part = lambda a, b: F.nullif(F.regexp_extract(bare, rf"(?s)\{a}.*\{b}", 0), F.lit(""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(F.nullif(bare, F.lit(""))), valid(part("{", "}")), valid(part("[", "]")))


@query(r"""
WITH t AS (SELECT row_id, CASE row_id % 4 WHEN 0 THEN '```json' || chr(10) || fields_json || chr(10) || '```' WHEN 1 THEN 'Answer: ' || fields_json || ' done.' WHEN 2 THEN 'no answer' ELSE fields_json END AS said FROM projects),
c AS (SELECT row_id, trim(regexp_replace(regexp_replace(trim(said), '^```(?:json)?\s*', ''), '```$', ''), chr(10) || ' ') AS bare FROM t),
j AS (SELECT row_id, CASE WHEN json_valid(bare) THEN bare WHEN json_valid(regexp_extract(bare, '(?s)\{.*\}', 0)) THEN regexp_extract(bare, '(?s)\{.*\}', 0) END AS body FROM c)
SELECT row_id, body IS NOT NULL AS recovered, body->>'$.country' AS country, body->>'$.project_name' AS project_name FROM j""")
def model_json(spark, d):
    """The JSON in model answers with fences, words around it or none, and two of its fields by path."""
    k = F.col("row_id") % 4
    said = F.when(k == 0, F.concat(F.lit("```json\n"), "fields_json", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Answer: "), "fields_json", F.lit(" done."))).when(k == 2, "no answer").otherwise(F.col("fields_json"))
    body = recovered_json(said)
    rows = table(spark, d, "projects").select("row_id", body.alias("body"))
    return rows.select("row_id", F.col("body").isNotNull().alias("recovered"), F.get_json_object("body", "$.country").alias("country"), F.get_json_object("body", "$.project_name").alias("project_name"))


@query(r"""
WITH k AS (SELECT row_id, unnest(json_keys(evidence_json)) AS field, evidence_json, primary_url FROM projects)
SELECT row_id, field, '[' || coalesce(primary_url, '') || '] ' || (evidence_json->>('$."' || field || '"')) AS evidence FROM k WHERE trim(coalesce(evidence_json->>('$."' || field || '"'), '')) <> ''""")
def sourced_evidence(spark, d):
    """The non-empty evidence of each project's fields with its address."""
    kept = F.map_filter(F.from_json("evidence_json", "map<string,string>"), lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    named = F.transform_values(kept, lambda k, v: F.concat(F.lit("["), F.coalesce("primary_url", F.lit("")), F.lit("] "), v))
    return table(spark, d, "projects").select("row_id", F.explode(named).alias("field", "evidence"))


FIELD_TYPES = {"country": "string", "project_name": "string", "pv_capacity_mw": "number", "storage_capacity_mwh": "number", "owner": "string", "address": "string", "published_month": "string", "progress": "string", "category": "string", "storage_power_mw": "number", "developer": "string", "epc": "string"}


def extraction_schema(fields: dict[str, str]) -> dict:
    """The JSON schema of an object with these fields, each nullable."""
    return {"type": "object", "properties": {k: {"type": [t, "null"]} for k, t in fields.items()}, "required": list(fields), "additionalProperties": False}


_TYPED = ", ".join(f"('{k}', '{v}')" for k, v in FIELD_TYPES.items())


@query(rf"""
WITH f(field, kind) AS (VALUES {_TYPED}), k AS (SELECT row_id, unnest(json_keys(fields_json)) AS field, fields_json FROM projects)
SELECT k.field, f.kind, count(*) AS n, count(*) FILTER (f.kind IS NULL) AS undeclared,
  count(*) FILTER (f.kind = 'number' AND (fields_json->>('$."' || k.field || '"')) IS NOT NULL AND TRY_CAST(fields_json->>('$."' || k.field || '"') AS DOUBLE) IS NULL) AS not_a_number FROM k LEFT JOIN f ON f.field = k.field GROUP BY ALL""")
def schema_violations(spark, d):
    """How often each field of the projects breaks the extraction schema."""
    schema = extraction_schema(FIELD_TYPES)
    kinds = F.create_map(*(F.lit(x) for k, v in schema["properties"].items() for x in (k, v["type"][0])))
    rows = table(spark, d, "projects").select(F.explode(F.from_json("fields_json", "map<string,string>")).alias("field", "value")).withColumn("kind", F.try_element_at(kinds, F.col("field")))
    bad = (F.col("kind") == "number") & F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()
    return rows.groupBy("field", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isNull()).alias("undeclared"), F.count_if(bad).alias("not_a_number"))


# What may be proposed.
ALLOWED_PATHS = ("country", "owner", "progress")


@query(r"""
WITH c AS (SELECT row_id, unnest(from_json(conflicts_json, '[{"field":"VARCHAR","values":["VARCHAR"]}]')) AS c FROM projects),
g AS (SELECT row_id, list(c.field ORDER BY c.field) AS fields FROM c WHERE c.field IN ('country', 'owner', 'progress') GROUP BY row_id)
SELECT row_id, array_to_string(list_slice(fields, 1, 12), ',') AS proposed FROM g""")
def allowed_proposals(spark, d):
    """Of each project's conflicting fields those that may be proposed, twelve at most."""
    fields = F.transform(F.from_json("conflicts_json", "array<struct<field:string>>"), lambda c: c["field"])
    kept = F.slice(F.array_sort(F.filter(fields, lambda f: f.isin(*ALLOWED_PATHS))), 1, 12)
    rows = table(spark, d, "projects").select("row_id", kept.alias("kept")).where(F.size("kept") > 0)
    return rows.select("row_id", F.array_join("kept", ",").alias("proposed"))


# Texts shown for statuses.
STATUS_LABELS = {"approved": "已确认", "auto_approved": "自动通过", "review": "待复核"}


@query(r"""
SELECT row_id, CASE status WHEN 'approved' THEN '已确认' WHEN 'auto_approved' THEN '自动通过' WHEN 'review' THEN '待复核' ELSE status END AS label,
 array_to_string(list_sort(list_distinct(list_filter([fields_json->>'owner', fields_json->>'country', fields_json->>'project_name'], lambda v: length(v) >= 2))), '|') AS marks FROM projects""")
def status_labels(spark, d):
    """The text shown for each project's status, and the values that are marked in its evidence."""
    labels = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    marks = F.array_sort(F.array_distinct(F.filter(F.array(_field("owner"), _field("country"), _field("project_name")), lambda v: F.length(v) >= 2)))
    return table(spark, d, "projects").select("row_id", F.coalesce(F.try_element_at(labels, F.col("status")), "status").alias("label"), F.array_join(marks, "|").alias("marks"))
