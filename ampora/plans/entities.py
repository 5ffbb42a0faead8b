"""Project rows compared, keyed and merged, each query with its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.operators import resolve
from ampora.plans.registry import Registry
from ampora.plans.texts import _key_sql, _plain_sql
from ampora.functions.terms import NAME_STOP_WORDS
from ampora.session import spread, table

_R = Registry()
query, queries, oracle_sql = _R.query, _R.queries, _R.oracle_sql

_LIST = ", ".join(f"'{w}'" for w in NAME_STOP_WORDS)
CAPACITIES = ("pv_capacity_mw", "storage_power_mw", "storage_capacity_mwh")


def _field(name: str):
    return F.get_json_object("fields_json", f"$.{name}")


def comparable(projects):
    """``row_id, canonical_key`` and what two rows are compared by: keys of name, country, party and address, tokens, capacities."""
    first = lambda a, b: F.coalesce(F.nullif(_field(a), F.lit("")), _field(b))
    return projects.select(
        "row_id",
        "canonical_key",
        X.name_key(_field("project_name")).alias("name"),
        X.name_tokens(_field("project_name")).alias("tokens"),
        X.name_key(_field("country")).alias("country"),
        X.name_key(first("owner", "developer")).alias("party"),
        X.name_key(_field("address")).alias("address"),
        *(_field(c).try_cast("double").alias(c) for c in CAPACITIES),
    )


def match_score(a: str, b: str):
    """The score of two rows of ``comparable`` (structs ``a``, ``b``): name 0.6, country 0.15, capacities 0.2, party 0.1, address 0.1, at most 1; 0 for other countries."""
    c = lambda side, f: F.col(f"{side}.{f}")
    named = resolve.name_score(c(a, "name"), c(b, "name"), c(a, "tokens"), c(b, "tokens"))
    both = (c(a, "country") != "") & (c(b, "country") != "")
    same = resolve.holds(c(a, "country"), c(b, "country"))
    part = lambda f: F.when(resolve.holds(c(a, f), c(b, f)), 0.1).otherwise(0.0)
    capacities = resolve.capacity_score([c(a, f) for f in CAPACITIES], [c(b, f) for f in CAPACITIES])
    total = named * 0.6 + F.when(both, 0.15).otherwise(0.0) + capacities * 0.2 + part("party") + part("address")
    return F.when(both & ~same, 0.0).otherwise(F.least(F.lit(1.0), total))


def _holds(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"


_GRAMS = "list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"
_BOTH = " + ".join(f"coalesce(a.{c} > 0 AND b.{c} > 0, false)::INT" for c in CAPACITIES)
_NEAR = " + ".join(f"coalesce(a.{c} > 0 AND b.{c} > 0 AND abs(a.{c} - b.{c}) <= 0.05 * greatest(a.{c}, b.{c}), false)::INT" for c in CAPACITIES)
_NUMBERS = ", ".join(f"TRY_CAST(fields_json->>'{c}' AS DOUBLE) AS {c}" for c in CAPACITIES)


@query(rf"""
WITH c AS (SELECT row_id, canonical_key, {_key_sql("fields_json->>'project_name'")} AS name, list_distinct(list_filter(regexp_split_to_array({_plain_sql("fields_json->>'project_name'")}, '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2 AND t NOT IN ({_LIST}))) AS tokens,
  {_key_sql("fields_json->>'country'")} AS country, {_key_sql("coalesce(nullif(fields_json->>'owner', ''), fields_json->>'developer')")} AS party, {_key_sql("fields_json->>'address'")} AS address, {_NUMBERS} FROM projects WHERE canonical_key IS NOT NULL),
g AS (SELECT *, {_GRAMS.format(x="name")} AS grams FROM c), f AS (SELECT canonical_key, min(row_id) AS first_id FROM g GROUP BY 1),
p AS (SELECT b.row_id, a.row_id AS first_id, CASE WHEN a.name = '' OR b.name = '' THEN 0.0 WHEN {_holds("a.name", "b.name")} THEN 1.0 ELSE greatest(
    CASE WHEN len(list_distinct(list_concat(a.tokens, b.tokens))) > 0 THEN len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens)))::DOUBLE ELSE 0 END,
    CASE WHEN len(a.grams) + len(b.grams) > 0 THEN 2.0 * len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams)) ELSE 0 END) END AS name_similarity,
  CASE WHEN {_BOTH} > 0 THEN ({_NEAR}) / ({_BOTH})::DOUBLE ELSE 0.0 END AS capacity_similarity, a.country <> '' AND b.country <> '' AS stated, {_holds("a.country", "b.country")} AS same, {_holds("a.party", "b.party")} AS party, {_holds("a.address", "b.address")} AS address
  FROM g b JOIN f USING (canonical_key) JOIN g a ON a.row_id = f.first_id WHERE b.row_id <> a.row_id)
SELECT row_id, first_id, name_similarity, capacity_similarity, CASE WHEN stated AND NOT same THEN 0.0 ELSE least(1.0, name_similarity * 0.6 + CASE WHEN stated THEN 0.15 ELSE 0 END + capacity_similarity * 0.2 + CASE WHEN party THEN 0.1 ELSE 0 END + CASE WHEN address THEN 0.1 ELSE 0 END) END AS score FROM p""")
def pair_scores(spark, d):
    """How well each row agrees with the first row of its key: name, capacity and the whole score."""
    rows = comparable(spread(table(spark, d, "projects").where("canonical_key IS NOT NULL").select("row_id", "canonical_key", "fields_json")))
    whole = F.struct(*rows.columns)
    # One first row per key, found with partial minima; a hot key's rows stay where they are while the firsts come to them.
    firsts = rows.groupBy("canonical_key").agg(F.min_by(whole, "row_id").alias("a"))
    pairs = rows.select("canonical_key", whole.alias("b")).join(firsts, "canonical_key").where("a.row_id <> b.row_id")
    named = resolve.name_score(F.col("a.name"), F.col("b.name"), F.col("a.tokens"), F.col("b.tokens"))
    capacities = resolve.capacity_score([F.col(f"a.{c}") for c in CAPACITIES], [F.col(f"b.{c}") for c in CAPACITIES])
    return pairs.select(F.col("b.row_id").alias("row_id"), F.col("a.row_id").alias("first_id"), named.alias("name_similarity"), capacities.alias("capacity_similarity"), match_score("a", "b").alias("score"))


_SIGN = ", ".join(f"CASE WHEN {c} > 0 THEN '{c}:' || regexp_replace(printf('%.1f', floor({c} * 10 + 0.5) / 10), '\\.0$', '') END" for c in CAPACITIES)


@query(rf"""
WITH c AS (SELECT row_id, {_key_sql("fields_json->>'project_name'")} AS name, {_key_sql("fields_json->>'country'")} AS country, {_key_sql("fields_json->>'address'")} AS address, {_NUMBERS} FROM projects),
s AS (SELECT *, array_to_string(list_filter([{_SIGN}], lambda v: v IS NOT NULL), ',') AS signature FROM c)
SELECT row_id, sha256(coalesce(nullif(array_to_string(list_filter([name, country, address, signature], lambda v: v <> ''), '|'), ''), CAST(row_id AS VARCHAR))) AS entity_key FROM s""")
def entity_keys(spark, d):
    """The digest by which a row's project is known: name, country, address and capacities, else the row itself."""
    rows = comparable(spread(table(spark, d, "projects").select("row_id", "canonical_key", "fields_json")))
    tenth = lambda c: F.when(F.col(c) > 0, F.concat(F.lit(f"{c}:"), F.regexp_replace(F.format_string("%.1f", F.floor(F.col(c) * 10 + 0.5) / 10), r"\.0$", "")))
    signature = F.array_join(F.array_compact(F.array(*map(tenth, CAPACITIES))), ",")
    whole = F.array_join(F.filter(F.array("name", "country", "address", signature), lambda v: v != ""), "|")
    return rows.select("row_id", F.sha2(F.when(whole != "", whole).otherwise(F.col("row_id").cast("string")), 256).alias("entity_key"))


# Fields that may change without being in conflict.
LOOSE = ("progress", "published_month", "project_name")


def equivalent(a, b, a_number, b_number, a_key, b_key):
    """Whether two values say the same: within two per cent where either is a number, else equal or one holding the other (from five letters on)."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.coalesce(F.abs(x - y) <= 0.02 * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))
    text = (a_key == b_key) | ((F.length(a_key) >= 5) & (F.length(b_key) >= 5) & (a_key.contains(b_key) | b_key.contains(a_key)))
    return F.when(a_number | b_number, near).otherwise(text)


@query(rf"""
WITH k AS (SELECT canonical_key, row_id, created_at, fields_json, unnest(json_keys(fields_json)) AS field FROM projects WHERE canonical_key IS NOT NULL),
v AS (SELECT canonical_key, field, row_id, created_at, fields_json->>('$."' || field || '"') AS value, json_type(fields_json, '$."' || field || '"') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AS is_number FROM k),
n AS (SELECT *, {_key_sql("value")} AS value_key FROM v WHERE value IS NOT NULL AND value <> ''),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY canonical_key, field ORDER BY created_at NULLS FIRST, row_id) = 1),
e AS (SELECT n.*, f.value AS kept, f.row_id AS kept_row, CASE WHEN n.is_number OR f.is_number THEN coalesce(abs(TRY_CAST(n.value AS DOUBLE) - TRY_CAST(f.value AS DOUBLE)) <= 0.02 * greatest(1.0, abs(TRY_CAST(n.value AS DOUBLE)), abs(TRY_CAST(f.value AS DOUBLE))), false)
   ELSE n.value_key = f.value_key OR (length(n.value_key) >= 5 AND length(f.value_key) >= 5 AND (contains(n.value_key, f.value_key) OR contains(f.value_key, n.value_key))) END AS same FROM n JOIN f USING (canonical_key, field))
SELECT canonical_key, field, min(kept) AS value, min(kept_row) AS row_id, count(DISTINCT CASE WHEN NOT same AND field NOT IN ('progress', 'published_month', 'project_name') THEN value END) AS conflicts FROM e GROUP BY 1, 2""")
def merged_fields(spark, d):
    """Each project's fields, filled by its rows in order of age, with the number of other values that contradict."""
    rows = spread(table(spark, d, "projects").where("canonical_key IS NOT NULL").select("canonical_key", "row_id", "created_at", "fields_json"))
    values = rows.select("*", F.explode(F.from_json("fields_json", "map<string,string>")).alias("field", "value")).where("value <> ''")
    # Whether JSON holds a number is seen by what stands behind the key.
    number = F.regexp_like(F.col("fields_json"), F.concat(F.lit('"'), F.col("field"), F.lit('"\\s*:\\s*-?[0-9]')))
    values = values.select("canonical_key", "field", "row_id", "created_at", "value", number.alias("is_number"), X.name_key(F.col("value")).alias("value_key"))
    # Equal values are one, by their first record, before anything meets; then the first of all.
    order = F.struct(F.col("created_at"), F.col("row_id"))
    distinct = values.groupBy("canonical_key", "field", "value", "is_number").agg(F.min(order).alias("at"), F.first("value_key").alias("value_key"))
    first = distinct.groupBy("canonical_key", "field").agg(F.min_by(F.struct("value", "is_number", "value_key", "at"), "at").alias("f"))
    same = equivalent(F.col("value"), F.col("f.value"), F.col("is_number"), F.col("f.is_number"), F.col("value_key"), F.col("f.value_key"))
    other = F.when(~same & ~F.col("field").isin(*LOOSE), F.col("value"))
    met = distinct.join(first, ["canonical_key", "field"]).groupBy("canonical_key", "field").agg(F.first("f").alias("f"), F.countDistinct(other).alias("conflicts"))
    return met.select("canonical_key", "field", F.col("f.value").alias("value"), F.col("f.at.row_id").alias("row_id"), "conflicts")


@query(r"""
WITH u AS (SELECT canonical_key, unnest(list_distinct(list_filter(list_concat([primary_url], from_json(source_urls_json, '["VARCHAR"]')), lambda x: x IS NOT NULL))) AS url FROM projects WHERE canonical_key IS NOT NULL),
c AS (SELECT canonical_key, count(DISTINCT url) AS urls FROM u GROUP BY 1), s AS (SELECT canonical_key, max(score) AS score, count(*) AS rows, sum(json_array_length(conflicts_json)) AS conflicts FROM projects WHERE canonical_key IS NOT NULL GROUP BY 1)
SELECT s.canonical_key, coalesce(urls, 0) AS urls, CAST(rows AS BIGINT) AS rows, least(100.0, s.score + least(5, greatest(0, coalesce(urls, 0) - 1) * 2)) AS score FROM s LEFT JOIN c USING (canonical_key)""")
def merged_scores(spark, d):
    """Each project's score: the best of its rows, with up to five points for further addresses."""
    p = table(spark, d, "projects").where("canonical_key IS NOT NULL")
    urls = F.array_compact(F.array_union(F.array("primary_url"), F.coalesce(F.from_json("source_urls_json", "array<string>"), F.array().cast("array<string>"))))
    counted = p.select("canonical_key", F.explode(urls).alias("url")).distinct().groupBy("canonical_key").agg(F.count("*").alias("urls"))
    best = p.groupBy("canonical_key").agg(F.max("score").alias("s"), F.count("*").alias("rows"))
    more = F.coalesce("urls", F.lit(0))
    return best.join(counted, "canonical_key", "left").select("canonical_key", more.alias("urls"), "rows", F.least(F.lit(100.0), F.col("s") + F.least(F.lit(5), F.greatest(F.lit(0), more - 1) * 2)).alias("score"))
