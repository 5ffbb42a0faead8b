"""Joins, aggregations, rankings and set operations of the pipeline, each with its SQL form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampora.functions import text as X
from ampora.functions.terms import ARTICLE_URL, CONTENT_PATH, ENERGY, FILE_TYPES, METHOD_POINTS, PROJECT
from ampora.operators import classify as C
from ampora.operators.references import best_documents
from ampora.plans.registry import Registry
from ampora.session import cut_lineage, spread, table

_R = Registry()
query, queries, oracle_sql = _R.query, _R.queries, _R.oracle_sql

_HOST = r"^https?://(?:www\.)?([^/?#:]+)"


def _host(column):
    return F.regexp_extract(column, _HOST, 1)


# --- joins ----------------------------------------------------------------------------------------------------------


@query(r"""
WITH h AS (SELECT source_id, regexp_extract(url, '^https?://(?:www\.)?([^/?#:]+)', 1) AS h FROM sources),
d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'news.' ELSE '' END || regexp_extract(url, '^https?://(?:www\.)?([^/?#:]+)', 1) AS h FROM documents)
SELECT doc_id, coalesce((SELECT min(source_id) FROM h WHERE d.h = h.h OR ends_with(d.h, '.' || h.h) OR ends_with(h.h, '.' || d.h)), (SELECT min(source_id) FROM sources)) AS source_id FROM d""")
def source_by_suffix(spark, d):
    """The first source whose host is a document's, one above or one below it; else the first source.

    Each host is exploded into its own suffixes, so that the two suffix tests are equi joins.
    """
    suffixes = lambda h: F.transform(F.sequence(F.lit(1), F.size(F.split(h, r"\."))), lambda i: F.array_join(F.slice(F.split(h, r"\."), i, 99), "."))
    sources = table(spark, d, "sources").select("source_id", _host(F.col("url")).alias("h")).where("h <> ''")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "news.").otherwise(""), _host(F.col("url"))).alias("h"))
    hosts = docs.select("h").distinct()  # hosts are few beside documents
    above = hosts.select("h", F.explode(suffixes(F.col("h"))).alias("s")).join(sources.select("source_id", F.col("h").alias("s")), "s").select("h", "source_id")
    below = sources.select("source_id", F.explode(suffixes(F.col("h"))).alias("h")).join(hosts, "h").select("h", "source_id")
    best = above.unionByName(below).groupBy("h").agg(F.min("source_id").alias("found"))
    first = table(spark, d, "sources").agg(F.min("source_id")).first()[0]
    return docs.join(best, "h", "left").select("doc_id", F.coalesce("found", F.lit(first)).alias("source_id"))


@query(r"""
WITH a AS (SELECT article_id, url, title, content, author, row_number() OVER (PARTITION BY url ORDER BY fetched_at, article_id) AS n FROM dajiala_article WHERE url <> ''),
h AS (SELECT url, title, content FROM a WHERE n = 1), t AS (SELECT url, max(n) AS m FROM a GROUP BY 1), l AS (SELECT a.* FROM a JOIN t ON a.url = t.url AND a.n = t.m)
SELECT h.url, coalesce(nullif(l.title, ''), h.title) AS title, length(coalesce(nullif(l.content, ''), h.content)) AS letters, coalesce(l.author, '') AS author FROM h LEFT JOIN l USING (url)""")
def history_with_detail(spark, d):
    """Each address's first record with what its last one says, where that isn't empty."""
    rows = table(spark, d, "dajiala_article").where("url <> ''")
    order = F.struct("fetched_at", "article_id")
    both = rows.groupBy("url").agg(F.min_by(F.struct("title", "content"), order).alias("h"), F.max_by(F.struct("title", "content", "author"), order).alias("l"))
    pick = lambda f: F.coalesce(F.nullif(F.col(f"l.{f}"), F.lit("")), F.col(f"h.{f}"))
    return both.select("url", pick("title").alias("title"), F.length(pick("content")).alias("letters"), F.coalesce("l.author", F.lit("")).alias("author"))


@query(r"""
WITH u AS (SELECT row_id, unnest(list_distinct(list_concat([primary_url], from_json(source_urls_json, '["VARCHAR"]')))) AS url FROM projects WHERE status IN ('approved', 'auto_approved')),
g AS (SELECT url, count(*) AS hints, min(row_id) AS first_hint FROM u WHERE regexp_matches(url, '^https?://') GROUP BY 1)
SELECT p.row_id, g.hints, g.first_hint FROM projects p JOIN g ON p.primary_url = g.url""")
def baseline_hints(spark, d):
    """The confirmed rows that name each row's address, from their exploded addresses."""
    p = table(spark, d, "projects")
    urls = F.array_distinct(F.concat(F.array("primary_url"), F.coalesce(F.from_json("source_urls_json", "array<string>"), F.array().cast("array<string>"))))
    hints = p.where(F.col("status").isin("approved", "auto_approved")).select("row_id", F.explode(urls).alias("url")).where(F.col("url").rlike("^https?://"))
    by = hints.groupBy("url").agg(F.count("*").alias("hints"), F.min("row_id").alias("first_hint"))
    return p.where("primary_url IS NOT NULL").select("row_id", F.col("primary_url").alias("url")).join(by, "url").select("row_id", "hints", "first_hint")


@query(r"""
WITH n AS (SELECT scan_id, row_id, row_number() OVER (PARTITION BY scan_id ORDER BY row_id) AS i FROM projects), a AS (SELECT scan_id, doc_id, row_number() OVER (PARTITION BY scan_id ORDER BY doc_id) AS i FROM documents)
SELECT scan_id, i, row_id, doc_id FROM n JOIN a USING (scan_id, i)""")
def positional_join(spark, d):
    """Rows and documents of a scan, matched by their place in it."""
    place = lambda t, k: table(spark, d, t).select("scan_id", k, F.row_number().over(W.partitionBy("scan_id").orderBy(k)).cast("bigint").alias("i"))
    return place("projects", "row_id").join(place("documents", "doc_id"), ["scan_id", "i"]).select("scan_id", "i", "row_id", "doc_id")


@query(r"""
WITH u AS (SELECT row_id, primary_url, unnest(from_json(source_urls_json, '["VARCHAR"]')) AS url FROM projects),
b AS (SELECT u.row_id, count(DISTINCT d.doc_id) AS documents, min(d.doc_id) AS first_doc FROM u JOIN documents d ON d.canonical_url = u.url GROUP BY 1)
SELECT p.row_id, coalesce(b.documents, 0) AS documents, coalesce(b.first_doc, (SELECT min(doc_id) FROM documents d WHERE d.canonical_url = p.primary_url)) AS first_doc FROM projects p LEFT JOIN b USING (row_id)""")
def evidence_documents(spark, d):
    """The documents behind each row's addresses, else behind its primary address."""
    p = table(spark, d, "projects")
    docs = table(spark, d, "documents").where("canonical_url IS NOT NULL").select("doc_id", F.col("canonical_url").alias("url"))
    bridge = p.select("row_id", F.explode(F.array_distinct(F.from_json("source_urls_json", "array<string>"))).alias("url")).join(docs, "url").groupBy("row_id").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("bridged"))
    primary = docs.groupBy("url").agg(F.min("doc_id").alias("own"))
    rows = p.select("row_id", F.col("primary_url").alias("url"))
    own = rows.where("url IS NOT NULL").join(primary, "url", "left").select("row_id", "own").unionByName(rows.where("url IS NULL").select("row_id", F.lit(None).cast("bigint").alias("own")))
    return own.join(bridge, "row_id", "left").select("row_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("bridged", "own").alias("first_doc"))


@query(rf"""
WITH a AS (SELECT doc_id, source_id, title, CASE WHEN page_type = 'article' THEN 'project' ELSE 'other' END AS kind FROM documents)
SELECT d.doc_id, coalesce(a.kind, '') AS kind, coalesce(s.source_name, d.source_id, 'unknown') AS source FROM documents d LEFT JOIN (SELECT * FROM a WHERE kind = 'project') a USING (doc_id) LEFT JOIN sources s ON s.source_id = d.source_id""")
def documents_with_assessments(spark, d):
    """Every document with its assessment, where it has one, and its source's name."""
    docs = table(spark, d, "documents").select("doc_id", "source_id", "page_type")
    assessments = docs.where("page_type = 'article'").select("doc_id", F.lit("project").alias("a_kind"))
    names = table(spark, d, "sources").select("source_id", "source_name").dropDuplicates(["source_id"])
    joined = docs.join(assessments, "doc_id", "left").join(names, "source_id", "left")
    return joined.select("doc_id", F.coalesce("a_kind", F.lit("")).alias("kind"), F.coalesce("source_name", "source_id", F.lit("unknown")).alias("source"))


# --- reference rows against documents -------------------------------------------------------------------------------

_TOKENS = r"[\s（）()，,、/]+"


@query(r"""
WITH r AS (SELECT row_id, lower(trim(coalesce(fields_json->>'project_name', ''))) AS name, lower(coalesce(fields_json->>'country', '')) AS country, lower(coalesce(fields_json->>'address', '')) AS address, lower(coalesce(fields_json->>'owner', '')) AS owner, primary_url FROM projects WHERE row_id % 100 = 0),
t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(name, '[\s（）()，,、/]+'), lambda x: length(x) >= 2)) AS tokens FROM r),
d AS (SELECT doc_id, url, lower(coalesce(title, '') || chr(10) || coalesce(text, '')) AS w FROM documents),
c AS (SELECT t.row_id, d.doc_id, 20 * (len(tokens) > 0 AND len(list_filter(tokens, lambda x: contains(w, x))) / len(tokens)::DOUBLE >= 0.45)::INT + 15 * ((country <> '' AND contains(w, country)) OR (address <> '' AND contains(w, address)))::INT + 15 * (owner <> '' AND contains(w, substr(owner, 1, 6)))::INT + 5 * coalesce(regexp_extract(d.url, '^https?://(?:www\.)?([^/?#:]+)', 1) = regexp_extract(t.primary_url, '^https?://(?:www\.)?([^/?#:]+)', 1), false)::INT AS points FROM t, d),
n AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY points DESC, doc_id) AS place FROM c WHERE points > 20)
SELECT row_id, doc_id, points, place FROM n WHERE place <= 5""")
def reference_matches(spark, d):
    """The five documents that agree best with each stated reference row (every hundredth row), by name, place, party and host.

    Every document is searched once for all that the references name, and only the five best of each task reach the shuffle.
    """
    f = lambda k: F.lower(F.coalesce(F.get_json_object("fields_json", f"$.{k}"), F.lit("")))
    refs = table(spark, d, "projects").where("row_id % 100 = 0").select("row_id", F.trim(f("project_name")).alias("name"), f("country").alias("country"), f("address").alias("address"), f("owner").alias("owner"), _host(F.col("primary_url")).alias("host"))
    return best_references(refs, table(spark, d, "documents"))


REFERENCES = 20_000  # reference rows (about 4 MB) that are broadcast and scored in one pass; more take several


def best_references(refs, documents, best: int = 5, block: int = REFERENCES):
    """``row_id, doc_id, points, place`` of the ``best`` documents of each reference row, in blocks of a bounded number of rows."""
    tokens = F.array_distinct(F.filter(F.split("name", _TOKENS), lambda x: F.length(x) >= 2))
    refs = cut_lineage(refs.select("row_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"), "country", "address", F.substring("owner", 1, 6).alias("owner"), "host"))
    docs = spread(documents.select("doc_id", "url", "title", "text"))
    docs = docs.select("doc_id", _host(F.col("url")).alias("d_host"), F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("w"))
    # Each task gives five documents a reference at most, so there are a bounded number of tasks.
    docs = docs.coalesce(8 * documents.sparkSession.sparkContext.defaultParallelism)
    schema = T.StructType([refs.schema["row_id"], documents.schema["doc_id"], T.StructField("points", T.IntegerType())])
    blocks, parts = max(1, -(-refs.count() // block)), []
    for b in range(blocks):
        known = documents.sparkSession.sparkContext.broadcast(refs.where(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == b).toArrow())
        parts.append(docs.mapInArrow(best_documents(known, best), schema))
    scored = reduce(lambda a, b: a.unionByName(b), parts)
    return scored.withColumn("place", F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("points"), "doc_id")).cast("bigint")).where(F.col("place") <= best).select("row_id", "doc_id", "points", "place")


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("SELECT scan_id, coalesce(max(revision), 0) + 1 AS next_revision, coalesce(sum(json_array_length(conflicts_json)), 0)::BIGINT AS conflicts, count(*) FILTER (status IN ('approved', 'auto_approved')) AS reviewed, count(*) FILTER (status NOT IN ('approved', 'auto_approved')) AS uncertain FROM projects GROUP BY 1")
def scan_rollup(spark, d):
    """Next revision, conflicts, reviewed and uncertain rows of each scan."""
    ok = F.col("status").isin("approved", "auto_approved")
    return table(spark, d, "projects").groupBy("scan_id").agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision"), F.coalesce(F.sum(F.json_array_length("conflicts_json")), F.lit(0)).cast("bigint").alias("conflicts"), F.count_if(ok).alias("reviewed"), F.count_if(~ok).alias("uncertain"))


@query(r"""
WITH c AS (SELECT doc_id, source_id, n_chars, CASE WHEN page_type = 'article' THEN 'project_report' WHEN page_type = 'roundup' THEN 'uncertain' ELSE 'non_project' END AS k, row_number() OVER (PARTITION BY source_id, title ORDER BY doc_id) AS first FROM documents)
SELECT source_id, CASE WHEN bool_or(k = 'project_report') THEN 'project_report' WHEN bool_or(k = 'uncertain') THEN 'uncertain' ELSE 'non_project' END AS classification, coalesce(max(n_chars) FILTER (k = 'project_report'), max(n_chars)) AS longest, count(*) FILTER (first = 1) AS distinct_mentions, count(*) AS chunks FROM c GROUP BY 1""")
def merged_assessments(spark, d):
    """The parts of each source as one: any report wins, then any doubt; the greatest of the reports; mentions by signature, the first each."""
    kind = F.when(F.col("page_type") == "article", "project_report").when(F.col("page_type") == "roundup", "uncertain").otherwise("non_project")
    rows = table(spark, d, "documents").select("source_id", "title", "n_chars", kind.alias("k"))
    # Titles are counted by their distinct partial sets; a hot source is combined before the shuffle.
    by = rows.groupBy("source_id", "title").agg(F.count("*").alias("n"), F.bool_or(F.col("k") == "project_report").alias("report"), F.bool_or(F.col("k") == "uncertain").alias("doubt"), F.max("n_chars").alias("longest"), F.max(F.when(F.col("k") == "project_report", F.col("n_chars"))).alias("of_reports"))
    merged = by.groupBy("source_id").agg(F.bool_or("report").alias("report"), F.bool_or("doubt").alias("doubt"), F.coalesce(F.max("of_reports"), F.max("longest")).alias("longest"), F.count("*").alias("distinct_mentions"), F.sum("n").alias("chunks"))
    return merged.select("source_id", F.when(F.col("report"), "project_report").when(F.col("doubt"), "uncertain").otherwise("non_project").alias("classification"), "longest", "distinct_mentions", "chunks")


@query("SELECT source_id, CASE WHEN bool_and(failure_code IS NULL) THEN 'healthy' WHEN bool_or(failure_code IS NULL) THEN 'degraded' ELSE 'failed' END AS health, max(length(title)) AS longest_title FROM documents GROUP BY 1")
def source_health(spark, d):
    """Healthy, degraded or failed: what each source's fetches say."""
    ok = F.col("failure_code").isNull()
    return table(spark, d, "documents").groupBy("source_id").agg(F.when(F.bool_and(ok), "healthy").when(F.bool_or(ok), "degraded").otherwise("failed").alias("health"), F.max(F.length("title")).alias("longest_title"))


@query(r"""
WITH u AS (SELECT row_id, unnest(json_keys(fields_json)) AS field, fields_json, source_id FROM projects)
SELECT field, bool_or(s.country NOT IN ('China', '中国') AND trim(coalesce(fields_json->>('$."' || field || '"'), '')) <> '') AS bilingual FROM u LEFT JOIN sources s USING (source_id) GROUP BY 1""")
def bilingual_columns(spark, d):
    """The fields that an export shows in two languages: those that a foreign source fills."""
    src = table(spark, d, "sources").select("source_id", F.col("country").alias("s_country")).dropDuplicates(["source_id"])
    rows = table(spark, d, "projects").select("source_id", F.explode(F.from_json("fields_json", "map<string,string>")).alias("field", "value")).join(src, "source_id", "left")
    return rows.groupBy("field").agg(F.bool_or(~F.col("s_country").isin("China", "中国") & (F.trim(F.coalesce("value", F.lit(""))) != "")).alias("bilingual"))


@query(r"""
WITH s AS (SELECT scan_id, source_id, count(*) AS pages, count(*) FILTER (failure_code IN ('ACCESS_DENIED', 'BOT_CHALLENGE', 'RATE_LIMITED')) AS blocked, count(*) FILTER (page_type = 'article') AS assessed, count(*) FILTER (error IS NOT NULL) AS errors FROM documents GROUP BY 1, 2),
t AS (SELECT scan_id, sum(pages) AS pages, max(pages) * 1.0 / sum(pages) AS share, sum(blocked) AS blocked, sum(assessed) AS assessed, sum(errors) AS errors FROM s GROUP BY 1)
SELECT scan_id, share, array_to_string(list_filter([CASE WHEN pages > 0 AND assessed = 0 THEN 'CLASSIFICATION_STARVATION' END, CASE WHEN share > 0.5 THEN 'SOURCE_BUDGET_MONOPOLY' END, CASE WHEN blocked > 0 THEN 'ACCESS_BLOCKED' END, CASE WHEN errors > 0 THEN 'DISCOVERY_FAILURES' END, CASE WHEN errors = 0 AND assessed = 0 THEN 'MODEL_NOT_INVOKED' END], lambda v: v IS NOT NULL), ',') AS causes FROM t""")
def scan_causes(spark, d):
    """What explains each scan's outcome: the share of its greatest source and the rules that hold."""
    c = F.col
    by = table(spark, d, "documents").groupBy("scan_id", "source_id").agg(F.count("*").alias("pages"), F.count_if(c("failure_code").isin("ACCESS_DENIED", "BOT_CHALLENGE", "RATE_LIMITED")).alias("blocked"), F.count_if(c("page_type") == "article").alias("assessed"), F.count("error").alias("errors"))
    t = by.groupBy("scan_id").agg(F.sum("pages").alias("pages"), (F.max("pages") * 1.0 / F.sum("pages")).alias("share"), F.sum("blocked").alias("blocked"), F.sum("assessed").alias("assessed"), F.sum("errors").alias("errors"))
    rules = [(c("pages") > 0) & (c("assessed") == 0), c("share") > 0.5, c("blocked") > 0, c("errors") > 0, (c("errors") == 0) & (c("assessed") == 0)]
    names = ["CLASSIFICATION_STARVATION", "SOURCE_BUDGET_MONOPOLY", "ACCESS_BLOCKED", "DISCOVERY_FAILURES", "MODEL_NOT_INVOKED"]
    return t.select("scan_id", "share", F.array_join(F.array_compact(F.array(*(F.when(r, n) for r, n in zip(rules, names)))), ",").alias("causes"))


# --- rankings -------------------------------------------------------------------------------------------------------

_FILES = "|".join(FILE_TYPES)
_PATH_SQL = r"regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1)"
_METHODS = "rss page-link archive sitemap search mcp source".split()


@query(rf"""
WITH d AS (SELECT source_id, canonical_url AS u, min(title) AS label, min(strftime(fetched_at, '%Y-%m-%d')) AS hint, ['{"','".join(_METHODS)}'][1 + min(doc_id) % 7] AS method FROM documents WHERE canonical_url <> '' AND NOT regexp_matches(canonical_url, '(?i)\.(?:{_FILES})(?:$|\?)') GROUP BY 1, 2),
s AS (SELECT *, CASE method {" ".join(f"WHEN '{k}' THEN {v}" for k, v in METHOD_POINTS.items())} END + CASE WHEN hint BETWEEN '2024-01-01' AND '2025-06-30' THEN 80 WHEN hint >= '2024-01-01' THEN 20 ELSE 0 END + CASE WHEN regexp_matches({_PATH_SQL}, '(?i){CONTENT_PATH}') THEN 18 ELSE 0 END
  + CASE WHEN regexp_matches({_PATH_SQL} || ' ' || coalesce(label, ''), '(?i){ENERGY}') OR regexp_matches({_PATH_SQL} || ' ' || coalesce(label, ''), '(?i){PROJECT}') THEN 22 ELSE 0 END - CASE WHEN regexp_matches({_PATH_SQL}, '(?i)(?:^|/)(?:archive|category|search|list|page)(?:/|$)') THEN 25 ELSE 0 END AS score FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, hint DESC, u) AS place FROM s)
SELECT source_id, u AS url, method, score, place FROM n WHERE place <= 20""")
def ranked_candidates(spark, d):
    """The twenty best discovered addresses of each source by the points of method, date, path and words."""
    docs = table(spark, d, "documents").where(F.col("canonical_url") != "").where(~F.col("canonical_url").rlike(X.BINARY))
    method = F.array(*map(F.lit, _METHODS))[(F.min("doc_id") % 7).cast("int")]
    found = docs.groupBy("source_id", F.col("canonical_url").alias("url")).agg(F.min("title").alias("label"), F.min(F.date_format("fetched_at", "yyyy-MM-dd")).alias("hint"), method.alias("method"))
    return rank_candidates(found, "2024-01-01", "2025-06-30", 20)


def rank_candidates(found, start: str, end: str, best: int):
    """The ``best`` addresses of each source (source_id, url, label, hint, method), the most points first, then the latest date."""
    path = C.path_of(F.col("url"))
    words = F.concat(path, F.lit(" "), F.coalesce("label", F.lit("")))
    points = F.create_map(*(F.lit(x) for pair in METHOD_POINTS.items() for x in pair))[F.col("method")]
    has = lambda text, pattern, n: F.when(text.rlike(f"(?i){pattern}"), n).otherwise(0)
    dated = F.when(F.col("hint").between(start, end), 80).when(F.col("hint") >= start, 20).otherwise(0)
    signal = F.when(words.rlike(f"(?i){ENERGY}") | words.rlike(f"(?i){PROJECT}"), 22).otherwise(0)
    scored = found.withColumn("score", points + dated + has(path, CONTENT_PATH, 18) + signal - has(path, r"(?:^|/)(?:archive|category|search|list|page)(?:/|$)", 25))
    # Ranked within partitions first: a source of a third of all rows sends only its best ones on.
    order = [F.desc("score"), F.desc("hint"), "url"]
    local = scored.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.row_number().over(W.partitionBy("source_id", "_p").orderBy(*order))).where(F.col("_n") <= best)
    placed = local.withColumn("place", F.row_number().over(W.partitionBy("source_id").orderBy(*order)).cast("bigint"))
    return placed.where(F.col("place") <= best).select("source_id", "url", "method", "score", "place")


@query(rf"""
WITH e AS (SELECT row_id, unnest(from_json(source_urls_json, '["VARCHAR"]')) AS u, unnest(range(json_array_length(source_urls_json)::INT)) AS i FROM projects),
f AS (SELECT row_id, u, min(i) AS i FROM e GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN regexp_matches({_PATH_SQL}, '(?i){ARTICLE_URL}') THEN 45 ELSE 0 END + CASE WHEN regexp_matches(u, '(?i)project|solar|storage|battery|wind|光伏|储能|风电|中标|签约') THEN 22 ELSE 0 END - CASE WHEN regexp_matches(u, '(?i)about|profile|services?|products?|contact|career|data-and-statistics') THEN 30 ELSE 0 END AS score FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, i) AS place FROM s) SELECT row_id, u AS url, score, place FROM n""")
def reranked_urls(spark, d):
    """Each row's distinct addresses, the likeliest article first, else in the order given."""
    listed = F.array_distinct(F.from_json("source_urls_json", "array<string>"))
    u = F.col("url")
    score = F.when(C.article_url(u), 45).otherwise(0) + F.when(u.rlike("(?i)project|solar|storage|battery|wind|光伏|储能|风电|中标|签约"), 22).otherwise(0) - F.when(u.rlike("(?i)about|profile|services?|products?|contact|career|data-and-statistics"), 30).otherwise(0)
    rows = table(spark, d, "projects").select("row_id", F.posexplode(listed).alias("i", "url")).withColumn("score", score)
    # A row's addresses are an array of its own, so this window is as small as that.
    return rows.select("row_id", "url", "score", F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("score"), "i")).cast("bigint").alias("place"))


@query(r"""
WITH p AS (SELECT scan_id, count(*) AS results, count(*) FILTER (status IN ('approved', 'auto_approved')) AS accepted FROM projects GROUP BY 1),
k AS (SELECT s.scan_id, s.created_at, s.start_date, s.end_date, array_to_string(list_sort(list_distinct(s.source_ids)), ',') AS sources, s.status, coalesce(p.results, 0) AS results, coalesce(p.accepted, 0) AS accepted FROM scans s LEFT JOIN p USING (scan_id)),
c AS (SELECT a.scan_id, b.scan_id AS baseline, a.results, a.accepted, b.results AS b_results, b.accepted AS b_accepted, row_number() OVER (PARTITION BY a.scan_id ORDER BY b.accepted DESC, b.results DESC, b.created_at DESC, b.scan_id) AS n FROM k a JOIN k b ON a.sources = b.sources AND b.status = 'completed' AND b.created_at < a.created_at AND b.results > 0)
SELECT k.scan_id, c.baseline, CASE WHEN c.baseline IS NULL THEN 'no_baseline' WHEN k.results < b_results OR k.accepted < b_accepted THEN 'regressed' WHEN k.results > b_results OR k.accepted > b_accepted THEN 'improved' ELSE 'stable' END AS recall FROM k LEFT JOIN (SELECT * FROM c WHERE n = 1) c USING (scan_id)""")
def recall_baselines(spark, d):
    """For each scan the earlier completed one of the same sources with most accepted rows, and how the scan compares."""
    ok = F.col("status").isin("approved", "auto_approved")
    counts = table(spark, d, "projects").groupBy("scan_id").agg(F.count("*").alias("results"), F.count_if(ok).alias("accepted"))
    k = table(spark, d, "scans").select("scan_id", "created_at", "status", F.array_join(F.array_sort(F.array_distinct("source_ids")), ",").alias("sources")).join(counts, "scan_id", "left").na.fill(0, ["results", "accepted"])
    b = k.where("status = 'completed' AND results > 0").select("sources", F.struct("accepted", "results", "created_at", (F.lit("~")).alias("z"), "scan_id").alias("b"))
    earlier = k.join(b, "sources").where(F.col("b.created_at") < F.col("created_at"))
    best = earlier.groupBy("scan_id").agg(F.min_by("b", F.struct(-F.col("b.accepted"), -F.col("b.results"), -F.unix_micros(F.col("b.created_at").cast("timestamp")), F.col("b.scan_id"))).alias("b"))
    joined = k.join(best, "scan_id", "left")
    lower = (F.col("results") < F.col("b.results")) | (F.col("accepted") < F.col("b.accepted"))
    higher = (F.col("results") > F.col("b.results")) | (F.col("accepted") > F.col("b.accepted"))
    return joined.select("scan_id", F.col("b.scan_id").alias("baseline"), F.when(F.col("b").isNull(), "no_baseline").when(lower, "regressed").when(higher, "improved").otherwise("stable").alias("recall"))


@query(r"""
SELECT scan_id, row_id, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC NULLS LAST, created_at, row_id) AS place FROM projects""")
def results_in_order(spark, d):
    """Each scan's rows by score, then age: global places without one task a scan.

    Rows are range-partitioned by scan and order, numbered within each partition, and shifted by the counts of the partitions before.
    """
    rows = table(spark, d, "projects").select("scan_id", "row_id", (-F.col("score")).alias("s"), "created_at")
    keys = ["scan_id", "s", "created_at", "row_id"]
    spread = cut_lineage(rows.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]).withColumn("_p", F.spark_partition_id()))
    here = spread.groupBy("scan_id", "_p").agg(F.count("*").alias("n"))
    before = here.withColumn("shift", F.coalesce(F.sum("n").over(W.partitionBy("scan_id").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = spread.withColumn("i", F.row_number().over(W.partitionBy("scan_id", "_p").orderBy(*[F.col(k).asc_nulls_last() for k in keys])))
    return numbered.join(F.broadcast(before), ["scan_id", "_p"]).select("scan_id", "row_id", (F.col("i") + F.col("shift")).alias("place"))


@query(r"""SELECT doc_id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, fetched_at, doc_id) AS place FROM documents QUALIFY place <= 100""")
def newest_articles(spark, d):
    """The hundred newest articles by the text of their time, unknown ones last."""
    top = table(spark, d, "documents").select("doc_id", "published_at", "fetched_at").orderBy(F.desc_nulls_last("published_at"), "fetched_at", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(W.orderBy(F.desc_nulls_last("published_at"), "fetched_at", "doc_id")).cast("bigint").alias("place"))


@query(r"""
WITH t AS (SELECT row_id, list_distinct(list_filter([fields_json->>'owner', fields_json->>'address', fields_json->>'country'], lambda v: length(v) >= 2)) AS m FROM projects)
SELECT row_id, array_to_string(list_transform(list_reverse_sort(list_transform(m, lambda v: lpad(length(v)::VARCHAR, 6, '0') || v)), lambda v: substr(v, 7)), '|') AS tokens FROM t""")
def highlight_order(spark, d):
    """The values to be marked in a row's evidence, the longest first."""
    f = lambda k: F.get_json_object("fields_json", f"$.{k}")
    marks = F.array_distinct(F.filter(F.array(f("owner"), f("address"), f("country")), lambda v: F.length(v) >= 2))
    keyed = F.sort_array(F.transform(marks, lambda v: F.concat(F.lpad(F.length(v).cast("string"), 6, "0"), v)), asc=False)
    return table(spark, d, "projects").select("row_id", F.array_join(F.transform(keyed, lambda v: F.substring(v, 7, 100000)), "|").alias("tokens"))


# --- sets -----------------------------------------------------------------------------------------------------------


@query(r"""
SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([primary_url], from_json(source_urls_json, '["VARCHAR"]')), lambda u: u IS NOT NULL))), ' ') AS all_urls,
  array_to_string(list_sort(list_filter(list_distinct(json_keys(evidence_json)), lambda k: NOT list_contains(json_keys(fields_json), k))), ' ') AS unknown_keys FROM projects""")
def url_unions(spark, d):
    """The union of each row's addresses, and the evidence keys that its fields don't have."""
    urls = F.array_union(F.array("primary_url"), F.coalesce(F.from_json("source_urls_json", "array<string>"), F.array().cast("array<string>")))
    keys = lambda c: F.coalesce(F.map_keys(F.from_json(c, "map<string,string>")), F.array().cast("array<string>"))
    return table(spark, d, "projects").select("row_id", F.array_join(F.array_sort(F.array_compact(urls)), " ").alias("all_urls"), F.array_join(F.array_sort(F.array_except(keys("evidence_json"), keys("fields_json"))), " ").alias("unknown_keys"))


@query("SELECT canonical_url AS url, min(doc_id) AS doc_id FROM documents WHERE canonical_url <> '' GROUP BY 1")
def visited_once(spark, d):
    """Every address once over all sources, with the document that came first."""
    return table(spark, d, "documents").where("canonical_url <> ''").groupBy(F.col("canonical_url").alias("url")).agg(F.min("doc_id").alias("doc_id"))


@query(r"""
SELECT scan_id, CAST(row_id AS VARCHAR) AS id, 'project' AS kind FROM projects WHERE score >= 60
UNION ALL SELECT scan_id, CAST(doc_id AS VARCHAR), 'document' FROM documents WHERE scan_id NOT IN (SELECT scan_id FROM projects WHERE score >= 60 AND scan_id IS NOT NULL)""")
def results_or_legacy(spark, d):
    """A scan's rows, or its documents where it has none."""
    rows = table(spark, d, "projects").where("score >= 60").select("scan_id", F.col("row_id").cast("string").alias("id"), F.lit("project").alias("kind"))
    docs = table(spark, d, "documents").where("scan_id IS NOT NULL").select("scan_id", F.col("doc_id").cast("string").alias("id"), F.lit("document").alias("kind"))
    return rows.unionByName(docs.join(F.broadcast(rows.select("scan_id").distinct()), "scan_id", "left_anti"))
