"""Queries on captured pages: documents, links, blocks and what was sent in another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.address import resolved
from ampora.operators import classify as C
from ampora.operators import discovery, html
from ampora.plans.registry import Registry
from ampora.session import spread, table

_R = Registry()
query, queries, oracle_sql = _R.query, _R.queries, _R.oracle_sql

_UNESCAPE = "replace(replace(replace(replace(replace({x}, '&#x27;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _un(x: str) -> str:
    return _UNESCAPE.replace("{x}", x)


def _pages(spark, d):
    return spread(table(spark, d, "page_capture").select("raw_path", "url", "html"))


@query()
def parsed_pages(spark, d):
    """Each captured page as a document: title, dates, body, type and features."""
    rows = html.documents(_pages(spark, d))
    return rows.select("raw_path", "title", "published_at", F.size("date_candidates").alias("dates"), "page_type", "method", F.length("text").alias("letters"), "links", "longest_prose", "needs_render", "fake_thick")


@query(rf"""
WITH p AS (SELECT raw_path, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h, regexp_extract(html, '<title>(.*?)</title>', 1) AS t, url,
   regexp_extract(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '20[0-9]{{2}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}', 0) AS u,
   regexp_extract({_un("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<(script|style).*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')")}, '20[0-9]{{2}}[-/.年][0-9]{{1,2}}[-/.月][0-9]{{1,2}}', 0) AS b FROM page_capture WHERE html IS NOT NULL AND url IS NOT NULL),
q AS (SELECT raw_path, CASE WHEN trim(h) <> '' THEN h WHEN trim(t) <> '' THEN t ELSE url END AS title, string_split_regex(CASE WHEN u <> '' THEN u ELSE b END, '[^0-9]+') AS n FROM p)
SELECT raw_path, trim(regexp_replace({_un("title")}, '\s+', ' ', 'g')) AS title, CASE WHEN len(n) >= 3 THEN n[1] || '-' || lpad(n[2], 2, '0') || '-' || lpad(n[3], 2, '0') END AS published_at FROM q""")
def page_heads(spark, d):
    """The title and date of each captured page, by order of precedence."""
    return html.documents(_pages(spark, d)).select("raw_path", "title", "published_at")


@query()
def page_links(spark, d):
    """The links of each captured page with their labels and the dates nearby."""
    return html.links(_pages(spark, d)).withColumn("kinds", discovery.link_kinds(F.col("href"), F.col("label"), F.col("hint"))).select("raw_path", "from_url", "href", "label", "hint", "kinds.*")


@query()
def archive_walk(spark, d):
    """The content addresses that a walk from each source's page over archived links finds in three rounds."""
    links = html.links(_pages(spark, d))
    starts = table(spark, d, "sources").where("url IS NOT NULL").select("url")
    return discovery.walk(links, starts, "2024-01-01", rounds=3)[0]


@query(rf"""
WITH r AS (SELECT raw_path, CASE WHEN contains(html, '<article') THEN regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) WHEN contains(html, '<main') THEN regexp_extract(html, '(?s)<main[^>]*>(.*?)</main>', 1) ELSE regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1) END AS root FROM page_capture WHERE html IS NOT NULL),
m AS (SELECT raw_path, regexp_extract_all(root, '<(h1|h2|h3|h4|p|li|blockquote|pre)>([^<]*)</', 1) AS tags, regexp_extract_all(root, '<(h1|h2|h3|h4|p|li|blockquote|pre)>([^<]*)</', 2) AS texts FROM r),
x AS (SELECT raw_path, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag, unnest(texts) AS text FROM m),
b AS (SELECT raw_path, i, CASE tag WHEN 'h1' THEN '# ' WHEN 'h2' THEN '## ' WHEN 'h3' THEN '### ' WHEN 'h4' THEN '#### ' WHEN 'li' THEN '- ' WHEN 'blockquote' THEN '> ' ELSE '' END || trim(regexp_replace({_un("text")}, '[\s\x{{00a0}}\x{{3000}}]+', ' ', 'g')) AS block, length(trim(regexp_replace({_un("text")}, '[\s\x{{00a0}}\x{{3000}}]+', ' ', 'g'))) AS n FROM x),
l AS (SELECT *, lag(block) OVER (PARTITION BY raw_path ORDER BY i) AS before FROM b WHERE n >= 2)
SELECT raw_path, count(*) AS blocks, md5(string_agg(block, chr(10) ORDER BY i)) AS digest FROM l WHERE before IS DISTINCT FROM block GROUP BY 1""")
def page_blocks(spark, d):
    """Each page's blocks as Markdown: their number and digest."""
    rows = html.markdown(_pages(spark, d))
    # A page's blocks are as many as it has elements, so its list is no larger than the page.
    return rows.groupBy("raw_path").agg(F.count("*").alias("blocks"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n").cast("binary")).alias("digest"))


@query(r"""
SELECT raw_path, CASE WHEN html IS NULL OR starts_with(html, '%PDF') OR NOT coalesce(content_type LIKE 'text/%', false) THEN false ELSE true END AS loadable, length(substr(html, 1, 8388608)) AS letters FROM page_capture""")
def loadable_pages(spark, d):
    """Which captured pages can be read as mark-up: text types, not PDF by their first letters; the first 8 MiB letters."""
    page = F.col("html")
    ok = page.isNotNull() & ~page.startswith("%PDF") & F.coalesce(F.col("content_type").like("text/%"), F.lit(False))
    return table(spark, d, "page_capture").select("raw_path", F.coalesce(ok, F.lit(False)).alias("loadable"), F.length(F.substring("html", 1, 8_388_608)).alias("letters"))


@query(r"""
SELECT doc_id, CASE WHEN contains(lower(content_type), 'charset=') THEN upper(regexp_extract(content_type, '(?i)charset=([\w-]+)', 1)) ELSE 'UTF-8' END AS charset, md5(coalesce(title, '')) AS decoded FROM documents""")
def declared_charsets(spark, d):
    """Titles encoded and decoded again by the charset that each document's type declares, else UTF-8."""
    charset = F.when(F.lower("content_type").contains("charset="), F.upper(F.regexp_extract("content_type", r"(?i)charset=([\w-]+)", 1))).otherwise("UTF-8")
    rows = table(spark, d, "documents").select("doc_id", charset.alias("charset"), F.coalesce("title", F.lit("")).alias("t"))
    return rows.select("doc_id", "charset", F.md5(decoded(F.encode("t", "UTF-8"), F.col("charset"))).alias("decoded"))


def decoded(body, charset):
    """Bytes as text in one of the charsets that pages declare; an unknown one is read as UTF-8."""
    known = ("ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE")
    out = F.decode(body, "UTF-8")
    for name in known:
        out = F.when(charset == name, F.decode(body, name)).otherwise(out)
    return out


@query(r"""
WITH d AS (SELECT doc_id, url, source_id, coalesce(nullif(title, ''), url) AS t, substr(trim(replace(coalesce(markdown, text, ''), chr(0), ''), ' ' || chr(10) || chr(9) || chr(13) || '　'), 1, 250000) AS body, status_code FROM documents)
SELECT doc_id, CASE WHEN status_code >= 400 THEN 'HTTP_' || status_code WHEN body = '' THEN 'FETCH_ERROR' END AS failure, CASE WHEN status_code >= 400 OR body = '' THEN 0 ELSE length('# ' || t || chr(10) || chr(10) || '来源：' || url || chr(10) || chr(10) || body) END AS letters,
  CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN 'homepage' WHEN length(body) >= 400 THEN 'article' ELSE 'unknown' END AS page_type FROM d""")
def external_documents(spark, d):
    """Documents made of content that another service delivered: archive text, failure and type."""
    body = F.substring(X.bare(F.replace(F.coalesce("markdown", "text", F.lit("")), F.lit("\0"), F.lit(""))), 1, html.MAX_TEXT)
    rows = table(spark, d, "documents").select("doc_id", "url", "status_code", F.coalesce(F.nullif("title", F.lit("")), "url").alias("t"), body.alias("body"))
    archive = F.concat(F.lit("# "), "t", F.lit("\n\n来源："), "url", F.lit("\n\n"), "body")
    failure = F.when(F.col("status_code") >= 400, F.concat(F.lit("HTTP_"), F.col("status_code").cast("string"))).when(F.col("body") == "", "FETCH_ERROR")
    kind = F.when(C.path_of(F.col("url")).isin("", "/"), "homepage").when(F.length("body") >= 400, "article").otherwise("unknown")
    return rows.select("doc_id", failure.alias("failure"), F.when(failure.isNotNull(), 0).otherwise(F.length(archive)).alias("letters"), kind.alias("page_type"))


# The sections of a feed record's document, in order.
SECTIONS = (
    ("项目名称", "project_name"), ("国家", "country"), ("地区", "region"), ("行业", "industry"), ("规模", "capacity"), ("投资额", "investment"), ("项目地点", "location"), ("技术路线", "technology"), ("项目阶段", "stage"),
    ("开发商", "coalesce(nullif(trim(developer_display), ''), nullif(trim(developer), ''), owner)"), ("EPC/工程承包商", "coalesce(nullif(trim(epc_contractor_display), ''), epc_contractor)"), ("中资参与", "chinese_involvement"), ("预计投运", "cod_date"), ("收录时间", "recorded_at"), ("项目内容", "content"),
)
_SECTION_SQL = ", ".join(f"CASE WHEN trim({c}) <> '' THEN '## {label}' || chr(10) || chr(10) || trim({c}) END" for label, c in SECTIONS)


@query(rf"SELECT record_id, array_to_string(list_filter([{_SECTION_SQL}], lambda v: v IS NOT NULL), chr(10) || chr(10)) AS markdown FROM project_intel")
def record_documents(spark, d):
    """Each feed record as a document of labelled sections, empty ones left out."""
    section = lambda label, c: F.when(X.bare(F.expr(c)) != "", F.concat(F.lit(f"## {label}\n\n"), X.bare(F.expr(c))))
    return table(spark, d, "project_intel").select("record_id", F.array_join(F.array_compact(F.array(*(section(label, c) for label, c in SECTIONS))), "\n\n").alias("markdown"))


@query(r"""
SELECT article_id, array_to_string(list_filter(['微信公众号：' || coalesce(nullif(account_name, ''), '未知'), CASE WHEN account_id <> '' THEN '微信号：' || account_id END, CASE WHEN author <> '' THEN '作者：' || author END, CASE WHEN original THEN '原创状态：原创' WHEN NOT original THEN '原创状态：非原创或转载' END, CASE WHEN ip_wording <> '' THEN '发布地区：' || ip_wording END, CASE WHEN category <> '' THEN '内容分类：' || category END,
  CASE WHEN read_count IS NOT NULL THEN '阅读数：' || read_count END, CASE WHEN praise IS NOT NULL THEN '点赞数：' || praise END, CASE WHEN looking IS NOT NULL THEN '在看数：' || looking END], lambda v: v IS NOT NULL), chr(10)) || chr(10) || chr(10) || '正文：' || chr(10) || coalesce(content, '') AS markdown FROM dajiala_article""")
def article_documents(spark, d):
    """Each article as a document: lines of what is known about it, then its text."""
    line = lambda label, c, when: F.when(when, F.concat(F.lit(label), F.col(c).cast("string")))
    filled = lambda c: F.col(c) != ""
    lines = F.array(
        F.concat(F.lit("微信公众号："), F.coalesce(F.nullif("account_name", F.lit("")), F.lit("未知"))),
        line("微信号：", "account_id", filled("account_id")),
        line("作者：", "author", filled("author")),
        F.when(F.col("original"), "原创状态：原创").when(~F.col("original"), "原创状态：非原创或转载"),
        line("发布地区：", "ip_wording", filled("ip_wording")),
        line("内容分类：", "category", filled("category")),
        *(line(label, c, F.col(c).isNotNull()) for label, c in (("阅读数：", "read_count"), ("点赞数：", "praise"), ("在看数：", "looking"))),
    )
    return table(spark, d, "dajiala_article").select("article_id", F.concat(F.array_join(F.array_compact(lines), "\n"), F.lit("\n\n正文：\n"), F.coalesce("content", F.lit(""))).alias("markdown"))


@query(r"""
WITH a AS (SELECT article_id, trim(coalesce(title, '')) AS title, coalesce(nullif(trim(url), ''), short_link, '') AS url, published_at, TRY_CAST(read_count AS DOUBLE) AS reads, original, article_id % 7 = 0 AS deleted, CASE WHEN article_id % 5 = 0 THEN NULL ELSE article_id % 3 + 1 END AS msg_status FROM dajiala_article)
SELECT article_id, title, url, reads, original FROM a WHERE url <> '' AND title <> '' AND NOT deleted AND (msg_status IS NULL OR msg_status = 2)""")
def history_articles(spark, d):
    """The articles of an account's history that can be read: with address and title, not deleted, sent."""
    k = F.col("article_id")
    rows = table(spark, d, "dajiala_article").select("article_id", F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce(F.nullif(F.trim("url"), F.lit("")), "short_link", F.lit("")).alias("url"), F.col("read_count").try_cast("double").alias("reads"), "original", (k % 7 == 0).alias("deleted"), F.when(k % 5 != 0, k % 3 + 1).alias("msg_status"))
    return rows.where("url <> '' AND title <> '' AND NOT deleted AND (msg_status IS NULL OR msg_status = 2)").select("article_id", "title", "url", "reads", "original")


@query(r"""
SELECT doc_id, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/x/' || doc_id || '.html' AS relative, regexp_replace(regexp_replace(url, '\?from=[^&#]*$', ''), '#.*$', '') AS own FROM documents""")
def resolved_addresses(spark, d):
    """Addresses in one form: a relative one against each document's own, and the document's own."""
    rows = table(spark, d, "documents").select("doc_id", "url")
    relative = F.concat(F.lit("../x/./"), F.col("doc_id").cast("string"), F.lit(".html?utm_source=a#top"))
    base = F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("/news/1.html"))
    return rows.select("doc_id", resolved(relative, base).alias("relative"), resolved("url", F.lit(None).cast("string")).alias("own"))
