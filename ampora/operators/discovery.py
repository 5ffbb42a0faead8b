"""Discovery over a table of links: a breadth-first walk of a site's archive pages, in rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampora.functions import text as X
from ampora.functions.terms import ARCHIVE_PATH, CONTENT_PATH
from ampora.operators.classify import path_of
from ampora.session import cut_lineage

_ORIGIN = r"^(https?://[^/?#]+)"


def link_kinds(href: Column, label: Column, hint: Column) -> Column:
    """Whether a link leads to an archive page, a further page of a list, or content: a struct of three flags."""
    path, text = path_of(href), F.coalesce(label, F.lit(""))
    has = lambda c, p: F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))
    column = has(path, r"/col(?:umn|channel)?[/_]") | has(path, r"(?:^|/)index(?:_\d+)?\.s?html?$")
    turn = has(text, r"^(?:下一页|上页|下页|尾页|next|older|\d{1,3})$")
    paging = turn | has(path, r"(?:^|/)index_\d+\.s?html?$")
    dated = has(path, r"/20\d{2}/\d{1,2}/\d{1,2}/")
    both = F.concat(path, F.lit(" "), text)
    archive = ~dated & (column | turn | (has(both, ARCHIVE_PATH) & has(both, r"page|archive|category|news|press|media|older|next|下一|更多|20\d{2}")))
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    content = hint.isNotNull() | has(path, CONTENT_PATH) | ((F.length(text) >= 8) & ~archive & (depth >= 2))
    return F.struct(archive.alias("archive"), paging.alias("paging"), content.alias("content"))


def walk(links: DataFrame, starts: DataFrame, start_date: str, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``(candidates, visited)`` of a walk from ``starts`` (url) over ``links`` (from_url, href, label, hint).

    Each round visits the frontier's pages; archive pages of the same origin that they link to and that weren't visited are the next
    frontier, further pages of a list only while the page's newest date isn't before ``start_date``. It ends when the frontier
    is empty or after ``rounds``, the walk's depth. Candidates are (url, hint, label, depth): the first find of each content address.
    """
    kinds = link_kinds(F.col("href"), F.col("label"), F.col("hint"))
    origin = lambda c: F.regexp_extract(c, _ORIGIN, 1)
    own = links.where((origin("from_url") == origin("href")) & ~F.col("href").rlike(X.BINARY)).withColumn("k", kinds).select("from_url", "href", "label", "hint", "k.*")
    newest = own.groupBy("from_url").agg(F.max("hint").alias("newest"))
    edges = cut_lineage(own.join(newest, "from_url").withColumn("follow", F.col("archive") & (~F.col("paging") | F.col("newest").isNull() | (F.col("newest") >= start_date))))
    frontier = cut_lineage(starts.select("url").distinct())
    visited, found = None, None
    for depth in range(rounds):
        step = edges.join(frontier.withColumnRenamed("url", "from_url"), "from_url", "left_semi")
        new = step.where("content").groupBy(F.col("href").alias("url")).agg(F.min("hint").alias("hint"), F.min("label").alias("label")).withColumn("depth", F.lit(depth))
        found = cut_lineage(new if found is None else found.unionByName(new.join(found.select("url"), "url", "left_anti")))
        visited = cut_lineage(frontier if visited is None else visited.unionByName(frontier))
        frontier = cut_lineage(step.where("follow").select(F.col("href").alias("url")).distinct().join(visited, "url", "left_anti"))
        if frontier.isEmpty():
            break
    return found, visited
