"""The engine's calls on a user's own tables; every one takes and gives DataFrames.

    engine = Engine(documents=..., projects=..., sources=..., scans=...)
    engine.results("scan-1"); engine.diagnostics("scan-1"); engine.review(decisions)

Tables have the columns of TESTDATA.md; a call names those it needs in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampora.operators import html, resolve
from ampora.plans.classify import assessed
from ampora.plans.outputs import decided
from ampora.plans.relations import best_references, rank_candidates
from ampora.sources import sinks

OPEN, APPROVED = ("review",), ("approved", "auto_approved")


class Engine:
    """The tables of one body of work."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"no table {name}") from None

    def with_tables(self, **tables: DataFrame) -> Engine:
        """The same engine over some other tables."""
        return Engine(**(self.tables | tables))

    # --- what there is

    def dashboard(self) -> DataFrame:
        """``name, n``: rows of every table, and of those to be reviewed."""
        counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in self.tables.items()]
        if "projects" in self.tables:
            counts.append(self.projects.agg(F.count_if(F.col("status").isin(*OPEN)).alias("n")).select(F.lit("pending").alias("name"), "n"))
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def recent_scans(self, n: int = 50) -> DataFrame:
        """The newest scans."""
        return self.scans.orderBy(F.desc("created_at"), "scan_id").limit(n)

    def results(self, scan_id: str) -> DataFrame:
        """A scan's project rows, the best first."""
        return self.projects.where(F.col("scan_id") == scan_id).orderBy(F.desc_nulls_last("score"), "created_at", "row_id")

    def articles(self, scan_id: str) -> DataFrame:
        """A scan's documents with their classes, the newest first; needs title, text, url, page_type, published_at."""
        own = self.documents.where(F.col("scan_id") == scan_id)
        return assessed(own).orderBy(F.desc_nulls_last("published_at"), "fetched_at", "doc_id")

    def full_text(self, doc_id: int) -> DataFrame:
        """One document's text."""
        return self.documents.where(F.col("doc_id") == doc_id).select("doc_id", "title", "url", "published_at", "text")

    def logs(self, after: int = 0, limit: int = 200) -> DataFrame:
        """Events behind a cursor (event_id), between one and two thousand."""
        return self.events.where(F.col("event_id") > after).orderBy("event_id").limit(max(1, min(2_000, limit)))

    def diagnostics(self, scan_id: str) -> DataFrame:
        """``source_id, pages, succeeded, share, blocked``: what each source gave a scan."""
        own = self.documents.where(F.col("scan_id") == scan_id)
        by = own.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("failure_code").isin("ACCESS_DENIED", "BOT_CHALLENGE", "RATE_LIMITED")).alias("blocked"))
        return by.withColumn("share", F.col("pages") / F.sum("pages").over(W.partitionBy()))

    # --- what is made of it

    def parse(self, pages: DataFrame) -> DataFrame:
        """Captured pages (raw_path, url, html) as documents."""
        return html.documents(pages)

    def discover(self, found: DataFrame, start: str, end: str, best: int) -> DataFrame:
        """The best discovered addresses of each source (source_id, url, label, hint, method)."""
        return rank_candidates(found, start, end, best)

    def assess_pending(self, done: DataFrame) -> DataFrame:
        """Classes of the readable documents that ``done`` (doc_id) doesn't have."""
        return assessed(self.documents.where("error IS NULL AND length(text) > 0").join(done.select("doc_id"), "doc_id", "left_anti"))

    def resolve(self, mentions: DataFrame) -> DataFrame:
        """Entities of mentions, see ``operators.resolve``."""
        return resolve.resolve(mentions)

    def match_references(self, references: DataFrame) -> DataFrame:
        """The five documents that agree best with each reference row (row_id, name, country, address, owner, host)."""
        return best_references(references, self.documents)

    # --- what is decided

    def review(self, decisions: DataFrame) -> Engine:
        """The engine after decisions (row_id, decision) on project rows; decided rows get a revision more."""
        changed = decided(self.projects.select("row_id", "status", "revision"), decisions)
        return self.with_tables(projects=self.projects.drop("status", "revision").join(changed, "row_id"))

    def approve_all(self, scan_id: str) -> Engine:
        """The engine after all of a scan's rows under review are approved; approved ones stay as they are."""
        open_rows = self.projects.where((F.col("scan_id") == scan_id) & F.col("status").isin(*OPEN))
        return self.review(open_rows.select("row_id", F.lit("approved").alias("decision")))

    def delete_scan(self, scan_id: str) -> Engine:
        """The engine without a scan and what belongs to it; a scan that still runs can't be deleted."""
        if "scans" in self.tables and not self.scans.where((F.col("scan_id") == scan_id) & ~F.col("status").isin("completed", "failed", "stopped")).isEmpty():
            raise ValueError("the scan is running")
        keep = lambda t: t.where(F.col("scan_id").isNull() | (F.col("scan_id") != scan_id)) if "scan_id" in t.columns else t
        return Engine(**{name: keep(t) for name, t in self.tables.items()})

    def snapshot(self, scan_id: str, snapshot_id: str, path: str, include_flagged: bool = False) -> None:
        """Writes a scan's rows as an immutable snapshot, see ``sources.sinks``."""
        sinks.snapshot(self.projects, scan_id, snapshot_id, path, include_flagged)

    def report(self, scan_id: str, fields: list[str]) -> DataFrame:
        """The lines of a scan's report in order."""
        own = self.documents.where((F.col("scan_id") == scan_id) & F.col("page_type").isNotNull())
        coverage = own.groupBy(F.col("page_type").alias("label")).agg(F.count("*").alias("n"))
        return sinks.report_lines(self.projects.where(F.col("scan_id") == scan_id), coverage, fields).orderBy("place").select("line")
