import os

import pytest
from pyspark.sql import functions as F

from ampora.api import Engine
from ampora.functions.register import register

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(**{t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "projects", "sources", "scans", "events", "page_capture")})


def test_reads(engine):
    scan = engine.projects.groupBy("scan_id").count().orderBy(F.desc("count")).first()[0]
    scores = [r["score"] for r in engine.results(scan).collect()]
    assert scores == sorted(scores, reverse=True) and scores
    assert {"classification", "confidence", "language"} <= set(engine.articles(scan).columns)
    assert engine.full_text(1).count() == 1 and engine.recent_scans(3).count() == 3
    ids = [r["event_id"] for r in engine.logs(10, 5).collect()]
    assert ids == [11, 12, 13, 14, 15] and engine.logs(0, 10**6).count() <= 2_000
    assert {r["name"]: r["n"] for r in engine.dashboard().collect()}["documents"] == engine.documents.count()
    shares = [r["share"] for r in engine.diagnostics(engine.documents.first()["scan_id"]).collect()]
    assert sum(shares) == pytest.approx(1)
    assert engine.parse(engine.page_capture).count() == engine.page_capture.where("html IS NOT NULL AND url IS NOT NULL").count()
    assert engine.assess_pending(engine.documents.where("doc_id > 5")).count() <= 5
    with pytest.raises(AttributeError):
        engine.nothing  # noqa: B018


def test_decisions(engine, tmp_path):
    scan = engine.projects.where("status = 'review'").first()["scan_id"]
    after = engine.approve_all(scan)
    assert after.projects.where((F.col("scan_id") == scan) & (F.col("status") == "review")).count() == 0
    assert after.projects.count() == engine.projects.count() and after.approve_all(scan).projects.agg(F.sum("revision")).first()[0] == after.projects.agg(F.sum("revision")).first()[0]
    gone = engine.delete_scan(scan)
    assert gone.projects.where(F.col("scan_id") == scan).count() == 0 and gone.sources.count() == engine.sources.count()
    running = engine.with_tables(scans=engine.scans.withColumn("status", F.lit("running")))
    with pytest.raises(ValueError):
        running.delete_scan(scan)
    with pytest.raises(ValueError):
        engine.snapshot(scan, "n", str(tmp_path / "s"))
    lines = [r["line"] for r in engine.report(scan, ["country"]).collect()]
    assert lines[0] == "# Report" and lines[1].startswith("- rows: ")


def test_registered_functions(spark):
    assert register(spark) == ["nfkc", "canonical_url", "parse_page", "page_links"]
    row = spark.sql("""SELECT nfkc('ＡＢ') AS a, canonical_url('/x?utm_source=1', 'https://H.example/y') AS b, parse_page('<h1>Title</h1>', 'https://h.example/1').title AS c, page_links('<a href="/z">zz</a>', 'https://h.example/1')[0].href AS d, canonical_url(CAST(NULL AS STRING), '') AS e""").first()
    assert tuple(row) == ("AB", "https://h.example/x", "Title", "https://h.example/z", None)
