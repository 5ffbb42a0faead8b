import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ampora.operators import timestamps as ts


@pytest.mark.parametrize(
    ("value", "zone", "order", "expected"),
    [
        ("2025年3月28日 02:09（北京时间）", "Europe/Paris", "dmy", "2025-03-27T18:09:00.000000Z"),
        ("20230901T084411Z", "Europe/Paris", "dmy", "2023-09-01T08:44:11.000000Z"),
        ("31-01-2026, 16.34", "Europe/Madrid", "dmy", "2026-01-31T15:34:00.000000Z"),
        ("06/11/2024 10:08 PM", "America/New_York", "mdy", "2024-06-12T02:08:00.000000Z"),
        ("12/01/2024 12:05 AM", "UTC", "mdy", "2024-12-01T00:05:00.000000Z"),
        ("2024年11月22日 下午9点43分", "Asia/Shanghai", "ymd", "2024-11-22T13:43:00.000000Z"),
        ("13-Mar-23", "UTC", "dmy", "2023-03-13"),
        ("Mar 10, 2024 9:05 AM EDT", "America/New_York", "mdy", "2024-03-10T13:05:00.000000Z"),
        ("2024-10-25 02:02:07 UTC+3", "UTC", "dmy", "2024-10-24T23:02:07.000000Z"),
        ("2025-10-26T02:04", "Europe/Berlin", "dmy", "2025-10-26T00:04:00.000000Z"),
        ("1737036413155", "Asia/Shanghai", "ymd", "2025-01-16T14:06:53.155000Z"),
        ("20250622222209", "Asia/Shanghai", "ymd", "2025-06-22T14:22:09.000000Z"),
        ("FY 2027", "UTC", "dmy", "2027"),
        ("T1 2028", "UTC", "dmy", "2028-Q1"),
        ("2027年第四季度", "UTC", "dmy", "2027-Q4"),
        ("09/2030", "UTC", "mdy", "2030-09"),
        ("Nov-27", "UTC", "dmy", "2027-11"),
        ("２０２６年", "UTC", "dmy", "2026"),
    ],
)
def test_interpretations(value, zone, order, expected):
    assert min(ts.interpretations(value, zone, order), key=lambda c: c[3])[2] == expected


@pytest.mark.parametrize("value", [None, "", "-", "TBD", "Invalid Date", "2024-13-05 10:00", "2025-02-30", "0000-00-00 00:00:00", "x" * 5000])
def test_invalid_values(value):
    assert ts.interpretations(value, "UTC", "dmy") == []


def _random_candidates(rnd, n):
    texts = lambda: rnd.choice([f"{rnd.randrange(1, 29):02d}/{rnd.randrange(1, 13):02d}/2024", f"2024-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}", f"{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 13):02d}-2024 10:00", f"{rnd.randrange(10, 29)}/13/2024"])
    return [c for c in (ts.interpretations(texts(), "UTC", rnd.choice([None, None, "dmy", "mdy"])) for _ in range(n)) if c]


def _cost(path):
    return sum(c[3] for c in path) + sum(ts._step(a, b) for a, b in itertools.pairwise(path))


def test_viterbi_matches_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        candidates = _random_candidates(rnd, 8)
        path, got = ts.Viterbi(), []
        for i, c in enumerate(candidates):
            got += path.push(i, c)
        got += path.end()
        assert [k for k, _ in got] == list(range(len(candidates)))
        assert _cost([c for _, c in got]) == min(map(_cost, itertools.product(*candidates)), default=0)


def test_borders_do_not_change_the_cheapest_path():
    """A chain cut anywhere, each piece decided with the composed costs of the others, is as cheap as the whole."""
    rnd = random.Random(9)
    for _ in range(40):
        candidates = _random_candidates(rnd, 30)
        whole, path = [], ts.Viterbi()
        for i, c in enumerate(candidates):
            whole += path.push(i, c)
        whole += path.end()
        cuts = sorted({0, len(candidates), *(rnd.randrange(len(candidates) + 1) for _ in range(4))})
        pieces = [candidates[a:b] for a, b in itertools.pairwise(cuts)]
        rows = []
        for part, piece in enumerate(pieces):
            segment = ts.Segment(piece[0])
            for c in piece[1:]:
                segment.push(c)
            ends = lambda cs: [[c[0], c[1]] for c in cs]
            rows.append((part, 0, 5, json.dumps([ends(segment.first), ends(segment.last), segment.matrix()])))
        borders, got = ts.compose(rows), []
        for part, piece in enumerate(pieces):
            mine = borders.get(part, {})
            path = ts.Viterbi(mine.get("before", (5, None))[1])
            for c in piece:
                got += path.push(None, c)
            got += path.end(mine.get("behind", (5, None))[1])
        assert _cost([c for _, c in got]) == _cost([c for _, c in whole])


def test_order_is_declared_or_follows_from_the_sequence(spark):
    # 02/03 then 04/03 ... in a source without a declared order: the days run on only when read day first.
    rows = [(i, f"{1 + i:02d}/03/2024" if i < 28 else f"{i - 27:02d}/04/2024", s, f"2024-{i:03d}") for s in ("none", "mdy", "dmy") for i in range(40)]
    values = ts.time_values(spark.createDataFrame(rows, "k long, v string, s string, t string"), "t", "k", ["v"], "s", "t").withColumn("o", F.when(F.col("_source") != "none", F.col("_source")))
    results = []
    for partitions in (1, 4, 40):
        got = ts.normalise_times(values.withColumn("row_key", F.col("row_key") + F.when(F.col("o") == "mdy", 1000).when(F.col("o") == "dmy", 2000).otherwise(0)), F.lit("UTC"), F.col("o"), partitions).collect()
        results.append({r.row_key: r.normalised for r in got})
    assert results[0] == results[1] == results[2]
    assert results[0][4] == "2024-03-05" and results[0][11] == "2024-03-12" and results[0][30] == "2024-04-03"
    assert results[0][1004] == "2024-05-03" and 1020 not in results[0]  # month 21 isn't valid as declared
    assert results[0][2004] == "2024-03-05"


def test_found(spark):
    docs = spark.createDataFrame([(1, "10/01/2024 01:46", "s1", "2024-01-01"), (2, None, "s1", "2024-01-01"), (3, "unknown", None, None), (4, "2024-05-01", None, None)], "doc_id long, published_at string, source_id string, fetched_at string")
    feed = spark.createDataFrame([(7, "1751073905", "in 2030", "s1", "2024-01-01"), (7, "1751073905", "in 2030", "s1", "2024-01-01")], "record_id long, recorded_at string, cod_date string, source_id string, ingested_at string")
    arts = spark.createDataFrame([(5, "2024-04-21T04:25", "a", "2024-01-01")], "article_id long, published_at string, account_id string, fetched_at string")
    src = spark.createDataFrame([("s1", "Europe/Paris", "dmy")], "source_id string, time_zone string, date_order string")
    got = sorted((r.table_name, r.row_key, r.field, r.normalised) for r in ts.found(docs, arts, feed, src).collect())
    assert got == [("dajiala_article", 5, "published_at", "2024-04-20T20:25:00.000000Z"), ("documents", 1, "published_at", "2024-01-10T00:46:00.000000Z"), ("documents", 4, "published_at", "2024-05-01")] + [("project_intel", 7, "cod_date", "2030")] * 2 + [("project_intel", 7, "recorded_at", "2025-06-28T01:25:05.000000Z")] * 2
    assert ts.found(docs.limit(0), arts.limit(0), feed.limit(0), src).count() == 0
