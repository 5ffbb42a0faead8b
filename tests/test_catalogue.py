import os

import duckdb
import pytest

from ampora.plans import audit, catalogue, classify, entities, outputs, pages, relations, texts

SQL = {name: (m, sql) for m in (catalogue, texts, classify, relations, pages, entities, outputs, audit) for name, sql in m.oracle_sql().items()}

DATA = "/root/testdata/sf0.001"
TABLES = "sources scans project_intel dajiala_article projects page_capture documents eval_items lang_samples container_specs region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    module, sql = SQL[name]
    df = module.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    answer = duck.execute(sql)
    place = [[c[0] for c in answer.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in answer.fetchall())


def test_stated_quantities_reads_whole_amounts(spark, tmp_path):
    import duckdb as d

    texts = ["1,200 MW and 1.5 MW", "5MW10GW", "2.5 million kWh, 3 MWh", "50万千瓦 与 12 兆瓦时", "7 MWp, 1.2.3 MW, 0 MW", "4 mw", None, "no amount"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in catalogue.queries()["stated_quantities"](spark, str(tmp_path)).collect()}
    want = {0: (1201.5, None, 2), 1: (10005.0, None, 2), 2: (None, 2503.0, 2), 3: (500.0, 12.0, 2), 4: (None, None, 0), 5: (4.0, None, 1), 7: (None, None, 0)}
    assert got == want
    con = d.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.execute(catalogue.oracle_sql()["stated_quantities"]).fetchall()} == want
