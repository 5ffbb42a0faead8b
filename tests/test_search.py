import random

import pyarrow as pa

from ampora.operators import search
from ampora.plans import audit, relations


def test_search_finds_what_a_plain_search_finds(monkeypatch):
    rnd = random.Random(1)
    for step in (7, 64, search.STEP):
        monkeypatch.setattr(search, "STEP", step)
        for letters in ("ab", "a哈登bé "):
            text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
            docs = [text(rnd.randrange(60)) for _ in range(30)] + [None, ""]
            texts = list({text(rnd.choice((1, 2, 3, 4, 7, 8, 9, 16, 17, 33))) for _ in range(60)} | {docs[0][:35] or "x"})
            doc, found = search.Search(texts).find(*search.buffers(pa.array(["b", *docs])[1:]))
            assert list(zip(doc.tolist(), found.tolist())) == [(i, j) for i, d in enumerate(docs) for j, t in enumerate(texts) if t in (d or "")]
    assert len(search.Search([]).find(*search.buffers(pa.array(["a"])))[0]) == 0


def test_best_references_as_by_every_pair(spark):
    rnd = random.Random(2)
    pick = lambda *x: rnd.choice(x)
    words = ("nord", "tal", "哈登", "x", "solar park", "ßa", "a b", "")
    refs = [(i, " ".join(pick(*words) for _ in range(rnd.randrange(5))), pick("spain", "中国", ""), pick("hafen 1", ""), pick("olvik grid", "o", ""), pick("a.example", "b.example", "", None)) for i in range(60)]
    docs = [(i, pick("https://www.a.example/x", "http://b.example", "ftp://c", None), pick(None, "Nord TAL", "Spain"), pick(None, "", " ".join(pick("Nord", "tal", "哈登", "Solar Park", "SPAIN", "中国", "hafen 1", "olvik g", "a", "b") for _ in range(12)))) for i in rnd.sample(range(500), 300)]
    r = spark.createDataFrame(refs, "row_id long, name string, country string, address string, owner string, host string")
    d = spark.createDataFrame(docs, "doc_id long, url string, title string, text string").repartition(5)
    host_of = {"https://www.a.example/x": "a.example", "http://b.example": "b.example", "ftp://c": "", None: None}
    want = set()
    for i, name, country, address, owner, host in refs:
        tokens, scored = {t for t in name.split() if len(t) >= 2}, []
        for k, url, title, text in docs:
            w = f"{title or ''}\n{text or ''}".lower()
            named = bool(tokens) and sum(t in w for t in tokens) / len(tokens) >= 0.45
            points = 20 * named + 15 * bool((country and country in w) or (address and address in w)) + 15 * bool(owner and owner[:6] in w) + 5 * (host is not None and host == host_of[url])
            scored += [(-points, k)] if points > 20 else []
        want |= {(i, k, -p, place) for place, (p, k) in enumerate(sorted(scored)[:5], 1)}
    assert want
    for block in (10, relations.REFERENCES):
        got = relations.best_references(r, d, block=block)
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
        # No pair of a reference and a document is a row.
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_verified_hints_reads_each_document_once(spark, tmp_path, monkeypatch):
    rows = [(1, "approved", "s", '{"project_name": "Nord Tal"}'), (2, "auto_approved", "s", '{"project_name": " NORD TAL "}'), (3, "approved", "t", '{"project_name": "Nord Tal"}'), (4, "approved", "s", '{"project_name": "Tal"}'), (5, "rejected", "s", '{"project_name": "Nord"}'), (6, "approved", None, '{"project_name": "Nord Tal"}'), (7, "approved", "s", '{"project_name": "哈登电站2号"}'), (8, "approved", "s", "{}")]
    docs = [(1, "s", "nord", "tal"), (2, "s", None, "the NORD TAL site"), (3, "s", "哈登电站2号", "Nord Tal, nord tal"), (4, "t", "x", None), (5, None, "Nord Tal", "")]
    spark.createDataFrame(rows, "row_id long, status string, source_id string, fields_json string").write.parquet(str(tmp_path / "projects.parquet"))
    spark.createDataFrame(docs, "doc_id long, source_id string, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for block in (1, search.NAME_BLOCK):
        monkeypatch.setattr(search, "NAME_BLOCK", block)
        got = audit.queries()["verified_hints"](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == [(1, 2, 2), (2, 2, 2), (7, 1, 3)]
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
