import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampora.llm import boilerplate, language, leakage, packing, repeats, residue

ARTICLE = "The plant will serve homes and displace carbon dioxide every year for the whole region, officials in the town said on Monday. "


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A {{ name }} plant.", "placeholder"),
        ("Power in [INSERT place] grows.", "placeholder"),
        ("undefined MW plant", "placeholder"),
        ("Signed by 【owner】请填写 today", "placeholder"),
        ("The set {A, B, C} of feeders", None),
        ("Write `{{ name }}` in the file.", None),
        ("```\n{{ name }}\n```\nA guide.", None),
        ("In the template syntax of this engine, {{ name }} stands for the name of a project, as this long tutorial line explains.", None),
        ("Home\nPlease enable JavaScript in your browser to read this page.\n© 2025", "message"),
        ("加载中……", "message"),
        ("xxx xxx xxx Texto de ejemplo. Sustituir.", "message"),
        ("The tender portal returned error 404 for two days, which bidders quoted.", None),
        # Sentences that no list holds: nearly all their words are those of messages.
        ("Sorry, the file you requested has expired. Please try again later.", "message"),
        ("502 Bad gateway: the upstream server is unavailable", "message"),
        ("Bitte warten Sie, der Inhalt wird geladen.", "message"),
        ("系统升级，请稍后重新登录", "message"),
        ("Log in\nContact\nHome", None),
        ("This site uses cookies. Accept | Reject | Settings", None),
        ("Das Vergabeportal meldete zwei Tage lang den Fehler 503, beklagen Bieter.", None),
        ("Loading…\n" + "\n".join([ARTICLE] * 5), None),
        ("", None),
        (None, None),
        ("a" * 300_000, None),
    ],
)
def test_residue(spark, text, expected):
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert residue.residue(df).first()["residue"] == expected


def test_repeats_against_brute_force(spark):
    rnd = random.Random(3)
    lines = ["All rights reserved 2025", "ALL RIGHTS  RESERVED!", "Read more about wind and solar power in the northern provinces of the country", "12 34", ""] + [f"sentence {chr(97 + i)} {chr(98 + i)} alone" for i in range(20)]
    rows = []
    for i in range(120):
        rows.append((i, "hot" if i % 3 else rnd.choice(["a", "b", None]), None if i % 17 == 0 else "\n".join(rnd.choice(lines) for _ in range(6))))
    got = {tuple(r) for r in repeats.repeated_lines(spark.createDataFrame(rows, "doc_id long, source_id string, text string")).collect()}
    key = lambda x: repeats.letters(x)[0]
    want = set()
    for s in {r[1] for r in rows}:
        own = [(d, t.split("\n")) for d, x, t in rows if x == s and t is not None]
        for d, ls in own:
            for n, x in enumerate(ls, 1):
                c = sum(any(key(y) == key(x) for y in other) for _, other in own)
                if key(x) and c >= 3 and c >= 0.05 * len(own):
                    want.add((d, n))
    assert got == want
    assert repeats.repeated_lines(spark.createDataFrame([], "doc_id long, source_id string, text string")).count() == 0


def test_chunks_do_not_depend_on_lines_or_neighbours():
    long = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee for tired travellers and their horses"
    chunks = lambda text: repeats.cut(repeats.letters(text), np.array([0]))[3].tolist()
    whole = chunks(f"some words before {long} and some behind")
    assert chunks(f"some words before {long} and some behind".replace(" ", "\n")) == whole
    inner = set(chunks(long)[1:-1])
    assert inner and inner <= set(whole)


def test_repeated_chunks_count_across_line_ends(spark):
    notice = "This passage about the rights of readers stands in all documents of the source, and each document breaks its lines elsewhere for no reason at all."
    words = notice.split()
    rows = [(i, "s", f"own {i}\n" + " ".join(words[: i + 2]) + "\n" + " ".join(words[i + 2 :]), "x") for i in range(8)]
    lines = repeats.cut_documents(spark.createDataFrame(rows, "doc_id long, source_id string, text string, line string"))
    assert {r["documents"] for r in repeats.repeated_chunks(lines).collect()} == {8}
    assert repeats.repeated_lines(spark.createDataFrame(rows, "doc_id long, source_id string, text string, line string")).count() == 8  # "own"


ITEM = "During the night shift two apprentices of the harbour office photographed the eastern ridge beside the old mill because the lender had serious doubts about every invoice that travelled by mule last winter"


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (ARTICLE + ITEM + " End.", True),
        (ARTICLE + ITEM.upper().replace(" ", "  \n") + ARTICLE, True),
        (" ".join(ITEM.split()[:18]), True),
        (" ".join(ITEM.split()[:12]), False),
        (" ".join(w if i != 9 else "zebra" for i, w in enumerate(ITEM.split())), True),
        (" ".join(w if i % 5 else "zebra" for i, w in enumerate(ITEM.split())), False),
        (ARTICLE * 50, False),
        ("", False),
        (None, False),
    ],
)
def test_leakage(spark, text, hit):
    docs = spark.createDataFrame([(5, text, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    assert [tuple(r) for r in leakage.found(docs, items).collect()] == ([(1, 5)] if hit else [])


def _brute(doc: str, item: str) -> bool:
    """Independent search: every diagonal, every pair of ends, words replaced at most one in twenty (one always)."""
    t, x = leakage.tokens(doc), leakage.tokens(item)
    for shift in range(-len(x), len(t)):
        equal = [0 <= i + shift < len(t) and t[i + shift] == w for i, w in enumerate(x)]
        for a in range(len(x)):
            wrong = 0
            for b in range(a, len(x)):
                wrong += not equal[b]
                n = b - a + 1
                if equal[a] and equal[b] and n * 2 >= len(x) and wrong <= max(1, n / 20):
                    return True
    return False


def test_leakage_against_brute_force():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 60)))) for k in range(60)]
    docs, want = [], set()
    for d in range(200):
        k, t = rnd.choice(items)
        own = t.split()
        n = min(len(own), max(1, round(len(own) * rnd.choice([0.4, 0.5, 0.6]))))
        a = rnd.randrange(len(own) - n + 1)
        part = own[a : a + n]
        part[rnd.randrange(n)] = "zebra"
        docs.append(" ".join([*rnd.choices(words, k=20), *part, *rnd.choices(words, k=20)]))
        want |= {(d, j) for j, x in items if _brute(docs[-1], x)}
    got = {(d, k) for d, k, _ in leakage.Index(items).matches(docs)}
    assert got <= want and len(got & want) / len(want) >= 0.99


@pytest.mark.parametrize("place", range(20))
def test_leaked_half_with_a_word_replaced_anywhere(place):
    item = [f"v{i}" for i in range(40)]
    part = item[10:31]  # 20 of 40 remain a match where the replaced word is the first or last
    part[place] = "zebra"
    text = " ".join(["a", *part, "b"])
    assert [(d, k) for d, k, _ in leakage.Index([(7, " ".join(item))]).matches([text])] == [(0, 7)]


def test_leakage_survives_repetitive_text_and_finds_shifted_words_with_indels():
    item = "x " * 60
    assert [k for _, k, _ in leakage.Index([(1, item)]).matches(["x " * 20_000])] == [1]
    a = list(range(1, 41))
    doc = [0, *a[:10], 99, *a[10:20], 0]
    assert leakage.longest_match(doc, a, [(1, 0)]) == 10
    assert leakage.longest_match(doc, a, [(1, 0)], indels=True) == 20


def test_items_are_searched_in_blocks(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, ARTICLE)], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate([ITEM, "some other words of no document at all here", ITEM])], "item_id long, text string")
    assert {(r[0], r[1]) for r in leakage.leaked(docs, items, block=1).collect()} == {(0, 1), (2, 1)}


SAMPLES = [("en", "The battery section will store power and connect to the line near the coast. Local residents welcomed the plan."), ("es", "La planta dará servicio a unos hogares y ahorrará dióxido de carbono al año. Los vecinos recibieron bien el plan."), ("de", "Die Anlage versorgt rund tausend Haushalte und spart jährlich Kohlendioxid. Die Gewerkschaften bezweifelten den Plan."), ("zh", "根据购电协议，公司将在三年内出售全部电量，由当地配电企业统一收购。现场目前有施工队伍。")]


def test_language_model_and_documents(spark):
    model = language.Model(SAMPLES)
    assert [x[0] for x in model.classify([t for _, t in SAMPLES])] == [k for k, _ in SAMPLES]
    assert model.classify(["", "12345"])[0][0] is None
    assert language.Model([]).classify(["some text"]) == [(None, 0.0)]
    text = "\n".join(["Headline", SAMPLES[0][1], SAMPLES[0][1], SAMPLES[2][1], "© 2025. All rights of the site are reserved by us."])
    docs = spark.createDataFrame([(1, text, "Headline", "de-DE", [5], 9), (2, text, None, "EN_gb", [5], 9), (3, None, None, None, None, 9), (4, "", "", "", [], 9)], "doc_id long, text string, title string, lang string, furniture array<int>, line_no int")
    assert {tuple(r) for r in language.found(docs, model).collect()} == {(1, 0, "en"), (1, 4, "de"), (2, 4, "de")}


@pytest.mark.parametrize(("label", "lang"), [("zh-Hans", "zh"), ("POR", "pt"), ("xx", None), ("", None), (None, None), ("und", None), ("de_AT", "de")])
def test_labels(label, lang):
    assert language.label(label) == lang


def page(i, extra=""):
    return f"<html><head><title>t{i}</title></head><body><ul><p>Site uses cookies</p><p>Home</p><p>Contact</p></ul><section><h1>Story number {'abcdefghij'[i]}</h1><p>By Ann Lee</p><p>{ARTICLE} {'abcdefghij'[i]}</p>{extra}<p>Share this</p></section><div><p>Most read</p><p>Other {'abcdefghij'[i]} story</p><p>Imprint</p></div></body></html>"


def test_boilerplate(spark):
    photo = lambda i: f"<p>Photo: crews near {'abcdefghij'[i] * 4} at work</p><p>Owner: {'abcdefghij'[i] * 5} Power</p><p>The owner is {'abcdefghij'[i] * 5} Power of the north.</p>"
    pages = spark.createDataFrame([(f"p{i}", f"https://a.example/{i}", page(i, photo(i))) for i in range(6)] + [("n", None, None), ("m", "https://b.example/", "<p>broken <b>mark-up")], "raw_path string, url string, html string")
    text = "Site uses cookies\nHome\nStory z\nBy Ann Lee\n\n" + ARTICLE + "\nPhoto: crews at work\nShare this »\nMOST READ\nOther q story\nImprint"
    docs = spark.createDataFrame([(1, "https://a.example/9", "Story z", text, "x"), (2, "https://a.example/8", None, text, "x"), (3, "https://unknown.example/", "Story z", text, "x"), (4, "https://a.example/7", "t", None, "x"), (5, None, None, "", "x")], "doc_id long, url string, title string, text string, host string")
    got = {r["doc_id"]: r["furniture"] for r in boilerplate.furniture_lines(docs, pages).collect()}
    # The caption's beginning is induced as a slot; the owner's isn't, since the articles tell their owner as well.
    assert got[1] == got[2] == [1, 2, 7, 8, 9, 10, 11]
    assert got[3] == [1, 2]  # no template: what stands before the headline
    facts = docs.where("doc_id = 1").withColumn("text", F.lit("Story z\nOwner: Zed Power\n" + ARTICLE + "\nPhoto: someone else"))
    assert boilerplate.furniture_lines(facts, pages).first()["furniture"] == [4]
    assert got[4] is None and got[5] == []
    main = {r["doc_id"]: r["main_text"] for r in boilerplate.main_text(docs, pages).collect()}
    assert main[1] == "Story z\nBy Ann Lee\n\n" + ARTICLE


def test_regions_without_level_one_headings_come_from_the_alignment(spark):
    plain = [page(i).replace("h1>", "p>") for i in range(6)]
    pages = spark.createDataFrame([(f"p{i}", f"https://c.example/{i}", x) for i, x in enumerate(plain)], "raw_path string, url string, html string")
    constants = {r["key"]: r["region"] for r in boilerplate.templates(pages).first()["constants"]}
    assert constants == {"siteusescookies": 0, "home": 0, "contact": 0, "sharethis": 1, "mostread": 2, "imprint": 2}
    text = "Home\nStory z\nBy Ann Lee\n" + ARTICLE + "\nShare this\nMost read\nOther q story\nImprint"
    docs = spark.createDataFrame([(1, "https://c.example/9", "Story z", text)], "doc_id long, url string, title string, text string")
    assert boilerplate.furniture_lines(docs, pages).first()["furniture"] == [1, 5, 6, 7, 8]


def test_pages_with_a_long_common_beginning_are_articles_of_their_own(spark):
    menu = "".join(f"<p>Section {w} of this site with news and views</p>" for w in ("wind", "solar", "grid", "storage", "hydrogen", "policy", "markets", "people", "regions", "tenders", "finance", "weather"))
    plain = [page(i).replace("h1>", "p>").replace("<p>Home</p>", menu) for i in range(6)]
    pages = spark.createDataFrame([(f"p{i}", f"https://d.example/{i}", x) for i, x in enumerate(plain)], "raw_path string, url string, html string")
    constants = {r["key"]: r["region"] for r in boilerplate.templates(pages).first()["constants"]}
    assert constants["contact"] == 0 and constants["imprint"] == 2 and len(constants) == 17


@pytest.mark.parametrize("html", ["<p>" * 1500 + "x", "<div>" * 5000 + "<p>deep</p>", "<ul>" + "<li>a" * 3000, "<table>" + "<tr><td>a<td>b" * 500, "<<<>>>&#x110000;</p></p>", ""])
def test_odd_mark_up_is_read(html):
    page_ = boilerplate.parse(html)
    assert sum(1 for _ in boilerplate.walk(page_)) <= 6100
    boilerplate.tree_match(page_, page_)
    boilerplate.grow([page_, boilerplate.parse(page(0))])


def test_implied_end_tags():
    page_ = boilerplate.parse("<body><ul><li>one<li>two</ul><p>three<p>four<div>five</div></body>")
    assert [(c.tag, len(c.children)) for c in page_.children] == [("ul", 2), ("p", 0), ("p", 0), ("div", 0)]


def test_one_odd_page_does_not_stop_a_host(spark):
    rows = [(f"p{i}", f"https://e.example/{i}", page(i)) for i in range(6)] + [("q", "https://e.example/q", "<p>" * 1500 + "x" + "<div>" * 3000)]
    made = boilerplate.templates(spark.createDataFrame(rows, "raw_path string, url string, html string")).first()
    assert "imprint" in {r["key"] for r in made["constants"]}


def test_hosts_with_alike_templates_keep_their_own(spark):
    rows = [(f"{h}{i}", f"https://{h}.example/{i}", page(i).replace("Most read", w)) for h, w in (("f", "Most liked"), ("g", "Most loved")) for i in range(6)]
    pages = spark.createDataFrame(rows, "raw_path string, url string, html string")
    docs = spark.createDataFrame([(k, f"https://{h}.example/9", "Story z", f"Home\nStory z\n{ARTICLE}\n{w}\nx") for k, (h, w) in enumerate((("f", "Most liked"), ("g", "Most loved")))], "doc_id long, url string, title string, text string").coalesce(1)
    assert [r["furniture"] for r in boilerplate.furniture_lines(docs, pages).orderBy("doc_id").collect()] == [[1, 4, 5], [1, 4, 5]]


def test_model_grows_by_what_aligns_with_nothing():
    long, extra = boilerplate.parse(page(0)), boilerplate.parse(page(1, "<p>Advert</p>").replace("<p>Contact</p>", ""))
    keys = [k for k, _ in boilerplate.leaves(boilerplate.grow([long, extra]))]
    assert "contact" in keys and "advert" in keys and keys.count("home") == 1


def test_tree_match():
    a, b = boilerplate.parse(page(0)), boilerplate.parse(page(1))
    same, other = boilerplate.tree_match(a, a), boilerplate.tree_match(a, b)
    assert same > other > 10
    assert boilerplate.tree_match(a, boilerplate.parse("<div></div>")) < other


def test_pack_limits_and_round_trip(spark, monkeypatch):
    rng = np.random.default_rng(2)
    demand = np.stack([rng.integers(1, 90, 500), np.ones(500), rng.integers(0, 60, 500)], axis=1).astype(float)
    where = packing.pack(demand, np.array([100.0, 6, 80]))
    sums = np.stack([np.bincount(where, demand[:, k]) for k in range(3)], axis=1)
    assert (where >= 0).all() and (sums <= [100, 6, 80]).all()
    lower = np.ceil((demand.sum(axis=0) / [100, 6, 80]).max())
    assert len(sums) <= 1.25 * lower + 2

    # Each of the three limits alone stops a container.
    for k, one in enumerate(([60, 1, 1], [1, 1, 1], [1, 1, 50])):
        n = [2, 7, 2][k]
        where = packing.pack(np.array([one] * n, dtype=float), np.array([100.0, 6, 80]))
        assert sorted(np.bincount(where)) == [1, n - 1]
    assert packing.limits_of(512).tolist() == [512, 4, 512 * 0.98]

    class Words:
        def encode_ordinary(self, t):
            return t.split()

    monkeypatch.setattr(packing, "encoding", lambda path: Words())
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 70, 80)] + ["w " * 205, None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    monkeypatch.setattr(packing, "token_counts", lambda d, t=None: spark.createDataFrame([(i, len(x.split()), len(x.split())) for i, x in enumerate(texts) if x is not None], "doc_id long, tokens long, loss long"))
    specs = spark.createDataFrame([(1, 100), (2, 64), (3, None)], "spec_id int, capacity_tokens int")
    placed = packing.containers(docs, specs).toPandas()
    for spec, capacity in ((1, 100), (2, 64)):
        own = placed[placed.spec_id == spec]
        assert own.groupby("container_id").tokens.sum().max() <= capacity
        assert own.groupby("doc_id").tokens.sum().to_dict() == {i: len(x.split()) for i, x in enumerate(texts) if x is not None}
        assert (own.groupby("doc_id").size()[own.groupby("doc_id").tokens.sum() <= capacity] == 1).all()
    assert packing.containers(docs, specs.limit(0)).count() == 0
