import itertools

import pytest

from ampora.llm import names

VARIANTS = [
    ["Lanmar Halqui Solar Development Corporation", "Lanmar Halqui SDC", "Solar Development (Lanmar Halqui) Corp.", "lanmar halqui solar dev.", "Lanmarhalqui Solar Development", "Halqui, Lanmar Solar Development", "Lanmar Halqiu Solar Development"],
    ["Antonia Bexzan Kasnil", "Dr. Antonia Bexzan Kasnil", "Toñi Bexzan Kasnil", "BEXZAN KASNIL, A.", "Eng. A. Bexzan Kasnil", "Kasnil, Toñi Bexzan"],
    ["澜川岳电力建设股份有限公司", "澜川岳电建", "（澜川岳）电力建设", "瀾川嶽電力建设 股份有限公司"],
    ["Lanmar Halqui Grid Construction Corporation"],
    ["澜川岳新能源有限公司"],
]


@pytest.mark.parametrize("group", VARIANTS)
def test_variants_are_alike(group):
    folded = [names.fold(n) for n in group]
    assert all(a == folded[0] or names.same_party(a, folded[0])[0] > 0 for a in folded)


@pytest.mark.parametrize(("a", "b"), [("Foltol Yenwil Power", "Foltol Yenwil Utilities"), ("Foltol Yenwil Power", "Foltol Yenwil"), ("澜川岳电建", "澜川岳新能源"), ("A. Bexzan Kasnil", "Eduardo Bexzan Kasnil"), ("Lanmar Halqui Solar Development", "Lanmar Halqui GCI")])
def test_other_parties_are_not(a, b):
    assert names.same_party(names.fold(a), names.fold(b))[0] == 0


def test_collision_curve():
    b = names.bands_for(0.4, 2, 0.995)
    assert 1 - (1 - 0.4**2) ** b >= 0.995 > 1 - (1 - 0.4**2) ** (b - 1)


def test_parties_against_brute_force(spark):
    rows = [(n, "x" * k) for k, n in enumerate(itertools.chain(*VARIANTS))] * 2 + [(None, "a"), ("", "b"), ("  ", "c")]
    got = names.parties(spark.createDataFrame(rows, "name string, party string")).collect()
    by = {r["name"]: r["party"] for r in got}
    assert len(got) == sum(map(len, VARIANTS))
    for a, b in itertools.combinations(VARIANTS, 2):
        assert not {by[n] for n in a} & {by[n] for n in b}
    for group in VARIANTS:
        assert len({by[n] for n in group}) == 1


def test_two_established_brands_stay_apart(spark):
    forms = ["Casyor Tolfen Power", "Tolfen Casyor Power", "Casyor Tolfen Pwr", "Power (Casyor Tolfen)", "Casyor Tolfen PL"]
    rows = forms + [x.replace("Casyor", "Kasyor") for x in forms]
    by = {r["name"]: r["party"] for r in names.parties(spark.createDataFrame([(n,) for n in rows], "name string")).collect()}
    assert len({by[n] for n in forms}) == 1 and len(set(by.values())) == 2
    slip = {r["name"]: r["party"] for r in names.parties(spark.createDataFrame([(n,) for n in forms + ["Kasyor Tolfen Power"]], "name string")).collect()}
    assert len(set(slip.values())) == 1


def test_hot_keys_meet_in_blocks(spark):
    """A key of many nodes gives every pair, once, without a group of the whole key."""
    keys = spark.createDataFrame([(i, 1) for i in range(200)] + [(i, 2) for i in range(3)] + [(900, 3)], "node long, key long")
    got = [tuple(r) for r in names.candidates(keys).collect()]
    assert len(got) == len(set(got)) == 200 * 199 // 2 and all(a < b for a, b in got)


def test_stars_run_to_the_end(spark):
    """A chain of falling rank needs a round per two nodes; none is left out."""
    n = 24
    nodes = spark.createDataFrame([(i, n - i) for i in range(n)], "node long, weight long")
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)] + [(i + 1, i, 1.0) for i in range(n - 1)], "a long, b long, similarity double")
    got = {r["node"]: r["center"] for r in names.star_clusters(nodes, links).collect()}
    assert sorted(got) == list(range(n)) and all(got[i] == i - i % 2 for i in range(n))


def test_a_slip_in_two_spellings_is_still_linked(spark):
    forms = ["", " Ltd", " Limited", " Inc", " Corp", " JSC", " GmbH", " PLC", " LLC", " Group"]
    rows = [f"Firrud Munttol Energy Holdings{x}" for x in forms[:2]] + [f"Firrud Muntol Energy Holdings{x}" for x in forms]
    got = names.parties(spark.createDataFrame([(n,) for n in rows], "name string")).collect()
    assert len(got) == 12 and len({r["party"] for r in got}) == 1


def test_found_empty(spark):
    assert names.found(spark.createDataFrame([], "developer string, owner string, epc_contractor string")).count() == 0
