from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ampora.operators import units
from ampora.operators.unit_graph import UnitGraph, edge


def test_affine_composition_and_inverse():
    g = UnitGraph([edge("c", "k", 1, "273.15"), edge("f", "c", Fraction(5, 9), Fraction(-160, 9))])
    g.check_cycles(["k"])
    rows = {u: (a, b) for u, _, a, b, _ in g.compositions(["k"])}
    a, b = rows["f"]
    assert a * 212 + b == Fraction("373.15")


def test_inconsistent_cycle_and_two_targets_are_errors():
    with pytest.raises(ValueError):
        UnitGraph([edge("a", "b", 2), edge("b", "c", 3), edge("a", "c", 7)]).check_cycles(["a"])
    with pytest.raises(ValueError):
        UnitGraph([edge("a", "b", 2)]).compositions(["a", "b"])


@pytest.mark.parametrize(
    ("text", "value"),
    [("1,102", "1102"), ("0,044", "0.044"), ("1,02", "1.02"), ("1.383", "1.383"), ("1.039,1", "1039.1"), ("1,331.1", "1331.1"), ("1,974,100,000", "1974100000"), ("7", "7")],
)
def test_numbers(text, value):
    assert units.read_number(text) == Decimal(value)


@pytest.mark.parametrize(
    ("text", "kind", "expected"),
    [
        ("光伏186MWp + BESS 154,000  kW，154mwh", "power", [("186", "mw"), ("154000", "kw"), ("154", "mwh")]),
        ("400 kV / 285 km", "power", []),
        ("3 x 24 Mw", "power", [("72", "mw")]),
        ("8.5  万千瓦时", "power", [("8.5", "wankwh")]),
        ("５,８７０  MW h", "power", [("5870", "mwh")]),
        ("TBD", "power", []),
        ("$1.474,2m", "money", [("1474.2", "1000000 USD")]),
        ("2.015亿元", "money", [("2.015", "100000000 CNY")]),
        ("1.568 Mrd. EUR", "money", [("1.568", "1000000000 EUR")]),
        ("101,1 MUSD", "money", [("101.1", "1000000 USD")]),
        ("Rs 17,19 crore", "money", [("17.19", "10000000 INR")]),
        ("55.1", "money", [("55.1", None)]),
    ],
)
def test_amounts(text, kind, expected):
    assert [(str(n), u) for n, u in units.find_amounts(text, kind)] == expected


def test_stated_units_need_a_sentence_without_digits():
    assert units.stated_units("投资额以万元人民币计。 Angabe der Leistung in Megawatt.") == ("mw", "10000 CNY")
    assert units.stated_units("The 419 MW plant got under way.") == (None, None)
    assert units.stated_units(None) == (None, None)


def test_found(spark):
    feed = spark.createDataFrame(
        [(1, "s1", "10,000", None, "Listed in kilowatts."), (2, "s2", "5", "12", None), (3, "s3", "5", "12", None), (4, None, "2 x 3 MW; 1 MWh", "US$ 0.5 bn", None), (4, None, "2 x 3 MW; 1 MWh", "US$ 0.5 bn", None), (5, "s1", None, "-", "")],
        "record_id long, source_id string, capacity string, investment string, content string",
    ).withColumnRenamed("content", "content")
    sources = spark.createDataFrame([("s1", None), ("s2", "Leistung in GW. Investition in Mio. EUR."), ("s2", "Leistung in GW. Investition in Mio. EUR."), ("s3", "News.")], "source_id string, coverage string")
    projects = spark.createDataFrame([(9, '{"pv_capacity_mw":4.2,"storage_capacity_mwh":"78  megawatt-hours","storage_power_mw":"?"}'), (10, None), (11, "not json")], "row_id long, fields_json string")
    got = {(r.table_name[:8], r.row_key, r.unit, r.value) for r in units.found(spark, feed, sources, projects).collect()}
    assert got == {("project_", 1, "kW", 10000), ("project_", 2, "kW", 5000000), ("project_", 2, "EUR", 12000000), ("project_", 4, "kW", 6000), ("project_", 4, "kWh", 1000), ("project_", 4, "USD", 500000000), ("projects", 9, "kW", 4200), ("projects", 9, "kWh", 78000)}
    assert units.found(spark, feed.limit(0), sources, projects.limit(0)).count() == 0


def test_amounts_of_any_size_and_long_sentences(spark):
    """Nothing aborts or vanishes: what exceeds BIGINT has a null value, small fractions and long sentences count."""
    rows = [("99999999999999999 TW",), ("200000000000000000 W",), ("1" * 60 + " MW",), (None,), ("",)]
    values = spark.createDataFrame(rows, "t string")
    got = {r["t"]: r["value"] for r in units.normalise_amounts(values, "t", "power", F.lit(None).cast("string")).collect()}
    assert got == {"99999999999999999 TW": None, "200000000000000000 W": 200_000_000_000_000, "1" * 60 + " MW": None}
    money = spark.createDataFrame([("USD 0.0000004 bn",)], "t string")
    assert [r["value"] for r in units.normalise_amounts(money, "t", "money", F.lit(None).cast("string")).collect()] == [400]
    assert units.stated_units("all capacities " + "of the plants named in the tables of this very long note " * 4 + "are given in megawatts.") == ("mw", None)
