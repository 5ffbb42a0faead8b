"""Quantities in different units, converted to kW, kWh or whole units of a currency.

A map-only Arrow stage finds the stated amounts of a text as ``(number, unit)``; the unit is then joined, on equality,
with the table that ``unit_graph`` composes from the conversion edges, and the affine function is applied to exact
decimals in the JVM. The table has one row per known unit, is built from the fixed lists below and doesn't grow with
the data, so it is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampora.operators.unit_graph import Edge, UnitGraph, edge
from ampora.session import spread

# Spellings of the power units, by size.
POWER_WORDS = {
    "w": ("w", "watt", "watts", "vatio", "vatios", "瓦", "瓦特"),
    "kw": ("kw", "kilowatt", "kilowatts", "kilovatio", "kilovatios", "quilowatt", "quilowatts", "千瓦"),
    "wankw": ("万千瓦",),
    "mw": ("mw", "megawatt", "megawatts", "megavatio", "megavatios", "mégawatt", "mégawatts", "兆瓦"),
    "gw": ("gw", "gigawatt", "gigawatts", "gigavatio", "gigavatios", "吉瓦"),
    "tw": ("tw", "terawatt", "terawatts", "太瓦"),
}
# What may follow a power unit without changing it: peak, alternating and direct current, thermal.
POWER_TAILS = ("p", "ac", "dc", "e", "peak")
# What turns a power unit into one of energy.
ENERGY_TAILS = ("h", "hr", "hour", "hours", "hora", "horas", "stunde", "stunden", "heure", "heures", "时", "小时")
# Spellings of the currencies.
CURRENCY_WORDS = {
    "USD": ("usd", "us$", "$", "us dollars", "us dollar", "dólares", "dolares", "dollars", "美元", "u$s", "dólares estadounidenses"),
    "EUR": ("eur", "€", "euro", "euros", "欧元"),
    "CNY": ("cny", "rmb", "人民币", "元", "元人民币", "yuan", "¥", "人民币元"),
    "BRL": ("brl", "r$", "reais", "real", "雷亚尔"),
    "SAR": ("sar", "里亚尔", "riyals", "riyal"),
    "INR": ("inr", "₹", "rs", "rupees", "卢比"),
    "GBP": ("gbp", "£", "pounds", "英镑"),
    "JPY": ("jpy", "日元"),
}
# Spellings of the scales of money.
SCALE_WORDS = {
    10**3: ("thousand", "mil", "tsd", "千"),
    10**4: ("万",),
    10**5: ("lakh", "lakhs", "lac"),
    10**6: ("m", "mn", "million", "millions", "mio", "milhão", "milhões", "millón", "millones", "millionen", "百万"),
    10**7: ("crore", "crores", "cr", "千万"),
    10**8: ("亿",),
    10**9: ("bn", "b", "billion", "billions", "mrd", "milliarden", "milliards", "bilhões", "bilhão", "mil millones"),
}

_SIZES = {"kw": 10**3, "wankw": 10**7, "mw": 10**6, "gw": 10**9, "tw": 10**12}


def conversion_edges() -> list[Edge]:
    """The fixed edges: each size to the next one, each spelling to its size, each scale of money to the plain currency."""
    edges = [edge("kw", "kW", 1), edge("kwh", "kWh", 1)]
    for tail in ("", "h"):
        edges += [edge("kw" + tail, "w" + tail, 1000), edge("mw" + tail, "kw" + tail, 1000), edge("gw" + tail, "mw" + tail, 1000), edge("tw" + tail, "gw" + tail, 1000), edge("wankw" + tail, "kw" + tail, 10**4), edge("wankw" + tail, "mw" + tail, 10), edge("gw" + tail, "w" + tail, 10**9)]
    for code in CURRENCY_WORDS:
        edges += [edge(f"{scale} {code}", code, scale) for scale in SCALE_WORDS]
        edges += [edge(f"{10**9} {code}", f"{10**6} {code}", 1000), edge(f"{10**8} {code}", f"{10**4} {code}", 10**4)]
    return edges


@lru_cache(1)
def conversion_rows() -> list[tuple[str, str, str, str]]:
    targets = ["kW", "kWh", *CURRENCY_WORDS]
    graph = UnitGraph(conversion_edges())
    graph.check_cycles(targets)
    text = lambda f: format(Decimal(f.numerator) / Decimal(f.denominator), "f")
    return [(unit, target, text(a), text(b)) for unit, target, a, b, _ in graph.compositions(targets)]


def conversions(spark: SparkSession) -> DataFrame:
    """``unit, target, scale, offset``: one row per known unit."""
    rows = spark.createDataFrame(conversion_rows(), "unit string, target string, scale string, offset string")
    return rows.select("unit", "target", F.col("scale").cast("decimal(16,6)").alias("scale"), F.col("offset").cast("decimal(16,6)").alias("offset"))


def _alternatives(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


@lru_cache(1)
def _patterns():
    power = {w: size for size, words in POWER_WORDS.items() for w in words}
    # 万瓦 is no spelling in use, but 万 may stand before any of the Chinese power words.
    unit = rf"(?P<power>{_alternatives(power)})(?:[ ·.\-]?(?P<energy>{_alternatives(ENERGY_TAILS)})|(?P<tail>{_alternatives(POWER_TAILS)}))?(?![a-zà-ÿ])"
    currency = {w: code for code, words in CURRENCY_WORDS.items() for w in words}
    scale = {w: size for size, words in SCALE_WORDS.items() for w in words}
    scales = _alternatives(scale)
    money = rf"(?:(?P<scale>{scales})(?![a-zà-ÿ])\.?|(?P<glued>m)(?=usd|eur|€))?(?:\s*(?:de\s+|of\s+|in\s+)?(?P<after>{_alternatives(currency)})(?![a-zà-ÿ]))?"
    number = r"\d+(?:[.,]\d+)*"
    amount = re.compile(rf"(?P<n>{number})(?:\s*[x×*]\s*(?P<m>{number}))?\s*(?:{unit})?")
    priced = re.compile(rf"(?:(?<![a-z])(?P<before>{_alternatives(currency)})\s*)?(?P<n>{number})(?:\s*[x×*]\s*(?P<m>{number}))?\s*{money}")
    stated_power = re.compile(rf"(?<![a-zà-ÿ]){unit}")
    stated_money = re.compile(rf"(?<![a-zà-ÿ])(?P<scale>{scales})\.?\s*(?:de\s+|of\s+|in\s+)?(?P<after>{_alternatives(currency)})(?![a-zà-ÿ])|(?<![a-zà-ÿ])(?P<before>{_alternatives(currency)})\s*(?:in\s+)?(?P<scale2>{scales})(?![a-zà-ÿ])|(?<![a-zà-ÿ])(?P<only>{_alternatives(w for w in currency)})(?![a-zà-ÿ])")
    other = re.compile(r"kv|千伏|km|公里|千米|m²|公顷|%|°|years?|年|月|日|volt|\bv\b|hz|台|座|公斤|kg")
    return power, unit, currency, scale, amount, priced, stated_power, stated_money, other


def read_number(text: str) -> Decimal | None:
    """The number that ``text`` states.

    Of two kinds of separators the last one is decimal. One dot is decimal. One comma before exactly three digits groups
    thousands, unless only a 0 stands before it; any other single comma is decimal. Repeated commas or dots at every
    third digit group thousands; other repetitions are no number.
    """
    dots, commas = text.count("."), text.count(",")
    if dots and commas:
        last = max(text.rfind("."), text.rfind(","))
        whole, part = re.sub("[.,]", "", text[:last]), text[last + 1 :]
        return Decimal(f"{whole}.{part}")
    if commas == 1:
        whole, part = text.split(",")
        if len(part) == 3 and whole.strip("0") != "":
            return Decimal(whole + part)
        return Decimal(f"{whole}.{part}")
    if dots == 1:
        return Decimal(text)
    if dots or commas:
        groups = re.split("[.,]", text)
        return Decimal("".join(groups)) if all(len(g) == 3 for g in groups[1:]) and len(groups[0]) <= 3 else None
    return Decimal(text)


def _fold(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


def _product(m: re.Match) -> Decimal | None:
    n = read_number(m["n"])
    if n is not None and m["m"]:
        k = read_number(m["m"])
        n = None if k is None else n * k
    return n


def find_amounts(text: str | None, kind: str) -> list[tuple[Decimal, str | None]]:
    """The amounts in ``text`` as ``(number, unit)``, unit None where none is stated; kind is ``power`` or ``money``."""
    if not text:
        return []
    t = _fold(text)
    power, _, currency, scale, amount, priced, _, _, other = _patterns()
    out, at = [], 0
    while m := (amount if kind == "power" else priced).search(t, at):
        at = max(m.end(), m.start() + 1)
        n = _product(m)
        if n is None:
            continue
        if kind == "power":
            unit = None
            if m["power"]:
                unit = power[m["power"]] + ("h" if m["energy"] else "")
            elif other.match(t, m.end()):
                continue
            elif m.end() < len(t) and re.match(r"[a-zà-ÿ一-鿿]", t[m.end()]):
                continue
        else:
            word = m["before"] or m["after"]
            size = scale[m["scale"]] if m["scale"] else 10**6 if m["glued"] else None
            if m["before"] and m["after"] and currency[m["before"]] != currency[m["after"]]:
                word = m["after"]
            unit = None if word is None else f"{size} {currency[word]}" if size else currency[word]
            if unit is None and size is not None:
                unit = f"{size} ?"
        out.append((n, unit))
    return out


_SENTENCE = re.compile(r"(?<=[.。!?！？;；])(?<!mio\.)(?<!mrd\.)\s*(?!\d)")


def stated_units(text: str | None) -> tuple[str | None, str | None]:
    """The units of power (or energy) and of money that ``text`` states for figures elsewhere.

    Only a sentence without digits states a unit; a sentence with digits speaks of its own amounts.
    """
    if not text:
        return None, None
    power, _, currency, scale, _, _, in_power, in_money, _ = _patterns()
    found_power = found_money = None
    for sentence in _SENTENCE.split(_fold(text)):
        if not sentence or re.search(r"\d", sentence):
            continue
        if found_power is None and (m := in_power.search(sentence)):
            found_power = power[m["power"]] + ("h" if m["energy"] else "")
        if found_money is None and (m := in_money.search(sentence)):
            word = m["after"] or m["before"] or m["only"]
            size = m["scale"] or m["scale2"]
            # A currency alone must stand beside a word for money, or prose about dollars would count.
            if size or re.search("invest|投资|costs?|金额", sentence):
                found_money = f"{scale[size]} {currency[word]}" if size else currency[word]
    return found_power, found_money


# Numbers travel as text in plain notation, so that neither their size nor their fraction is cut.
AMOUNTS = T.ArrayType(T.StructType([T.StructField("number", T.StringType()), T.StructField("unit", T.StringType())]))


def _amounts_udf(kind: str):
    @F.pandas_udf(AMOUNTS)
    def amounts(texts: pd.Series) -> pd.Series:
        @lru_cache(100_000)
        def one(text):
            return [{"number": format(n, "f"), "unit": u} for n, u in find_amounts(text, kind)]

        return pd.Series([one(t) for t in texts])

    return amounts


@F.pandas_udf(T.StructType([T.StructField("power", T.StringType()), T.StructField("money", T.StringType())]))
def _stated(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stated_units(t) for t in texts], columns=["power", "money"], dtype=object)


def normalise_amounts(values: DataFrame, text: str, kind: str, default_unit: Column) -> DataFrame:
    """``values`` with one row per amount that column ``text`` states: columns unit (canonical) and value (BIGINT) are added.

    ``default_unit`` is the unit of amounts that state none; amounts without any are left out, as are null and empty
    texts and amounts whose unit isn't known. Halves are rounded away from zero; an amount beyond BIGINT comes out with a
    null value. Equal amounts of one text come out as often as stated; an empty table gives an empty one.
    """
    spark = values.sparkSession
    exploded = values.withColumn("_amount", F.explode(_amounts_udf(kind)(F.col(text)))).withColumn("_default", default_unit)
    stated = F.col("_amount.unit")
    unit = F.when(stated.endswith(" ?"), F.concat(F.regexp_extract(stated, r"^(\d+)", 1), F.lit(" "), F.regexp_extract("_default", r"([A-Z]{3})$", 1))).otherwise(F.coalesce(stated, "_default"))
    table = F.broadcast(conversions(spark).select(F.col("unit").alias("_unit"), F.col("target").alias("_target"), "scale", "offset"))
    joined = exploded.withColumn("_unit", unit).join(table, "_unit")
    # 20 digits before the point and 18 after it hold any amount that fits BIGINT; what doesn't fit is null instead of an error.
    number = F.col("_amount.number").try_cast("decimal(38,18)")
    value = F.round(F.try_add(F.try_multiply(number, F.col("scale")), F.col("offset")), 0).try_cast("bigint")
    return joined.select(*values.columns, F.col("_target").alias("unit"), value.alias("value"))


# The unit of a project field whose value states none; fixed by the field ids.
PROJECT_UNITS = {"pv_capacity_mw": "mw", "storage_capacity_mwh": "mwh", "storage_power_mw": "mw"}


def feed_amounts(feed: DataFrame, sources: DataFrame) -> DataFrame:
    """Amounts of capacity and investment of the feed: ``table_name, row_key, field, unit, value``."""
    src = sources.select("source_id", _stated("coverage").alias("_s")).select("source_id", F.col("_s.power").alias("_src_power"), F.col("_s.money").alias("_src_money"))
    # sources is a dimension with one row per feed; Spark broadcasts it while it is under the session's threshold.
    rows = feed.select("record_id", "source_id", "content", "capacity", "investment").where(F.coalesce("capacity", "investment").isNotNull())
    rows = spread(rows).withColumn("_c", _stated("content")).join(src.dropDuplicates(["source_id"]), "source_id", "left")
    out = []
    for field, kind in (("capacity", "power"), ("investment", "money")):
        part = rows.where(F.col(field).rlike(r"[0-9０-９]")).select(F.lit("project_intel").alias("table_name"), F.col("record_id").alias("row_key"), F.lit(field).alias("field"), F.col(field).alias("_text"), F.coalesce(F.col(f"_c.{kind}"), F.col(f"_src_{kind}")).alias("_unit_default"))
        out.append(normalise_amounts(part, "_text", kind, F.col("_unit_default")).select("table_name", "row_key", "field", "unit", "value"))
    return out[0].unionByName(out[1])


def project_amounts(projects: DataFrame) -> DataFrame:
    """Amounts of the three numeric fields of fields_json: ``table_name, row_key, field, unit, value``."""
    schema = ", ".join(f"{f} string" for f in PROJECT_UNITS)
    fields = spread(projects.select("row_id", "fields_json")).select("row_id", F.from_json("fields_json", schema).alias("f"))
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f.{f}").alias("text"), F.lit(u).alias("unit")) for f, u in PROJECT_UNITS.items())))
    rows = fields.select(F.lit("projects").alias("table_name"), F.col("row_id").alias("row_key"), stack.alias("x")).select("table_name", "row_key", F.col("x.field").alias("field"), F.col("x.text").alias("_text"), F.col("x.unit").alias("_unit_default")).where(F.col("_text").rlike(r"[0-9０-９]"))
    return normalise_amounts(rows, "_text", "power", F.col("_unit_default")).select("table_name", "row_key", "field", "unit", "value")


def found(spark: SparkSession, feed: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """One distinct row per stated amount of both tables."""
    return feed_amounts(feed, sources).unionByName(project_amounts(projects)).distinct()
