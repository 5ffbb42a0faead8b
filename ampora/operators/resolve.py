"""Mentions of one project in many documents, resolved to entities.

The pair score is the reference's: name 0.6, country 0.15, three capacities 0.2, party 0.1 and address 0.1; names also count by
their tokens. Candidates come from equi joins within matching countries that lose no pair over the threshold: prefix
filters over bigrams and over tokens for similar names, the rarest bigram of the shorter text for contained ones, and the
same over addresses for pairs whose names are hardly alike. Names are nodes, linked where any two of their mentions score
above the threshold; links give components by min-label propagation whose rounds are written to files.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampora.functions import text as X
from ampora.session import cut_lineage, written

THRESHOLD = 0.58
CAPACITIES = ("capacity", "storage_power", "storage_energy")
_WORDS = "solar pv photovoltaic battery energy storage project power plant farm".split()
_WORD = re.compile(rf"\b(?:{'|'.join(_WORDS)})\b", re.ASCII)
_PLAIN = re.compile(r"[\W_]+")
# Texts that say that nothing is known.
STAND_INS = ("tbd", "tba", "unknown", "未知", "n/a", "na", "none", "null", "s/d", "k.a.", "待定", "未披露", "to be confirmed", "not disclosed", "nan", "undefined", "n.d.", "不详", "暂无")


def read(text: str | None) -> tuple[str, list[str]]:
    """``(plain, tokens)``: letters and digits without general words, and the distinct tokens of two characters or more."""
    t = unicodedata.normalize("NFKC", (text or "").strip().lower())
    if t in STAND_INS:
        return "", []
    return _PLAIN.sub("", _WORD.sub(" ", t)), sorted({x for x in _PLAIN.split(t) if len(x) >= 2 and x not in _WORDS})


@F.pandas_udf(T.StructType([T.StructField("plain", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))
def _read(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(t) for t in texts], columns=["plain", "tokens"])


def holds(a: Column, b: Column) -> Column:
    """Whether both are given and one holds the other."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def name_score(a: Column, b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """0 where a name is empty, 1 where one holds the other, else the greater of bigrams' Dice and tokens' Jaccard."""
    union = F.size(F.array_union(tokens_a, tokens_b))
    jaccard = F.when(union > 0, F.size(F.array_intersect(tokens_a, tokens_b)) / union).otherwise(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(holds(a, b), 1.0).otherwise(F.greatest(jaccard, X.dice(X.bigrams(a), X.bigrams(b))))


def capacity_score(a: list[Column], b: list[Column]) -> Column:
    """Of the capacities that both state, the share that agree within five per cent; 0 where there is none."""
    one = lambda x: x.cast("int")
    both = [F.coalesce((x > 0) & (y > 0), F.lit(False)) for x, y in zip(a, b)]
    near = [k & (F.abs(x - y) <= 0.05 * F.greatest(x, y)) for k, x, y in zip(both, a, b)]
    compared = sum((one(k) for k in both), F.lit(0))
    return F.when(compared > 0, sum((one(F.coalesce(k, F.lit(False))) for k in near), F.lit(0)) / compared).otherwise(0.0)


def match_score(a: str, b: str, named: Column) -> Column:
    """The score of two mentions whose names score ``named``; another country rules a pair out before."""
    c = lambda side, x: F.col(f"{side}.{x}")
    weight = lambda x, w: F.when(x, w).otherwise(0.0)
    capacities = capacity_score([c(a, x) for x in CAPACITIES], [c(b, x) for x in CAPACITIES])
    score = 0.6 * named + weight((c(a, "country") != "") & (c(b, "country") != ""), 0.15) + 0.2 * capacities
    return F.least(score + weight(holds(c(a, "party"), c(b, "party")), 0.1) + weight(holds(c(a, "address"), c(b, "address")), 0.1), F.lit(1.0))


BROADCAST_COUNTRIES = 100_000  # pairs of matching country names (about 10 MB) that are broadcast; beyond, they are joined


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the least node of each connected component; rounds go on until no label changes."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(nodes.select("node", F.col("node").alias("component")))
    while True:
        least = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        # A label's own label is followed as well, which halves the distance to the root.
        step = labels.join(least, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("before"))
        jump = step.alias("s").join(step.select(F.col("node").alias("n2"), F.col("component").alias("c2")), F.col("s.component") == F.col("n2"), "left")
        after = written(jump.select("node", F.least("component", F.coalesce("c2", "component")).alias("component"), "before"))
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels


def _matching(known: DataFrame) -> DataFrame:
    """``c1, c2``: the countries of which one is empty or holds the other, by equi joins of parts with whole names."""
    # Distinct lengths of country names: no more than the longest has letters.
    lengths = sorted(r[0] for r in known.select(F.length("country")).distinct().collect() if r[0])
    if not lengths:
        return known.select(F.col("country").alias("c1"), F.col("country").alias("c2"))
    n = F.length("country")
    parts = known.where("country <> ''").select(F.col("country").alias("c1"), F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= n)).alias("k"))
    parts = parts.select("c1", F.explode(F.transform(F.sequence(F.lit(1), F.length("c1") - F.col("k") + 1), lambda i: F.substring(F.col("c1"), i, F.col("k")))).alias("c2")).distinct()
    held = parts.join(known.select(F.col("country").alias("c2")), "c2").select("c1", "c2")
    none = known.select(F.col("country").alias("c1"), F.lit("").alias("c2"))
    return held.unionByName(held.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"))).unionByName(none).unionByName(none.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"))).distinct()


def _rarest(items: DataFrame, keys: Column) -> DataFrame:
    """``id, country, keys``: each item's distinct keys, the rarest first."""
    filed = items.select("id", "country", F.explode(keys).alias("key"))
    counts = filed.groupBy("key").count()
    ranked = filed.join(counts, "key").groupBy("id", "country").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("keys"))
    return ranked.select("id", "country", F.transform("keys", lambda x: x["key"]).alias("keys"))


def _meet(left: DataFrame, right: DataFrame, countries: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of the ids of both sides (id, country, keys) that share a key within matching countries."""
    x = left.select(F.col("id").alias("x"), F.col("country").alias("c1"), F.explode("keys").alias("key")).join(countries, "c1")
    y = right.select(F.col("id").alias("y"), F.col("country").alias("c2"), F.explode("keys").alias("key"))
    return x.join(y, ["c2", "key"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _contained(items: DataFrame, text: str, countries: DataFrame) -> DataFrame:
    """Candidates among ``items`` (id, country, text) whose texts may hold one another: all keys of the shorter are keys of the longer."""
    chars = F.array_distinct(F.split(F.col(text), "")) if not items.where(F.length(text) == 1).isEmpty() else F.array().cast("array<string>")
    own = F.when(F.length(text) == 1, F.array(F.col(text))).otherwise(X.bigrams(F.col(text)))
    first = _rarest(items, own).withColumn("keys", F.slice("keys", 1, 1))
    return _meet(first, items.select("id", "country", F.array_union(X.bigrams(F.col(text)), chars).alias("keys")), countries)


def _prefix(ranked: DataFrame, share: float) -> DataFrame:
    """Without as many of the commonest keys as two sets that share this part of each can do without."""
    n = F.size("keys")
    return ranked.withColumn("keys", F.slice("keys", F.lit(1), n - F.ceil(n * F.lit(share) - 1e-9).cast("int") + 1))


def resolve(mentions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``mention_id, entity_id`` for mentions (mention_id, name, country, capacity, party; storage_power, storage_energy and
    address may be missing).

    Null names and countries and texts that say that nothing is known count as empty; a mention without a name is an
    entity of its own; repeated rows are one.
    """
    given = lambda c: F.col(c) if c in mentions.columns else F.lit(None)
    clean = mentions.select("mention_id", _read("name").alias("_n"), *[_read(given(c).cast("string"))["plain"].alias(c) for c in ("country", "party", "address")], *[given(c).cast("double").alias(c) for c in CAPACITIES])
    clean = clean.select("mention_id", F.col("_n.plain").alias("name"), F.col("_n.tokens").alias("tokens"), "country", "party", "address", *CAPACITIES)
    keyed = cut_lineage(clean.withColumn("node", F.when(F.col("name") == "", F.xxhash64("mention_id", F.lit("alone"))).otherwise(F.xxhash64("name", "tokens", "country"))).distinct())
    nodes = cut_lineage(keyed.dropDuplicates(["node"]).select("node", "name", "tokens", "country"))
    facts = cut_lineage(keyed.where("name <> ''").withColumn("id", F.xxhash64("node", "party", "address", *CAPACITIES)).dropDuplicates(["id"]).drop("mention_id"))
    known = nodes.select("country").distinct()
    countries = cut_lineage(_matching(known))
    if countries.count() <= BROADCAST_COUNTRIES:
        countries = F.broadcast(countries)
    named = nodes.where("name <> ''").select(F.col("node").alias("id"), "name", "tokens", "country")
    # Without an address or a party in common, or without a capacity, names must score this much; Dice d needs d / (2 - d) of each side's bigrams.
    least = (threshold - 0.45) / 0.6
    grams, tokens = _prefix(_rarest(named, X.bigrams(F.col("name"))), least / (2 - least)), _prefix(_rarest(named, F.col("tokens")), least)
    pairs = _meet(grams, grams, countries).unionByName(_meet(tokens, tokens, countries)).unionByName(_contained(named, "name", countries)).distinct()
    side = lambda d, s: d.select(F.col("id").alias(s), F.struct(*[c for c in d.columns if c != "id"]).alias(f"{s}_"))
    score = name_score(F.col("a_.name"), F.col("b_.name"), F.col("a_.tokens"), F.col("b_.tokens"))
    alone = 0.6 * F.col("named") + F.when((F.col("a_.country") != "") & (F.col("b_.country") != ""), 0.15).otherwise(0.0)
    scored = cut_lineage(pairs.join(side(named, "a"), "a").join(side(named, "b"), "b").withColumn("named", score).where(F.col("named") >= least - 1e-9).select("a", "b", "named", alone.alias("alone")))
    # Names that need more are compared by what their mentions state.
    of = lambda s: facts.select(F.col("node").alias(s), F.struct("country", "party", "address", *CAPACITIES).alias(f"{s}_"))
    near = scored.where((F.col("alone") < threshold) & (F.col("alone") + 0.4 >= threshold - 1e-9)).join(of("a"), "a").join(of("b"), "b").where(match_score("a_", "b_", F.col("named")) >= threshold)
    # Names that are hardly alike need everything else: address, party and a capacity.
    full = facts.where("address <> '' AND party <> '' AND country <> ''").where(F.coalesce(*[F.when(F.col(c) > 0, True) for c in CAPACITIES]))
    far = _contained(full, "address", countries).join(side(full, "a"), "a").join(side(full, "b"), "b").where(holds(F.col("a_.address"), F.col("b_.address")) & holds(F.col("a_.party"), F.col("b_.party"))).where(match_score("a_", "b_", score) >= threshold)
    links = cut_lineage(scored.where(F.col("alone") >= threshold).select("a", "b").unionByName(near.select("a", "b")).unionByName(far.select(F.col("a_.node").alias("a"), F.col("b_.node").alias("b"))).distinct())
    found = components(nodes, links)
    return keyed.join(found, "node").select("mention_id", F.col("component").alias("entity_id")).distinct()
