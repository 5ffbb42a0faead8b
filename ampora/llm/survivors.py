"""The surviving value of each field of a group of duplicate records.

Token-level consensus (``consensus_survivors``): the distinct values of a group are aligned progressively, heaviest first, the
weighted tokens of each column vote, and the existing value closest to the consensus survives. Equal values are summed before the
shuffle; a group of more than ``BLOCK`` distinct values is voted on in salted blocks whose survivors, with their blocks' weight, are
voted on again until one block is left, so no task holds an unbounded group.

Where records stand in a total order of precedence in which each outweighs all after it together, the first has the majority
in every column by itself and no vote can change it. ``survivors`` is that case: the best record of each group is a
minimum, folded before the shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampora.session import cut_lineage

# Values that stand in for a missing one; fixed by the data's description and what it holds.
STAND_INS = ("", "tbd", "tba", "unknown", "未知", "-", "?", "n/a", "na", "none", "null", "s/d", "k.a.", "—", "–", "--", "待定", "未披露", "to be confirmed", "not disclosed", "nan", "undefined", "n.d.", "...", "??", "不详", "暂无")
BLOCK = 256  # distinct values voted on at once, on average
CELLS = 1 << 20  # of an alignment's table held at once; beyond, it is split in two

_TOKEN = re.compile(r"\w+|[^\w\s]")


def _lengths(rows: list[np.ndarray]) -> np.ndarray:
    """The last row of the table of longest common subsequences; ``rows`` say which tokens each column holds."""
    before = np.zeros(len(rows[0]) + 1, dtype=np.int64)
    for row in rows:
        now = before.copy()
        np.maximum(before[1:], before[:-1] + row, out=now[1:])
        before = np.maximum.accumulate(now)
    return before


def _pairs(rows: list[np.ndarray], i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Appends the (column, token) pairs of a longest common subsequence, in order; splits large tables (linear memory)."""
    n, m = len(rows), len(rows[0]) if rows else 0
    if not n or not m:
        return
    if n * m > CELLS and n > 1:
        half = n // 2
        left = _lengths(rows[:half])
        right = _lengths([r[::-1] for r in rows[half:][::-1]])[::-1]
        at = int((left + right).argmax())
        _pairs([r[:at] for r in rows[:half]], i, j, out)
        _pairs([r[at:] for r in rows[half:]], i + half, j + at, out)
        return
    table = np.zeros((n + 1, m + 1), dtype=np.int32)
    for k, row in enumerate(rows):
        np.maximum(table[k, 1:], table[k, :-1] + row, out=table[k + 1, 1:])
        np.maximum.accumulate(table[k + 1], out=table[k + 1])
    found, x, y = [], n, m
    while x and y:
        if table[x, y] == table[x - 1, y]:
            x -= 1
        elif table[x, y] == table[x, y - 1]:
            y -= 1
        else:
            x, y = x - 1, y - 1
            found.append((i + x, j + y))
    out += found[::-1]


def align(columns: list[set[int]], tokens: list[int]) -> list[int | None]:
    """For each token the column that it goes to, None for a new one; columns keep their order (longest common subsequence)."""
    out: list[int | None] = [None] * len(tokens)
    low = 0
    while low < min(len(columns), len(tokens)) and tokens[low] in columns[low]:  # equal beginnings need no table
        out[low] = low
        low += 1
    array = np.array(tokens[low:], dtype=np.int64)
    pairs: list[tuple[int, int]] = []
    if len(array) and low < len(columns):
        _pairs([np.isin(array, list(c)) for c in columns[low:]], low, low, pairs)
    for column, token in pairs:
        out[token] = column
    return out


def consensus(values: list[list[str]], weights: list[float]) -> list[str]:
    """The consensus of token lists: progressive alignment in their order, then a weighted vote per column; ties go to the earlier value."""
    ids: dict[str, int] = {}
    columns: list[dict[int, float]] = []  # per column the votes of its tokens, those of the earlier values first
    in_first: list[bool] = []
    for tokens, weight in zip(values, weights):
        coded = [ids.setdefault(t, len(ids)) for t in tokens]
        first = not columns
        merged, old, at = [], [], 0
        for token, where in zip(coded, align([set(c) for c in columns], coded)):
            if where is None:
                merged.append({token: weight})
                old.append(first)
                continue
            merged += columns[at : where + 1]
            old += in_first[at : where + 1]
            merged[-1][token] = merged[-1].get(token, 0.0) + weight
            at = where + 1
        columns, in_first = merged + columns[at:], old + in_first[at:]
    total, words, out = sum(weights), list(ids), []
    for votes, mine in zip(columns, in_first):
        best = max(votes, key=votes.__getitem__)
        missing = total - sum(votes.values())
        if votes[best] > missing or votes[best] == missing and mine:
            out.append(words[best])
    return out


def _distance(a: list[str], b: list[str]) -> int:
    ids: dict[str, int] = defaultdict(lambda: len(ids))
    x, y = [ids[t] for t in a], np.array([ids[t] for t in b], dtype=np.int64)
    steps = np.arange(len(y) + 1)
    before = steps.copy()
    for i, token in enumerate(x, 1):
        now = np.empty_like(before)
        now[0] = i
        np.minimum(before[1:] + 1, before[:-1] + (y != token), out=now[1:])
        before = np.minimum.accumulate(now - steps) + steps
    return int(before[-1])


def closest(values: list[str], weights: list[float]) -> int:
    """The place of the value closest to the consensus of ``values``; ties go to the heavier, then to the first."""
    if len(values) == 1:
        return 0
    tokens = [_TOKEN.findall(v) or [v] for v in values]
    order = sorted(range(len(values)), key=lambda k: (-weights[k], k))
    agreed = consensus([tokens[k] for k in order], [weights[k] for k in order])
    return min(order, key=lambda k: (_distance(tokens[k], agreed), -weights[k], k))


@F.pandas_udf(T.IntegerType())
def _closest(values: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([closest(list(v), list(w)) for v, w in zip(values, weights)], dtype="int32")


def _vote(values: DataFrame, keys: list[str]) -> DataFrame:
    """One survivor per group of ``keys``, with the group's weight; values have columns value, weight and rank."""
    # The number of values of a group is bounded by the caller.
    groups = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "value", "weight"))).alias("g"), F.sum("weight").alias("weight"))
    pick = lambda name: F.transform("g", lambda x: x[name])
    # A value of half of all weight has the majority in every column: no vote can change it, so no trip to Python.
    top = F.array_max(pick("weight"))
    settled = top * 2 >= F.col("weight")
    many = groups.where(~settled).withColumn("i", _closest(pick("value"), pick("weight")))
    one = groups.where(settled).withColumn("i", (F.array_position(pick("weight"), top) - 1).cast("int"))
    best = F.element_at("g", F.col("i") + 1)
    return many.unionByName(one).select(*keys, best["value"].alias("value"), best["rank"].alias("rank"), "weight")


KEYS = ["canonical_key", "field"]


def consensus_survivors(values: DataFrame, weight: Column) -> DataFrame:
    """``canonical_key, field, row_id, value`` of the existing value closest to the weighted consensus of each group.

    ``weight`` is a positive number per row of ``values`` (see ``field_values``). Null, blank and stand-in values never survive; equal
    values vote together and are supplied by their best record; a group without a real value gives no row; ties go to the
    better record. Above ``BLOCK`` distinct values the consensus is one of blocks.
    """
    left = values.groupBy(*KEYS, "value").agg(F.sum(weight.cast("double")).alias("weight"), F.min("rank").alias("rank"))
    left = cut_lineage(left)
    while True:
        sizes = left.groupBy(*KEYS).count().where(F.col("count") > BLOCK).select(*KEYS, F.ceil(F.col("count") / BLOCK).cast("int").alias("_blocks"))
        sizes = cut_lineage(sizes)
        if sizes.isEmpty():
            return _vote(left, KEYS).select(*KEYS, F.col("rank.row_id").alias("row_id"), "value")
        # Only the large groups are dealt out and voted on in blocks; the others wait for the last vote.
        salted = left.join(sizes, KEYS).withColumn("_block", F.pmod(F.xxhash64("value", "rank"), F.col("_blocks")))
        left = cut_lineage(left.join(sizes, KEYS, "left_anti").unionByName(_vote(salted, [*KEYS, "_block"]).drop("_block")))


def field_values(projects: DataFrame, sources: DataFrame) -> DataFrame:
    """Every real value of fields_json: ``canonical_key, field, value, rank``; rows without a key are left out."""
    trust = sources.select("source_id", F.col("trust_level").alias("_trust")).dropDuplicates(["source_id"])
    fields = F.from_json("fields_json", "map<string,string>")
    rows = projects.select(
        "canonical_key",
        "source_id",
        "row_id",
        "updated_at",
        fields.alias("_fields"),
        F.coalesce(F.transform(F.from_json("conflicts_json", "array<struct<field:string>>"), lambda c: c["field"]), F.array().cast("array<string>")).alias("_conflicts"),
        F.coalesce(F.map_keys(F.from_json("evidence_json", "map<string,string>")), F.array().cast("array<string>")).alias("_evidence"),
    )
    rows = rows.where(F.col("canonical_key").isNotNull()).join(trust, "source_id", "left")
    long = rows.select("*", F.explode("_fields").alias("field", "value"))
    real = F.col("value").isNotNull() & ~F.lower(F.trim(F.regexp_replace("value", r"[\s 　]+", " "))).isin(*STAND_INS)
    rank = F.struct(
        F.coalesce(F.array_contains("_conflicts", F.col("field")), F.lit(False)).alias("in_conflict"),
        (~F.coalesce(F.array_contains("_evidence", F.col("field")), F.lit(False))).alias("no_evidence"),
        (-F.coalesce("_trust", F.lit(0))).alias("distrust"),
        (-F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62)))).alias("age"),
        F.col("row_id").alias("row_id"),
    )
    return long.where(real).select("canonical_key", "field", "value", rank.alias("rank"))


def survivors(values: DataFrame) -> DataFrame:
    """``canonical_key, field, row_id, value`` of the value of the first record of each group, in order of ``rank``.

    Null, blank and stand-in values never survive; a group without a real value gives no row; extra columns are ignored.
    """
    best = values.groupBy(*KEYS).agg(F.min(F.struct("rank", "value")).alias("best"))
    return best.select(*KEYS, F.col("best.rank.row_id").alias("row_id"), F.col("best.value").alias("value"))


def several(found: DataFrame, projects: DataFrame) -> DataFrame:
    """The rows of ``found`` whose key stands in at least two rows of ``projects``.

    The keys are chosen after the fold, when each has a row per field, so that a hot key never meets a join as rows.
    """
    keys = projects.groupBy("canonical_key").count().where("count > 1").select("canonical_key")
    return found.join(keys, "canonical_key", "left_semi")


def record_weight() -> Column:
    """The weight of a record's value in a vote: its source's trust, double with evidence, a quarter in conflict."""
    rank = F.col("rank")
    return (1.0 - rank["distrust"]) * F.when(rank["no_evidence"], 1.0).otherwise(2.0) * F.when(rank["in_conflict"], 0.25).otherwise(1.0)


def records(found: DataFrame) -> DataFrame:
    """``canonical_key, fields, suppliers``: one surviving record per key, its fields and the rows that supply them."""
    # A key has one row per field id, so its list is bounded by the number of fields.
    pairs = found.groupBy("canonical_key").agg(F.array_sort(F.collect_list(F.struct("field", "value", "row_id"))).alias("f"))
    as_map = lambda name: F.map_from_arrays(F.transform("f", lambda x: x["field"]), F.transform("f", lambda x: x[name]))
    return pairs.select("canonical_key", as_map("value").alias("fields"), as_map("row_id").alias("suppliers"))


def found(projects: DataFrame, sources: DataFrame) -> DataFrame:
    """``canonical_key, field, row_id`` of every key with at least two rows."""
    return several(survivors(field_values(projects, sources)), projects).select("canonical_key", "field", "row_id")
