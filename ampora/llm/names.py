"""Variant spellings of companies and persons.

Every distinct typed string is folded (width, case, accents, punctuation, legal forms, titles, script of names) and each folded
string is a node. Its tokens give padded q-grams, weighted down where many names hold them (so that lines of business don't make
candidates of all companies), and weighted MinHash signatures cut into bands whose number follows from the collision curve
(``bands_for``). Nodes of one band are candidates, verified by Monge-Elkan similarity over tokens: its inner similarity takes
abbreviations (letters of the longer word in order), initials, short forms of given names and tokens written together for the
words they stand for, and an edit distance for the rest; no token may be left over. The verified links are clustered by stars.

A hot band is verified in blocks of ``BLOCK`` nodes, each pair of blocks in a group of its own, so no task holds a whole band.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampora.session import cut_lineage

Q, ROWS, SIMILARITY, RECALL = 3, 3, 0.4, 0.995
# q-grams that a larger part of the names (and more than so many) holds weigh less, by the square, down to the least weight.
COMMON, COMMON_NAMES, LEAST_WEIGHT = 0.05, 64, 0.1
# Of two names' q-grams, weighed more sharply, the lesser set's part that both hold; candidates below it aren't aligned (true pairs: 0.33 and more).
SHARP, SHARP_NAMES, SHARP_WEIGHT, SHARED = 0.02, 4, 0.02, 0.3
MONGE_ELKAN = 0.8
SLIP_SHARE = 0.25  # a spelling with at most this part of another's like spellings may be its slip
BLOCK = 64

# Fixed values of general use: legal forms, joining words, titles.
LEGAL = set("ltd limited inc incorporated corp corporation co company gmbh sa s.a ltda jsc joint stock group the llc plc ag spa srl bv nv pty pte sarl sas kg oy ab as".split())
JOINERS = {"and", "&", "of", "y", "e", "und", "et"}
TITLES = {"dr", "eng", "ing", "mr", "mrs", "ms", "prof", "sr", "sra", "dipl", "herr", "frau", "señor", "don", "doña"}
# Short forms of given names.
NICKNAMES = {
    "nat": "nathaniel", "nate": "nathaniel", "kate": "katherine", "kathy": "katherine", "sasha": "alexander", "alex": "alexander", "lupe": "guadalupe", "bob": "robert", "rob": "robert", "chema": "jose manuel", "peggy": "margaret", "meg": "margaret",
    "toni": "antonia", "ted": "theodore", "theo": "theodore", "bella": "isabella", "isa": "isabella", "rike": "friederike", "paco": "francisco", "pancho": "francisco", "liz": "elizabeth", "beth": "elizabeth", "edu": "eduardo", "lalo": "eduardo",
    "bill": "william", "will": "william", "hannes": "johannes", "hans": "johannes", "pepe": "jose", "jm": "jose manuel", "jose": "jose manuel",
}
HAN_LEGAL = re.compile(r"(?:\(集团\)|集团)?(?:股份|有限|责任)*(?:公司)?$")
# Traditional characters with their simplified forms.
SIMPLE = dict(zip("團資術電氣儲設責業發澤銘駿暢嶽暉遠櫟嶸瀾陽龍華國東廣寶豐興聯達馬鴻鵬輝澤濱滿寧蘭飛鳳義禮壽樂", "团资术电气储设责业发泽铭骏畅岳晖远栎嵘澜阳龙华国东广宝丰兴联达马鸿鹏辉泽滨满宁兰飞凤义礼寿乐"))



_HAN = re.compile(r"[㐀-鿿]")


def edits(a: str, b: str) -> int:
    """Edit distance where swapping neighbours counts one."""
    if a == b:
        return 0
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            now.append(v)
        two, one = one, now
    return one[-1]


def fold(name: str) -> list[str]:
    """The tokens of a typed name without what is form only: width, case, accents, punctuation, legal forms, titles, joining words."""
    t = unicodedata.normalize("NFKC", name).strip()
    t = "".join(SIMPLE.get(c, c) for c in t)
    if _HAN.search(t):
        t = HAN_LEGAL.sub("", re.sub(r"\s+", "", t))
        return [x for x in [re.sub(r"[^\w]|_", "", t).casefold()] if x]
    raw = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).casefold()
    raw = re.sub(r"\b(?:[a-z]\.\s?){2,}", lambda m: re.sub(r"[.\s]", "", m[0]) + " ", raw)  # g.m.b.h. -> gmbh
    before, comma, after = raw.partition(",")
    # A single letter with a dot is an initial, not a joining word.
    tokens = [x + dot for part in (before, after) for x, dot in re.findall(r"([^\W_]+)(\.?)", part)]
    if len(tokens) > 2 and tokens[0].rstrip(".") in TITLES:
        tokens = tokens[1:]
    bare = [x.rstrip(".") for x in tokens]
    return [y for x, y in zip(tokens, bare) if y not in LEGAL and x not in JOINERS] or bare


def _abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` is made of the first and further letters of ``long``, in order, and much shorter; one letter is an initial."""
    if not short or short[0] != long[0] or len(short) > 0.7 * len(long):
        return False
    rest = iter(long)
    return all(c in rest for c in short)


@lru_cache(200_000)
def alike(a: str, b: str) -> tuple[float, int]:
    """The similarity of two tokens and the letters by which they differ: none where one stands for the other."""
    if a == b or NICKNAMES.get(a, a) == NICKNAMES.get(b, b):
        return 1.0, 0
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if _abbreviates(short, long) or _abbreviates(short, NICKNAMES.get(long, long)):
        return 1.0, 0
    d = edits(a, b)
    if d == 1 and long == short + "s":
        return 1.0, 0
    return 1 - d / len(long), d


def _assign(a: list[str], b: list[str]) -> list[tuple[int, int, float, int]]:
    """Pairs of tokens, the most similar first, each token once: places, similarity, letters."""
    scored = sorted((p != q, -alike(p, q)[0], alike(p, q)[1], i != j, i, j) for i, p in enumerate(a) for j, q in enumerate(b))
    left, right, out = set(range(len(a))), set(range(len(b))), []
    for _, score, letters, _, i, j in scored:
        if i in left and j in right and -score >= 0.5:
            left.discard(i)
            right.discard(j)
            out.append((i, j, -score, letters))
    return out


def _expand(tokens: list[str]) -> list[str]:
    """The tokens with short forms of several given names written out."""
    return [w for t in tokens for w in (NICKNAMES[t].split() if " " in NICKNAMES.get(t, "") and not NICKNAMES[t].startswith(t + " ") else [t])]


def _join(a: list[str], b: list[str]) -> list[str]:
    """``a`` with two of its tokens joined where ``b`` writes them as one."""
    for token in b:
        if len(token) >= 6 and token not in a:
            for i, p in enumerate(a):
                for j, q in enumerate(a):
                    if i != j and abs(len(p) + len(q) - len(token)) <= 1 and min(len(p), len(q)) > 1 and edits(p + q, token) <= 1:
                        return _join([t for k, t in enumerate(a) if k not in (i, j)] + [p + q], b)
    return a


def _covers(token: str, many: list[str]) -> bool:
    """Whether a single token stands for all of ``many``: the initial of given names, or their initials and those of a legal form behind."""
    initials = "".join(t[0] for t in many)
    if len(token) == 1:
        return token == initials[0] and len(many) <= 2
    if len(many) > 1:
        return token.startswith(initials) and len(token) - len(initials) <= 4
    return len(many[0]) > 4 and token[0] == initials and token[1:] in _LEGAL_INITIALS


# First letters of the legal forms that follow in initials of a company's name.
_LEGAL_INITIALS = {"l", "i", "c", "g", "s", "cl", "jsc", "sa", "gmbh", "ltda", "ltd", "inc", "ag"}


def monge_elkan(a: list[str], b: list[str]) -> tuple[float, int]:
    """The mean over tokens of the similarity with the other name's tokens that they are matched with, and the letters that differ.

    0 where a token of either name is left without a counterpart.
    """
    a, b = _expand(a), _expand(b)
    if len(a) == 1 and len(b) == 1 and _HAN.search(a[0] + b[0]):
        return han_similarity(a[0], b[0])
    # Equal tokens are each other's counterparts; only the rest is compared.
    same = 0
    a, b = list(a), list(b)
    for token in list(a):
        if token in b:
            a.remove(token)
            b.remove(token)
            same += 1
    if not a and not b:
        return 1.0, 0
    if not a or not b:
        return 0.0, 99
    a, b = _join(a, b), _join(b, a)
    best = (0.0, 99)
    pairs = _assign(a, b)
    for strict in (False, True):  # initials may have been matched with single words: then only whole matches count
        kept = [p for p in pairs if not strict or p[2] >= 0.8 and min(len(a[p[0]]), len(b[p[1]])) > 3]
        rest_a = [t for i, t in enumerate(a) if i not in {p[0] for p in kept}]
        rest_b = [t for j, t in enumerate(b) if j not in {p[1] for p in kept}]
        scores, letters = [1.0] * same + [p[2] for p in kept], sum(p[3] for p in kept)
        if rest_a or rest_b:
            if not (len(rest_a) == 1 and rest_b and _covers(rest_a[0], rest_b) or len(rest_b) == 1 and rest_a and _covers(rest_b[0], rest_a)):
                continue
            scores += [1.0] * max(len(rest_a), len(rest_b))
        score = sum(scores) / len(scores) if scores else 0.0
        if score > best[0] or (score == best[0] and letters < best[1]):
            best = (score, letters)
    return best


def han_similarity(a: str, b: str) -> tuple[float, int]:
    """Of two names in Chinese characters: one is the other's abbreviation (characters in order, the first ones kept), or two neighbours are swapped."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)

    def within(x: str) -> bool:
        rest = iter(long)
        return x[:3] == long[:3] and len(x) > 3 and all(c in rest for c in x)

    if short == long or within(short):
        return 1.0, 0
    for i in range(min(3, len(short) - 1)):
        swapped = short[:i] + short[i + 1] + short[i] + short[i + 2 :]
        if swapped == long or within(swapped):
            return 0.9, 1
    return 0.0, 99


def same_party(a: list[str], b: list[str]) -> tuple[float, int]:
    """The similarity of two folded names and the letters that differ; 0 where they can't be the same party.

    One letter may differ, or two in long names. Whether a name that differs is a slip or another party is decided by
    how many spellings stand behind each (``parties``).
    """
    score, letters = monge_elkan(a, b)
    allowed = 2 if min(len("".join(a)), len("".join(b))) >= 20 else 1
    return (score, letters) if score >= MONGE_ELKAN and letters <= allowed else (0.0, 0)


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes that find a pair of this Jaccard similarity with this probability: 1-(1-s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def grams(tokens: list[str]) -> set[str]:
    """The padded q-grams of all tokens; their order doesn't matter."""
    out = set()
    for token in tokens:
        padded = f"^{token}$"
        # A Chinese character is a word's part: single ones and pairs.
        for q in (1, 2) if _HAN.search(token) else (Q,):
            out |= {padded[i : i + q] for i in range(max(1, len(padded) - q + 1))}
    out -= {"^", "$"}
    return out


@F.pandas_udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("grams", T.ArrayType(T.StringType()))]))
def _fold(names: pd.Series) -> pd.DataFrame:
    folded = [fold(n) for n in names]
    return pd.DataFrame({"tokens": folded, "grams": [sorted(grams(x)) for x in folded]})


def _signer(bands: int, rows: int):
    salts = [np.uint64(x) for x in np.random.default_rng(7).integers(1, 2**63, bands * rows, dtype=np.uint64)]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(gram_lists: pd.Series) -> pd.Series:
        """Weighted MinHash: each gram rings a clock of its weight per hash, the first to ring is the minimum."""
        from xxhash import xxh3_64_intdigest

        out = []
        for entries in gram_lists:
            ids = np.fromiter((xxh3_64_intdigest(e["gram"]) for e in entries), dtype=np.uint64, count=len(entries))
            weight = np.fromiter((e["weight"] for e in entries), dtype=float, count=len(entries))
            x = ids[:, None] ^ np.array(salts, dtype=np.uint64)[None, :]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            uniform = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54
            first = ids[(-np.log(uniform) / weight[:, None]).argmin(axis=0)].reshape(bands, rows)
            mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5][:rows], dtype=np.uint64)
            keys = (first * mix).sum(axis=1) + np.arange(bands, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)
            out.append(keys.view(np.int64))
        return pd.Series(out)

    return sign


@F.pandas_udf(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("letters", T.IntegerType())]))
def _verify(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([same_party(list(x), list(y)) for x, y in zip(a, b)], columns=["similarity", "letters"])


def star_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, center``: stars around the nodes of most weight.

    Each round, a free node that outranks its free neighbours (by weight, links, then id) becomes a center and takes them;
    a node between two centers goes to the more similar. Stars can't chain: members link to their center, not to each other.
    The free node of the highest rank is a center in any round, so the rounds go on until none is free. ``nodes`` has node,
    weight; ``links`` has a, b, similarity in both directions.
    """
    free = nodes.join(links.groupBy("a").count(), F.col("node") == F.col("a"), "left").select("node", F.struct("weight", F.coalesce("count", F.lit(0)).alias("links"), "node").alias("rank"))
    free = cut_lineage(free)
    done = None
    while True:
        ranked = links.join(free.select(F.col("node").alias("b"), F.col("rank").alias("rank_b")), "b").groupBy("a").agg(F.max("rank_b").alias("top"))
        state = free.join(ranked, F.col("node") == F.col("a"), "left")
        centers = state.where(F.col("top").isNull() | (F.col("rank") > F.col("top"))).select("node")
        taken = links.join(centers.select(F.col("node").alias("b")), "b").join(free.select(F.col("node").alias("a")), "a", "left_semi").groupBy("a").agg(F.max(F.struct("similarity", "b")).alias("best"))
        step = centers.select("node", F.col("node").alias("center")).unionByName(taken.select(F.col("a").alias("node"), F.col("best.b").alias("center")))
        step = cut_lineage(step)
        done = step if done is None else done.unionByName(step)
        free = cut_lineage(free.join(step.select("node"), "node", "left_anti"))
        if free.isEmpty():
            return done


def candidates(keys: DataFrame) -> DataFrame:
    """``a, b``: the distinct pairs of nodes (a < b) that share a key; ``keys`` has node, key.

    A key of many nodes is dealt into blocks and every pair of blocks is a group of its own.
    """
    blocks = keys.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = keys.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Each node meets the block pairs (its own, any), in order.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = dealt.select("key", "node", "block", other).select("key", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    x, y = placed.alias("x"), placed.alias("y")
    meet = x.join(y, ["key", "i", "j"]).where((F.col("x.node") < F.col("y.node")) & ((F.col("i") == F.col("j")) | (F.col("x.block") != F.col("y.block"))))
    return meet.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def spark_partitions(df: DataFrame) -> int:
    """As many partitions as the session shuffles into: pairs are few but each takes its time, so they mustn't be merged by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parties(names: DataFrame) -> DataFrame:
    """``name, party``: each distinct non-blank string of column name with the party it names.

    Nulls and blank strings have no row; repeated rows count once; strings without letters are parties of their own.
    """
    bands = bands_for(SIMILARITY, ROWS, RECALL)
    distinct = names.select("name").where(F.trim("name") != "").distinct()
    folded = distinct.select("name", _fold("name").alias("r"))
    # What folds alike is one node; a name of nothing but form is a node of its own.
    node = F.when(F.size("r.tokens") > 0, F.xxhash64(F.array_join("r.tokens", " "))).otherwise(F.xxhash64("name"))
    parsed = cut_lineage(folded.select("name", node.alias("node"), "r.*"))
    nodes = cut_lineage(parsed.groupBy("node").agg(F.count("*").alias("spellings"), F.first("tokens").alias("tokens"), F.first("grams").alias("grams")))
    total = nodes.count()
    held = nodes.select("node", F.explode("grams").alias("gram"))
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.pow(F.least(F.lit(1.0), F.lit(max(COMMON * total, COMMON_NAMES)) / F.col("count")), 2))
    sharp = F.greatest(F.lit(SHARP_WEIGHT), F.pow(F.least(F.lit(1.0), F.lit(max(SHARP * total, SHARP_NAMES)) / F.col("count")), 2))
    weighed = held.join(held.groupBy("gram").count(), "gram").groupBy("node").agg(F.collect_list(F.struct("gram", weight.alias("weight"))).alias("w"), F.collect_list(F.struct("gram", sharp.alias("weight"))).alias("sharp"))
    weighed = cut_lineage(weighed.join(nodes.select("node", "tokens"), "node"))
    pairs = candidates(weighed.select("node", F.explode(_signer(bands, ROWS)("w")).alias("key")))
    sum_of = lambda x: F.aggregate(x, F.lit(0.0), lambda t, e: t + e["weight"])
    side = lambda s: weighed.select(F.col("node").alias(s), F.col("tokens").alias(f"tokens_{s}"), F.col("sharp").alias(f"sharp_{s}"), sum_of(F.col("sharp")).alias(f"sum_{s}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(sum_of(F.array_intersect("sharp_a", "sharp_b")) >= SHARED * F.least("sum_a", "sum_b"))
    scored = likely.repartition(spark_partitions(likely)).select("a", "b", _verify("tokens_a", "tokens_b").alias("v")).select("a", "b", "v.*").where("similarity > 0")
    links = cut_lineage(scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "letters")))
    # Spellings that differ by form alone stand behind a node; a slip has few of them beside the name it comes from.
    behind = nodes.select("node", "spellings").join(links.where("letters = 0").join(nodes.select(F.col("node").alias("b"), F.col("spellings").alias("of_b")), "b").groupBy(F.col("a").alias("node")).agg(F.sum("of_b").alias("more")), "node", "left")
    behind = cut_lineage(behind.select("node", (F.col("spellings") + F.coalesce("more", F.lit(0))).alias("weight")))
    w = lambda s: behind.select(F.col("node").alias(s), F.col("weight").alias(f"w_{s}"))
    slip = F.least("w_a", "w_b") <= F.greatest(F.lit(1.0), SLIP_SHARE * F.greatest("w_a", "w_b"))
    kept = links.join(w("a"), "a").join(w("b"), "b").where((F.col("letters") == 0) | slip).select("a", "b", "similarity")
    stars = star_clusters(behind, cut_lineage(kept))
    return parsed.join(stars, "node").select("name", F.col("center").alias("party"))


def found(feed: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of distinct strings of one party; its spellings are few, whatever the rows."""
    names = feed.select(F.explode(F.array("developer", "owner", "epc_contractor")).alias("name"))
    linked = cut_lineage(parties(names))
    return linked.alias("x").join(linked.alias("y"), "party").where(F.col("x.name") < F.col("y.name")).select(F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
