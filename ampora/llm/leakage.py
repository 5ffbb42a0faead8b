"""Held-out test passages inside corpus documents.

The test items are the stated query set: every window of ``WINDOW`` tokens of every item is embedded by CGK random walks, which turn
edit distance into Hamming distance, and bit sampling of the walk gives the LSH keys, repeated ``REPEATS`` times. The
tables of keys are built from the items, ``ITEM_BLOCK`` at a time (their number is fixed, not the corpus's), and broadcast to the
tasks; the corpus is read once a block, map-only: each document's windows, every ``STRIDE`` tokens, are embedded by the same walks, and
each window alike is verified exactly: the run of equal words there is extended both ways by the alignment of fewest edits
(furthest reaching points), however short the runs between edits. A stretch of half an item holds several windows, so a
replaced word leaves others whole: with windows of 8 tokens every 3, a stretch of 20 tokens holds four or more, and one replaced word
touches at most three of them. Items too short for that are searched by windows of 2 words or of one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE, REPEATS, SAMPLED, SEED = 8, 3, 3, 8, 11
SHARE, EDIT_SHARE = 0.5, 0.05
ITEM_BLOCK, FILTER_BITS = 10_000, 22  # items searched at once; bits of the filter before each table

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")


def tokens(text: str) -> list[str]:
    """Words, and the single characters of Chinese; case, width, punctuation and spacing fall away."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _TOKEN.findall(text.casefold())


class Vocabulary:
    """Numbers for the tokens of the items; any other token of the corpus is one that no item has."""

    def __init__(self, items: list[list[str]]):
        self.ids = {t: i for i, t in enumerate(sorted({t for item in items for t in item}), 1)}

    def encode(self, text_tokens: list[str]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(t, 0) for t in text_tokens), dtype=np.int32, count=len(text_tokens))


class Walks:
    """CGK embeddings of token windows and samples of their positions."""

    def __init__(self, vocabulary: int, window: int = WINDOW, repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.window, self.steps = window, 3 * window
        self.bits = rng.integers(0, 2, (repeats, self.steps, vocabulary + 2), dtype=np.int64)
        self.picks = [np.sort(rng.choice(self.steps // 2, sampled, replace=False)) for _ in range(repeats)]
        self.mix = rng.integers(1, 2**62, (repeats, sampled), dtype=np.uint64) | np.uint64(1)

    def keys(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """One array of keys per repeat; ``windows`` has a row per window."""
        n = len(windows)
        padded = np.concatenate([windows, np.full((n, 1), -1, windows.dtype)], axis=1) + 1
        rows = np.arange(n)
        for bits, picks, mix in zip(self.bits, self.picks, self.mix):
            at = np.zeros(n, dtype=np.int64)
            key = np.zeros(n, dtype=np.uint64)
            sampled = dict(zip(picks.tolist(), mix))
            for j in range(int(picks[-1]) + 1):
                token = padded[rows, at]
                if j in sampled:
                    key += (token.astype(np.uint64) + np.uint64(1)) * sampled[j]
                    key ^= key >> np.uint64(29)
                at = np.minimum(at + bits[j][token], self.window)
            yield key


def _reach(doc: list[int], item: list[int], d: int, i: int, step: int, most: int, indels: bool) -> list[int]:
    """Item tokens that an alignment from (d, i) on, in direction ``step``, covers with 0, 1, ... ``most`` edits and a match at its end.

    Furthest reaching points on diagonals: one edit replaces a word or, with ``indels``, skips or adds one.
    """
    n, m = len(doc), len(item)

    def slide(x: int, y: int) -> int:
        k = 0
        while 0 <= x < n and 0 <= y < m and item[y] and doc[x] == item[y]:
            x, y, k = x + step, y + step, k + 1
        return k

    at = {0: slide(d, i)}  # per diagonal (doc tokens less item tokens) the item tokens covered
    out = [at[0]]
    for _ in range(most):
        then: dict[int, int] = {}
        best = out[-1]
        for diagonal, covered in at.items():
            for shift, more in ((0, 1), (1, 0), (-1, 1)) if indels else ((0, 1),):
                then[diagonal + shift] = max(then.get(diagonal + shift, 0), covered + more)
        for diagonal, covered in then.items():
            run = slide(d + step * (covered + diagonal), i + step * covered)
            then[diagonal] = covered + run
            if run and covered + run > best:
                best = covered + run
        at = then
        out.append(best)
    return out


def longest_match(doc: list[int], item: list[int], hits: list[tuple[int, int]], window: int = WINDOW, edit_share: float = EDIT_SHARE, indels: bool = False) -> int:
    """Tokens of the longest unbroken stretch of ``item`` around ``hits`` that ``doc`` repeats with at most this share of edits.

    One edit is always allowed; an edit replaces a word, or skips or adds one with ``indels``. ``hits`` are places (in doc, in item) of windows that the search found alike; every run of equal words in
    them, or beside them by one, is extended both ways by the alignment of fewest edits.
    """
    most = max(1, int(len(item) * edit_share))
    best, done = 0, {}  # per diagonal the item's place behind the last run that was extended
    for d, i in hits:
        for shift in (0, 1, -1) if indels else (0,):
            diagonal = d + shift - i
            for y in range(max(i, done.get(diagonal, 0)), i + window):
                x = y + diagonal
                if y < done.get(diagonal, 0) or not (0 <= x < len(doc) and y < len(item) and item[y] and doc[x] == item[y]):
                    continue
                right = _reach(doc, item, x, y, 1, most, indels)
                left = _reach(doc, item, x - 1, y - 1, -1, most, indels)
                for a, before in enumerate(left):
                    for b, after in enumerate(right[: most - a + 1]):
                        if before + after > best and a + b <= max(1, (before + after) * edit_share):
                            best = before + after
                done[diagonal] = y + right[0]
    return best


def _likely(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Which places lie on a diagonal with as many equal words as half of the item, less its edits, needs."""
    lines, which = np.unique(diagonals, return_inverse=True)
    need = SHARE * len(item) - max(1, int(len(item) * EDIT_SHARE))
    enough = np.zeros(len(lines), dtype=bool)
    for at in range(0, len(lines), 256):
        place = lines[at : at + 256, None] + np.arange(len(item))
        inside = (place >= 0) & (place < len(doc))
        equal = inside & (doc[np.clip(place, 0, len(doc) - 1)] == item) & (item > 0)
        enough[at : at + 256] = equal.sum(axis=1) >= need
    return enough[which]


class _Family:
    """The LSH tables of the items whose halves hold windows of one size."""

    def __init__(self, window: int, stride: int, encoded: list[np.ndarray], chosen: list[int], vocabulary: int):
        self.window, self.stride = window, stride
        self.walks = Walks(vocabulary, window, sampled=min(SAMPLED, max(1, 3 * window // 2)))
        windows = [np.lib.stride_tricks.sliding_window_view(encoded[k], window) for k in chosen]
        stacked = np.concatenate(windows)
        owner = np.concatenate([np.full(len(w), k, dtype=np.int64) for k, w in zip(chosen, windows)])
        place = np.concatenate([np.arange(len(w)) for w in windows])
        self.tables, self.filters = [], []
        for keys in self.walks.keys(stacked):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], owner[order], place[order]))
            seen = np.zeros(1 << FILTER_BITS, dtype=bool)
            seen[(keys >> np.uint64(7)) & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.filters.append(seen)

    def hits(self, texts: list[np.ndarray]) -> pd.DataFrame:
        """The windows alike: text, item, place in the text, place in the item; in this order, each once."""
        parts, owner, place = [], [], []
        for d, x in enumerate(texts):
            n = len(x)
            if n < self.window:
                continue
            at = np.arange(0, n - self.window + 1, self.stride)
            if at[-1] != n - self.window:
                at = np.append(at, n - self.window)
            w = np.lib.stride_tricks.sliding_window_view(x, self.window)[at]
            # A window with two words that no item has can't be the exact repeat of one, nor one with a single replaced word.
            known = (w == 0).sum(axis=1) <= min(1, self.window - 1)
            if known.any():
                parts.append(w[known])
                place.append(at[known])
                owner.append(np.full(int(known.sum()), d, dtype=np.int64))
        if not parts:
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in "dkxy"})
        stacked, owner_of, place_of = np.concatenate(parts), np.concatenate(owner), np.concatenate(place)
        found = []
        for keys, (known, items, offsets), seen in zip(self.walks.keys(stacked), self.tables, self.filters):
            hit = np.flatnonzero(seen[(keys >> np.uint64(7)) & np.uint64((1 << FILTER_BITS) - 1)])
            left, right = np.searchsorted(known, keys[hit], "left"), np.searchsorted(known, keys[hit], "right")
            many = right - left
            row = np.repeat(hit, many)
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)
            found.append(np.stack([owner_of[row], items[entry], place_of[row], offsets[entry]], axis=1))
        return pd.DataFrame(np.concatenate(found), columns=list("dkxy"))


class Index:
    """The items of one block, encoded, and their LSH tables: all that a task needs."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(k, tokens(t)) for k, t in items]
        split = [(k, t) for k, t in split if t]
        self.ids = [k for k, _ in split]
        self.vocabulary = Vocabulary([t for _, t in split])
        self.encoded = [self.vocabulary.encode(t) for _, t in split]
        self.lists = [x.tolist() for x in self.encoded]
        self.families = []
        left = list(range(len(split)))
        for window, stride in ((WINDOW, STRIDE), (2, 1), (1, 1)):
            # A half with one replaced word must still hold a window whole, wherever the stride falls.
            enough = {k for k in left if window == 1 or -(-len(self.encoded[k]) // 2) >= 2 * (window + stride - 1)}
            if enough:
                self.families.append(_Family(window, stride, self.encoded, sorted(enough), len(self.vocabulary.ids)))
            left = [k for k in left if k not in enough]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """``(text, item id, share)`` of every text that repeats at least half of an item."""
        encoded = [self.vocabulary.encode(tokens(t)) for t in texts]
        for family in self.families:
            hits = family.hits(encoded)
            pairs = hits[["d", "k"]].drop_duplicates().sort_values(["d", "k"])
            present, of, kept = np.zeros(len(self.vocabulary.ids) + 1, dtype=bool), -1, []
            for d, k in pairs.itertuples(index=False):
                if d != of:
                    present[:], of = False, d
                    present[encoded[d]] = True
                    present[0] = False
                # A text that lacks more of the item's words than half of it with all its edits could isn't aligned.
                n = len(self.lists[k])
                kept.append(present[self.encoded[k]].sum() >= SHARE * n - max(1, int(n * EDIT_SHARE)))
            hits = hits.merge(pairs[np.array(kept, dtype=bool)], on=["d", "k"]).drop_duplicates().sort_values(["d", "k", "x", "y"])
            of, doc = -1, []
            d_of, k_of, x_of, y_of = (hits[c].to_numpy() for c in "dkxy")
            ends = np.flatnonzero(np.append((np.diff(d_of) != 0) | (np.diff(k_of) != 0), True)) + 1 if len(hits) else []
            for begin, end in zip([0, *ends[:-1]], ends):
                d, k = int(d_of[begin]), int(k_of[begin])
                x, y = x_of[begin:end], y_of[begin:end]
                likely = _likely(encoded[d], self.encoded[k], x - y)
                if not likely.any():
                    continue
                if d != of:
                    of, doc = d, encoded[d].tolist()
                n = longest_match(doc, self.lists[k], list(zip(x[likely].tolist(), y[likely].tolist())), family.window)
                if n >= SHARE * len(self.lists[k]):
                    yield d, self.ids[k], n / len(self.lists[k])


def _search(index):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 400):
                part = batch.iloc[begin : begin + 400]
                ids = part["doc_id"].tolist()
                if out := [(k, ids[d], share) for d, k, share in index.value.matches(part["text"].tolist())]:
                    yield pd.DataFrame(out, columns=["item_id", "doc_id", "share"])

    return search


def leaked(documents: DataFrame, items: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """``item_id, doc_id, share``: every document that repeats at least half of an item unbroken.

    Null and empty texts match nothing; an item that stands twice in a document comes out once; equal items each come
    out. ``items`` is the held-out set, whose size doesn't depend on the corpus; it is searched in blocks of ``block`` items, so the
    tables that are broadcast have a fixed size. Needs doc_id, text and item_id, text; an empty table gives an empty one.
    """
    docs = documents.select("doc_id", "text").where(F.length("text") > 0)
    sc, out, known = documents.sparkSession.sparkContext, None, []

    def searched(rows: list[tuple[int, str]]) -> DataFrame:
        part = docs.mapInPandas(_search(sc.broadcast(Index(rows))), "item_id long, doc_id long, share double")
        return part if out is None else out.unionByName(part)

    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        known.append((r["item_id"], r["text"]))
        if len(known) == block:
            out, known = searched(known), []
    return searched(known) if known or out is None else out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaked(documents, items).select("item_id", "doc_id")
