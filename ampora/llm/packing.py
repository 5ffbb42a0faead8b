"""Texts packed into containers of fixed capacity.

Vector bin packing by the dot-product heuristic: an open container takes, of all pieces that fit its three remaining limits
(tokens, segments, loss-bearing tokens), the one whose demand has the largest dot product with what remains, until none
fits. A text is one piece unless it is longer than a container; then it is cut into full containers and a rest, which is
packed like any other. A container of instruction data has limits of its own on segments (attention blocks) and on loss-bearing
tokens (answers): ``min_segment`` and ``loss_share`` say how many of each a capacity allows. Pieces are dealt to shards by a hash, about ``SHARD`` to each, so that a task packs a bounded number
whatever the corpus; the space lost by that is at most part of one container in each shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampora.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SHARD = 4096
MIN_SEGMENT = 128  # tokens per segment that the limit on segments allows for: capacity // MIN_SEGMENT segments
LOSS_SHARE = 0.98  # of the capacity that may be loss-bearing

PLACED = "spec_id int, container_id long, doc_id long, piece int, first_token long, tokens long"


@lru_cache(4)
def encoding(path: str):
    """The byte-level BPE of a rank file; the split pattern is that of the ``public_tokenizers`` module beside it, where installed."""
    import base64

    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens, loss`` of every text; loss leaves out the first line, which the rest answers to. Null texts have no row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for batch in batches:
            total, loss = [], []
            for text in batch["text"]:
                head, newline, _ = text.partition("\n")
                n = len(enc.encode_ordinary(text))
                total.append(n)
                loss.append(n - len(enc.encode_ordinary(head)) if newline else n)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": total, "loss": np.maximum(loss, 0)})

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(count, "doc_id long, tokens long, loss long")


def pack(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container of each piece; rows of ``demand`` are pieces, columns the dimensions of ``limits``."""
    n = len(demand)
    out = np.full(n, -1, dtype=np.int64)
    share = demand / limits
    left = np.argsort(-share[:, 0], kind="stable")
    w = np.ascontiguousarray(share[left])
    container, opened = 0, False
    free = np.ones(demand.shape[1])
    while len(left):
        # Pieces stand by size, so those whose tokens fit are the last ones.
        start = int(np.searchsorted(-w[:, 0], -(free[0] + 1e-12), side="left"))
        rest = w[start:]
        fits = (rest[:, 1:] <= free[1:] + 1e-12).all(axis=1)
        if not fits.any():
            if not opened:  # a piece that fits no container stands alone
                out[left[0]] = container
                left, w = left[1:], w[1:]
            container += 1
            free, opened = np.ones(demand.shape[1]), False
            continue
        i = start + int(np.where(fits, rest @ free, -1.0).argmax())
        out[left[i]] = container
        free = free - w[i]
        opened = True
        left, w = np.delete(left, i), np.delete(w, i, axis=0)
    return out


def limits_of(capacity: int, min_segment: int = MIN_SEGMENT, loss_share: float = LOSS_SHARE) -> np.ndarray:
    """The limits of a container: tokens, segments, loss-bearing tokens."""
    return np.array([capacity, max(1, capacity // min_segment), max(1.0, capacity * loss_share)], dtype=float)


def _packer(min_segment: int, loss_share: float):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        capacity = int(batch["capacity"].iloc[0])
        demand = np.stack([batch["tokens"], np.ones(len(batch)), batch["loss"]], axis=1).astype(float)
        container = pack(demand, limits_of(capacity, min_segment, loss_share))
        # The full containers that the pieces before the rest of a long text fill.
        whole = batch["piece"].to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(batch)), whole)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        ids = np.concatenate([container, container.max() + 1 + np.arange(len(owner))])
        rows = np.concatenate([np.arange(len(batch)), owner])
        pieces = np.concatenate([whole, piece])
        tokens = np.concatenate([batch["tokens"].to_numpy(), np.full(len(owner), capacity)])
        return pd.DataFrame({"spec_id": batch["spec_id"].to_numpy()[rows], "container_id": ids * (1 << 24) + int(batch["shard"].iloc[0]), "doc_id": batch["doc_id"].to_numpy()[rows], "piece": pieces, "first_token": pieces * capacity, "tokens": tokens})

    return run


def containers(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER, min_segment: int = MIN_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """``spec_id, container_id, doc_id, piece, first_token, tokens``: the containers of each capacity.

    Every token of every text stands in one container of each spec; a text or part of one that breaks a limit by itself stands alone; empty texts take a segment without tokens; equal texts
    are packed each. ``specs`` is a short list of capacities. An empty table gives an empty one. Copies of a container number
    within a spec don't occur: it names the shard and the container in it.
    """
    wanted = [(int(r["spec_id"]), int(r["capacity_tokens"])) for r in specs.select("spec_id", "capacity_tokens").collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    counted = token_counts(documents, tokenizer)
    if not wanted:
        return counted.sparkSession.createDataFrame([], PLACED)
    counted = cut_lineage(counted)  # three numbers a text; the texts are read once
    total = counted.count()
    shards = max(1, -(-total // SHARD))
    spec = F.explode(F.array(*(F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in wanted)))
    each = counted.select("doc_id", "tokens", "loss", spec.alias("s")).select("s.*", "doc_id", "tokens", "loss")
    # A longer text is cut into full containers and a rest that is packed; a rest of nothing is a full container more.
    whole = F.when(F.col("tokens") > F.col("capacity"), F.floor((F.col("tokens") - 1) / F.col("capacity"))).otherwise(0).cast("int")
    rest = F.col("tokens") - F.col("_whole") * F.col("capacity")
    pieces = each.withColumn("_whole", whole).select("spec_id", "capacity", "doc_id", F.col("_whole").alias("piece"), rest.alias("tokens"), F.least(F.col("loss"), rest).alias("loss"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    # A fixed number of partitions: groups are small but take their time, so they mustn't be merged by size.
    dealt = pieces.repartition(2 * shards * len(wanted), "spec_id", "shard")
    return dealt.groupBy("spec_id", "shard").applyInPandas(_packer(min_segment, loss_share), PLACED)


def fill(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, containers, tokens, fill``: how full the containers are."""
    per = placed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select("spec_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
