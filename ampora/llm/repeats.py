"""Lines repeated across the documents of one source.

The letters of a whole text, across its line ends, are cut by content: a rolling hash over ``WINDOW`` letters sets a boundary
wherever its low bits are zero, so a repeated passage is cut alike wherever it stands and however its lines are broken. Chunks are
hashed, the distinct documents of each chunk and source are counted (partial counts before the shuffle), and chunks repeated
excessively are kept: ``repeated_chunks``. A repeated line's own whole chunks are repeated, so only lines whose first and last
whole chunk are (and lines too short to hold one) go on to the exact count of documents per line; paragraphs never reach its
shuffle. ``without_repeats`` cuts the repeated lines out. Only the small tables of repeated chunks and lines meet the
lines again, so a source or a legal notice of a third of all rows needs no task of its own.

Lines and chunks are compared by 64-bit hashes of their letters: two different ones agree with a probability of 2^-64 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampora.session import cut_lineage

WINDOW, MASK = 8, 31  # a boundary every 32 letters on average
MIN_DOCUMENTS, MIN_SHARE = 3, 0.05
BROADCAST_KEYS = 1_000_000  # repeated chunks (16 bytes each) that are broadcast; beyond, they are joined with salts
SALTS = 32

_OTHER = re.compile(r"[^\w\n]+|[\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def letters(text: str) -> list[str]:
    """The lines of ``text`` as their letters alone, without case."""
    return _OTHER.sub("", text.casefold()).split("\n")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def cut(lines: list[str], first_of_text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks of the letters of lines: start, end, whether content set the end, and hash of each chunk; start, end and hash of each line.

    ``first_of_text`` marks the lines that begin a text; only there do chunks start anew.
    """
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(chars)
    codes = _mix(chars + np.uint64(1))
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        rolled[k:] += codes[: n - k] * _powers(_PRIME, k)[k]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    bounds = np.zeros(n + 1, dtype=bool)
    bounds[1:] = (_mix(rolled) & np.uint64(MASK)) == 0
    begin = starts[first_of_text]
    # A window must lie inside its text.
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    bounds[1:][place < WINDOW - 1] = False
    by_content = bounds.copy()
    bounds[begin] = True
    bounds[n] = True
    bounds[0] = False
    stops = np.flatnonzero(bounds)
    begins = np.concatenate(([0], stops[:-1])) if len(stops) else stops
    prefix = np.zeros(n + 1, dtype=np.uint64)
    power = _powers(_PRIME, n)
    np.cumsum(codes * power[:-1], out=prefix[1:])
    inverse = _powers(_INVERSE, n)
    span = lambda a, b: _mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))
    return begins, stops, by_content[stops], span(begins, stops), starts, ends, span(starts, ends)


_LINES = "_source long, doc_id long, line_no int, line long, fresh_line boolean, whole boolean, chunk long, last_chunk long, fresh_chunks array<long>"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per line with letters, and a row of number 0 per document with the chunks that no line holds whole.

    A chunk is whole in a line where the line holds its letters and the window before its start, so that they alone set both of
    its boundaries.
    """
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            split = [letters(t) for t in part["text"]]
            counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            owner = np.repeat(np.arange(len(split)), counts)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            begins, stops, by_content, chunk, starts, ends, key = cut([x for lines in split for x in lines], np.cumsum(counts) - counts)
            kept = np.flatnonzero(ends > starts)
            line_of = kept[np.searchsorted(ends[kept], stops, side="left")]
            # Of a text's equal chunks and lines only the first counts its document.
            fresh = ~pd.DataFrame({"o": owner[line_of], "h": chunk}).duplicated().to_numpy()
            fresh_line = ~pd.DataFrame({"o": owner[kept], "h": key[kept]}).duplicated().to_numpy()
            # The whole chunks of a line: from a window after its start on, to its end at the latest, unless only the text's end cut there.
            first = np.searchsorted(begins, starts[kept] + WINDOW, side="left")
            last = np.searchsorted(stops, ends[kept], side="right")
            last -= (stops[last - 1] == ends[kept]) & ~by_content[last - 1] & (last > 0)
            whole = last > first
            held = np.zeros(len(chunk) + 1, dtype=np.int64)
            np.add.at(held, first[whole], 1)
            np.add.at(held, last[whole], -1)
            signed, source, ids = chunk.view(np.int64), part["_source"].to_numpy(), part["doc_id"].to_numpy()
            ranges = [signed[a:b][fresh[a:b]] if b > a else signed[:0] for a, b in zip(first, last)]
            loose = np.flatnonzero((np.cumsum(held[:-1]) == 0) & fresh)
            at_text = np.searchsorted(owner[line_of[loose]], np.arange(len(split) + 1))
            rest = [signed[loose[a:b]] for a, b in zip(at_text[:-1], at_text[1:])]
            none = np.zeros(len(split), dtype=np.int64)
            ending = lambda which: np.concatenate([np.where(whole, signed[np.clip(which, 0, max(0, len(signed) - 1))], 0) if len(kept) else none[:0], none])
            yield pd.DataFrame(
                {
                    "_source": source[np.concatenate([owner[kept], np.arange(len(split))])],
                    "doc_id": ids[np.concatenate([owner[kept], np.arange(len(split))])],
                    "line_no": np.concatenate([number[kept], none]).astype(np.int32),
                    "line": np.concatenate([key[kept].view(np.int64), none]),
                    "fresh_line": np.concatenate([fresh_line, none.astype(bool)]),
                    "whole": np.concatenate([whole, none.astype(bool)]),
                    "chunk": ending(first),
                    "last_chunk": ending(last - 1),
                    "fresh_chunks": ranges + rest,
                }
            )


def cut_documents(documents: DataFrame) -> DataFrame:
    """The lines of ``documents`` (doc_id, source_id, text) with their chunks, read once and written to the shared folder."""
    docs = documents.select(F.xxhash64("source_id").alias("_source"), "doc_id", "text").where(F.col("text").isNotNull())
    return cut_lineage(docs.mapInPandas(_lines, _LINES))


def _often(rows: DataFrame, lines: DataFrame, key: str, min_documents: int, min_share: float) -> DataFrame:
    """``_source``, key and documents of the keys that stand in enough documents of their source."""
    counts = rows.groupBy("_source", key).agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents)
    # One row per source; its document rows are those of line number 0.
    needed = lines.where("line_no = 0").groupBy("_source").agg((F.count("*") * min_share).alias("needed"))
    return counts.join(needed, "_source").where(F.col("documents") >= F.col("needed") - 1e-9).select("_source", key, "documents")


def repeated_chunks(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``_source, chunk, documents`` of the chunks of ``cut_documents`` that are repeated excessively within their source."""
    return _often(lines.select("_source", F.explode("fresh_chunks").alias("chunk")), lines, "chunk", min_documents, min_share)


def repeated_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, line_no`` of lines that stand in ``min_documents`` documents and in ``min_share`` of those of their source.

    Needs doc_id, source_id and text. Null texts aren't counted; documents without a source form one of their own; a line
    without letters is no case; a line that a document repeats counts once but all its places come out. An empty
    table gives an empty one.
    """
    lines = cut_documents(documents)
    chunks = cut_lineage(repeated_chunks(lines, min_documents, min_share).select("_source", "chunk"))
    own = lines.where("line_no > 0").drop("fresh_chunks")
    held = own.where("whole")
    candidates = _of(_of(held, chunks, "chunk"), chunks.withColumnRenamed("chunk", "last_chunk"), "last_chunk").unionByName(own.where("NOT whole"))
    repeated = cut_lineage(_often(candidates.where("fresh_line"), lines, "line", min_documents, min_share).select("_source", "line"))
    return _of(candidates, repeated, "line").select("doc_id", "line_no")


def _of(lines: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``lines`` whose (source, name) is among ``keys``: broadcast up to a checked size, beyond it joined with salts."""
    if keys.count() <= BROADCAST_KEYS:
        return lines.join(F.broadcast(keys), ["_source", name], "left_semi")
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["_source", name, "_salt"], "left_semi").drop("_salt")


def without_repeats(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``documents`` with column ``kept_text``: the text without its repeated lines."""
    cases = repeated_lines(documents, min_documents, min_share).groupBy("doc_id").agg(F.collect_set("line_no").alias("_cut"))
    joined = documents.join(cases, "doc_id", "left")
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(line.alias("line"), (i + 1).cast("int").alias("n")))
    kept = F.filter(numbered, lambda x: F.col("_cut").isNull() | ~F.array_contains(F.col("_cut"), x["n"]))
    return joined.withColumn("kept_text", F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).drop("_cut")
