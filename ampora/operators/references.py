"""Documents that agree best with reference rows.

What the rows name is looked for in all documents at once (``search``). Of a slice of documents each name then is a row of zeros and
ones, and the points of all references are sums of such rows. A task keeps each reference's best documents and gives them at its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ampora.operators.search import Search, buffers

LEAST = 20  # points that a document must have more than
CELLS = 1 << 22  # references times documents whose points are held at once


def _rows(values: list[str | None], of: dict[str, int]) -> np.ndarray:
    return np.array([of.get(v, -1) for v in values], np.int64)


def best_documents(known, best: int):
    """A function of record batches (doc_id, d_host, w) to ``row_id, doc_id, points`` by the broadcast references (row_id, tokens, country, address, owner, host)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = known.value
        n = len(refs)
        tokens = refs["tokens"].to_pylist()
        order = sorted(range(n), key=lambda i: -len(tokens[i]))  # the first have most tokens
        tokens = [tokens[i] for i in order]
        country, address, owner, host = ([x[i] for i in order] for x in map(lambda c: refs[c].to_pylist(),  ("country", "address", "owner", "host")))
        texts = sorted({t for ts in tokens for t in ts} | {x for c in (country, address, owner) for x in c if x})
        search, at = Search(texts), {t: i for i, t in enumerate(texts)}
        hosts = sorted({h for h in host if h is not None})
        host_at = {h: len(texts) + i for i, h in enumerate(hosts)}
        host_set = pa.array(hosts, pa.string())
        # Row -1 of the marks stays empty: for what a reference doesn't state.
        country, address, owner, host = _rows(country, at), _rows(address, at), _rows(owner, at), _rows(host, host_at)
        nth = [np.array([at[ts[k]] for ts in tokens if len(ts) > k], np.int64) for k in range(len(tokens[0]) if n else 0)]
        kind = np.uint8 if len(nth) < 255 else np.uint16 if len(nth) < 65_535 else np.uint32
        needed = np.array([next((h for h in range(max(0, math.floor(0.45 * len(ts)) - 1), len(ts) + 1) if ts and h / len(ts) >= 0.45), np.iinfo(kind).max) for ts in tokens], kind)
        wide = max(16, CELLS // max(1, n))
        state, fifth = None, np.zeros(n, np.uint8)
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))
            size = len(batch)
            doc, text = search.find(*buffers(batch.column("w")))
            d_host = pc.fill_null(pc.index_in(batch.column("d_host").cast(pa.string()), value_set=host_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            above = np.maximum(fifth, LEAST + 1) - 1  # equal points may come with a lower doc_id
            top, place = np.zeros((n, best), np.uint8), np.zeros((n, best), np.int64)
            for s in range(0, size, wide):
                m = min(wide, size - s)
                marks = np.zeros((len(texts) + len(hosts) + 1, m), np.uint8)
                lo, hi = np.searchsorted(doc, (s, s + m))
                marks[text[lo:hi], doc[lo:hi] - s] = 1
                of = np.flatnonzero(d_host[s : s + m] >= 0)
                marks[len(texts) + d_host[s + of], of] = 1
                held = np.zeros((n, m), kind)
                for rows in nth:
                    held[: len(rows)] += marks[rows]
                points = (held >= needed[:, None]).view(np.uint8) * np.uint8(20)
                points += (marks[country] | marks[address]) * np.uint8(15)
                points += marks[owner] * np.uint8(15)
                points += marks[host] * np.uint8(5)
                # Documents come in order, so later ones have to have more points.
                new = np.flatnonzero(points.max(axis=1, initial=0) > np.maximum(above, top[:, -1]))
                if len(new):
                    both = np.concatenate([top[new], np.where(points[new] > above[new, None], points[new], 0).astype(np.uint8)], axis=1)
                    first = np.argsort(255 - both, axis=1, kind="stable")[:, :best]
                    top[new] = np.take_along_axis(both, first, 1)
                    place[new] = np.where(first < best, np.take_along_axis(place[new], np.minimum(first, best - 1), 1), s + first - best)
            r, c = np.nonzero(top)
            add = pa.table({"ref": r, "doc_id": batch.column("doc_id").take(pa.array(place[r, c])), "points": top[r, c].astype(np.int32)})
            state = add if state is None else pa.concat_tables([state, add])
            state = state.take(pc.sort_indices(state, [("ref", "ascending"), ("points", "descending"), ("doc_id", "ascending")]))
            ref = state["ref"].to_numpy()
            rank = np.arange(len(ref)) - np.searchsorted(ref, ref)
            state = state.filter(pa.array(rank < best)).combine_chunks()
            last = rank == best - 1
            fifth[ref[last]] = state["points"].to_numpy()[(rank[rank < best] == best - 1)]
        if state is not None:
            back = pa.array(np.array(order, np.int64)[state["ref"].to_numpy()])
            yield from pa.table({"row_id": refs["row_id"].take(back), "doc_id": state["doc_id"], "points": state["points"]}).to_batches(max_chunksize=10_000)

    return run
