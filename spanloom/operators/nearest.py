"""Most similar sets of one block, for use in tasks: an inverted index, read from rare elements to frequent ones."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

FIRST_READ = 256  # entries of the index read before a query's first bound


def _elements(joined: pd.Series) -> pa.ChunkedArray | pa.Array:
    texts = pa.array(joined, pa.large_string())
    return pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.large_string()), texts), ",")


def nearest_sets(texts: pd.DataFrame, queries: pd.DataFrame, top_n: int, min_sim: float | None) -> Iterator[tuple[int, int, float]]:
    """(qid, tid, Jaccard similarity) of each query's best texts, best first, ties by ``first``, until they hold ``top_n`` ids;
    of the last similarity ``top_n`` texts at most, because ids of equally similar texts mix.

    ``grams`` are distinct elements joined by commas; a text holds ``n`` ids, the least of them ``first``.  Similarities
    must exceed ``min_sim``; without it, texts that share nothing are taken when others don't suffice.

    A text that shares none of a query's p rarest elements shares at most the others, so reading stops as soon as those
    can't lead to the similarity that has been reached.
    """
    texts = texts.sort_values("first", kind="stable")
    t, q = _elements(texts["grams"]), _elements(queries["grams"])
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (t, q)]
    codes = pa.chunked_array([pc.list_flatten(t), pc.list_flatten(q)]).combine_chunks()
    codes = pc.dictionary_encode(codes).indices.to_numpy(zero_copy_only=False)
    of_t, of_q = codes[: sizes[0].sum()], codes[sizes[0].sum() :]
    begin, q_end = np.cumsum(sizes[0]) - sizes[0], np.cumsum(sizes[1])
    size, held = sizes[0], texts["n"].to_numpy(np.int64)
    vocabulary = int(codes.max(initial=-1)) + 1
    df = np.bincount(of_t, minlength=vocabulary)
    index = np.repeat(np.arange(len(size)), size)[np.argsort(of_t, kind="stable")]
    at = np.concatenate([[0], np.cumsum(df)])
    asked = np.zeros(vocabulary, np.int64)
    tids = texts["tid"].to_numpy(np.int64)
    floor = -1.0 if min_sim is None else min_sim

    def similar(found: np.ndarray, n_query: int) -> np.ndarray:
        runs = size[found]
        ends = np.cumsum(runs)
        shared = np.add.reduceat(asked[of_t[np.repeat(begin[found] - ends + runs, runs) + np.arange(ends[-1])]], ends - runs)
        return shared / (runs + n_query - shared)

    for qid, end, n_query in zip(queries["qid"].tolist(), q_end.tolist(), sizes[1].tolist(), strict=True):
        mine = of_q[end - n_query : end]
        grams = mine[df[mine] > 0]
        grams = grams[np.argsort(df[grams], kind="stable")]
        best, sims, known = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if len(grams):
            asked[grams] = 1
            reads, p, budget, reached = np.cumsum(df[grams]), 0, FIRST_READ, max(floor, 0.0)
            while True:
                p = min(max(p + 1, int(np.searchsorted(reads, budget, side="right"))), len(grams))
                met = np.bincount(np.concatenate([index[at[g] : at[g + 1]] for g in grams[:p]]), minlength=len(size))
                known = np.flatnonzero(met)
                most = met[known] + (len(grams) - p)
                best = known[most >= (reached - 1e-9) * (size[known] + n_query - most)]  # the others can't reach it
                sims = similar(best, n_query) if len(best) else np.zeros(0)
                order = np.lexsort((best, -sims))[:top_n]
                best, sims = best[order], sims[order]
                enough = int(np.searchsorted(np.cumsum(held[best]), top_n))
                reached = max(sims[enough] if enough < len(best) else 0.0, reached)
                unseen = (len(grams) - p) / n_query
                if p == len(grams) or unseen < reached or unseen <= floor:
                    break
                budget = 4 * int(reads[p - 1])
            asked[grams] = 0
        if min_sim is None:
            rest = np.arange(min(len(size), len(known) + top_n))
            rest = rest[~np.isin(rest, known)][: top_n] if held[best].sum() < top_n else rest[:0]
            best, sims = np.concatenate([best, rest])[:top_n], np.concatenate([sims, np.zeros(len(rest))])[:top_n]
        ids, last = 0, 0.0
        for i, s in zip(best.tolist(), sims.tolist(), strict=True):
            if s <= floor or (ids >= top_n and s < last):
                break
            yield qid, int(tids[i]), s
            ids, last = ids + int(held[i]), s


cloudpickle.register_pickle_by_value(sys.modules[__name__])
