"""Scores of a block of chunks for a batch of queries as one matrix product, inside tasks.

A task that holds whole chunks knows how often each has a term, so no count and no score of a (query, chunk) pair is
shuffled: a block gives its k best rows for each query, with ties by chunk_id, and Spark ranks those of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

K1, B = 1.2, 0.75
PAIRS = 200_000  # terms of queries that are sent to the tasks
CELLS = 4 << 20  # of a matrix
QUERIES = 512  # in one product


class Asked:
    """The terms of a batch of queries, numbered."""

    def __init__(self, pairs: list[tuple]) -> None:
        self.queries, self.terms = (list(dict.fromkeys(p[i] for p in pairs)) for i in (0, 1))
        query, term = ({x: k for k, x in enumerate(found)} for found in (self.queries, self.terms))
        order = sorted((query[q], term[t]) for q, t in pairs)
        self.query, self.term = (np.array([p[i] for p in order], np.int64) for i in (0, 1))

    @property
    def rows(self) -> int:
        """Chunks of one block."""
        return max(16, CELLS // max(1, len(self.terms), QUERIES))

    def counts(self, tokens: pa.ListArray) -> np.ndarray:
        """How often each chunk (tokens without nulls) has each term."""
        at = pc.index_in(tokens.flatten(), value_set=pa.array(self.terms, pa.string()))
        owner = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        place = owner[known] * len(self.terms) + at.drop_null().to_numpy()
        return np.bincount(place, minlength=len(tokens) * len(self.terms)).reshape(len(tokens), len(self.terms)).astype(float)

    def dense(self, terms: pa.ListArray, tfs: pa.ListArray) -> np.ndarray:
        """The same from the numbers of the terms of each chunk."""
        out = np.zeros((len(terms), len(self.terms)))
        out[np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy()), terms.flatten().to_numpy()] = tfs.flatten().to_numpy()
        return out

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """Sums of one weight a term for each query."""
        return np.bincount(self.query, weights[self.term], minlength=len(self.queries))

    def best(self, counts: np.ndarray, dl: np.ndarray, ids: pa.Array, idf: np.ndarray, average: float, k: int, wanted: np.ndarray | None = None) -> pa.Table:
        """(query, chunk_id, score): the k best chunks that share a term with it for each query, or each wanted one."""
        weights = counts * (K1 + 1) * idf / (counts + (K1 * (1 - B + B * dl / average))[:, None])
        found: list[tuple] = []
        asked = np.arange(len(self.queries)) if wanted is None else np.unique(wanted)
        for lo in range(0, len(asked), QUERIES):
            some = asked[lo : lo + QUERIES]
            column = np.full(len(self.queries), -1)
            column[some] = np.arange(len(some))
            met = column[self.query] >= 0
            holds = np.zeros((len(self.terms), len(some)))
            holds[self.term[met], column[self.query[met]]] = 1
            exact = weights @ holds
            score = np.round(exact, 6)
            taken = exact > 0
            if len(ids) > k:
                taken &= score >= np.partition(score, len(ids) - k, axis=0)[len(ids) - k]
            chunk, query = np.nonzero(taken)
            found.append((some[query], chunk, score[chunk, query]))
        query, chunk, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return best_rows(pa.table({"query": query, "chunk_id": ids.take(pa.array(chunk)), "score": score}), k)

    def given(self, rows: pa.Table, kind: pa.DataType) -> pa.Table:
        """The rows under the queries' own ids."""
        return pa.table({"query_id": pa.array(self.queries, kind).take(rows["query"]), "chunk_id": rows["chunk_id"], "score": rows["score"]})


def sparse(counts: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """The numbers of the terms of each chunk, and how often it has them."""
    chunk, term = np.nonzero(counts)
    bounds = pa.array(np.searchsorted(chunk, np.arange(len(counts) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(counts[chunk, term].astype(np.int32)))


def best_rows(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows (query, chunk_id, score) of each query, ties by chunk_id."""
    if not len(rows):
        return rows
    query, score = rows["query"].to_numpy(), rows["score"].to_numpy()
    tie = pc.rank(rows["chunk_id"].combine_chunks(), tiebreaker="dense").to_numpy()
    order = np.lexsort((tie, -score, query))
    sorted_ = query[order]
    return rows.take(pa.array(order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]))


def few(asked: DataFrame, most_terms: int, most: int = PAIRS) -> Asked | None:
    """The rows (query_id, term) as numbers, or None if they are too many to send to the tasks."""
    if not most_terms:
        return None
    found = Asked([tuple(r) for r in asked.select("query_id", "term").limit(most + 1).collect()])
    return found if len(found.query) <= most and len(found.terms) <= most_terms else None
