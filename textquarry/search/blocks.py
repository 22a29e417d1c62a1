"""The k best rows for each of many queries, none of which pass through the driver.

Queries that grow with the corpus, as a test split does, are no stated set: they are written to the shared folder,
and each task reads them in blocks against blocks of its own rows. The work is still that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame

from textquarry.operators.terms import ranked
from textquarry.session import shared_path, spread

DOCUMENTS, QUERIES = 4096, 1024  # rows of a block; their scores are 32 MB
_PAIRS = 1 << 20


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def best_of_blocks(documents: DataFrame, queries: DataFrame, k: int, load: Callable[[pa.Table], object], score: Callable[[object, object], np.ndarray], digits: int | None = None, above: float = -np.inf) -> DataFrame:
    """(query_id, doc_id, cosine, rank): of each query the k best rows that score higher than above, ties by id.

    documents: (doc_id, ...) and queries: (query_id, ...), both with unique ids. load makes of a block of either what
    score takes, and score(queries, documents) a new matrix of scores, which are rounded to the digits before they
    are ranked. A task holds a block of each, and k scores of each query, below which nothing is passed on."""
    kinds = dict(queries.dtypes)["query_id"], dict(documents.dtypes)["doc_id"]
    folder = shared_path(documents.sparkSession, "asked")
    queries.write.parquet(folder)
    slack = 0.0 if digits is None else 2 * 10.0**-digits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        asked = ds.dataset(path, filesystem=system, format="parquet")
        best: dict[int, np.ndarray] = {}
        for block in _blocks(batches, DOCUMENTS):
            block = block.sort_by("doc_id")
            own, n = load(block), min(k, block.num_rows)
            read = asked.to_batches(batch_size=QUERIES, batch_readahead=2, fragment_readahead=1, use_threads=False)
            for number, part in enumerate(_blocks(read, QUERIES)):
                scores = score(load(part), own)
                highest = np.partition(scores, block.num_rows - n, axis=1)[:, block.num_rows - n :]
                held = best.get(number, np.full((part.num_rows, k), -np.inf))
                best[number] = held = np.partition(np.concatenate([held, highest], 1), n, axis=1)[:, n:]
                r, c = np.nonzero((scores >= held.min(1, keepdims=True) - slack) & (scores > above))
                found = scores[r, c] if digits is None else np.round(scores[r, c], digits)
                order = np.lexsort((c, -found, r))  # columns are in order of the id
                r, c, found = r[order], c[order], found[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c, found = r[first], c[first], found[first]
                yield pa.RecordBatch.from_arrays([part["query_id"].combine_chunks().take(pa.array(r)), block["doc_id"].combine_chunks().take(pa.array(c)), pa.array(found)], ["query_id", "doc_id", "cosine"])

    return ranked(spread(documents).mapInArrow(scan, f"query_id {kinds[0]}, doc_id {kinds[1]}, cosine double"), k)


def dense_rows(block: pa.Table) -> np.ndarray:
    return pa.compute.list_flatten(block["vec"]).to_numpy().reshape(block.num_rows, -1)


def dense_scores(queries: np.ndarray, documents: np.ndarray) -> np.ndarray:
    return np.clip(queries @ documents.T, -1, 1)


def sparse_rows(dense: int) -> Callable[[pa.Table], tuple]:
    """Loads rows of (ids, values), scaled to length 1: numbers below dense are columns of a matrix, of the others
    there are number, row and value by number."""

    def load(block: pa.Table) -> tuple:
        ids, values = (pa.compute.list_flatten(block[c]).to_numpy() for c in ("ids", "values"))
        row = np.repeat(np.arange(block.num_rows), pa.compute.list_value_length(block["ids"]).to_numpy())
        values = values / np.sqrt(np.bincount(row, values * values, block.num_rows))[row]
        many = ids < dense
        matrix = np.zeros((block.num_rows, dense))
        np.add.at(matrix, (row[many], ids[many]), values[many])
        order = np.argsort(ids[~many], kind="stable")
        return matrix, *(x[~many][order] for x in (ids, row, values))

    return load


def sparse_scores(queries: tuple, documents: tuple) -> np.ndarray:
    """Frequent terms by a product of matrices, rare ones by their pairs."""
    (a, a_id, a_row, a_value), (b, b_id, b_row, b_value) = queries, documents
    scores = a @ b.T
    flat = scores.reshape(-1)
    low = np.searchsorted(b_id, a_id)
    count = np.searchsorted(b_id, a_id, side="right") - low
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        before = ends[start] - count[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + _PAIRS, side="right")))
        n = count[start:stop]
        at = np.repeat(low[start:stop] - (ends[start:stop] - n - before), n) + np.arange(n.sum())
        np.add.at(flat, np.repeat(a_row[start:stop] * len(b), n) + b_row[at], np.repeat(a_value[start:stop], n) * b_value[at])
        start = stop
    return scores
