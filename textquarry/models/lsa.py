"""Latent semantic analysis: truncated SVD of the weighted term-document matrix, from its Gram matrix.

The matrix of terms by terms is summed up and solved in tasks, so neither it nor documents leave the executors; its
size is bounded by max_cells, whatever the corpus. The driver holds the components alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput, ModelTrainingError
from textquarry.operators.terms import document_frequencies, idf, vocabulary_ids
from textquarry.session import materialize

MAX_CELLS = 20_000_000


@dataclass(frozen=True)
class Lsa:
    vocabulary: DataFrame  # (term, term_id, idf)
    projection: np.ndarray  # terms by components
    singular_values: np.ndarray
    unit: bool  # whether documents are scaled to length 1


def _weights(batch: pa.RecordBatch, known: dict[str, tuple[int, float]]) -> tuple[list, list, list]:
    """(ids, values, known tokens) of each row's tokens: (1 + ln tf) idf over the length of the row."""
    ids, values, tokens = [], [], []
    for row in batch.column(1).to_pylist():
        counts = {known[t][0]: (n, known[t][1]) for t, n in Counter(row or ()).items() if t in known}
        own = np.array(sorted(counts), np.int64)
        n, idf_ = np.array([counts[i] for i in own.tolist()], float).reshape(-1, 2).T
        raw = (1 + np.log(n)) * idf_
        ids.append(own)
        values.append(raw / max(np.linalg.norm(raw), 1e-300))
        tokens.append(int(n.sum()))
    return ids, values, tokens


def held_vocabulary(vocabulary: DataFrame) -> dict[str, tuple[int, float]]:
    """The vocabulary of a model; a square of it fits MAX_CELLS."""
    return {r["term"]: (r["term_id"], r["idf"]) for r in vocabulary.select("term", "term_id", "idf").collect()}


def sparse_rows(docs: DataFrame, vocabulary: dict, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, ids, values) of each row, in one pass over its tokens."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                ids, values, _ = _weights(batch, held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "ids", "values"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("tokens"))
    return rows.mapInArrow(weighted, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, values array<double>")


def _dense(batch: pa.RecordBatch, ids: int, values: int, features: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, features))
    lengths = batch.column(ids).value_lengths().fill_null(0).to_numpy()
    out[np.repeat(np.arange(batch.num_rows), lengths), batch.column(ids).flatten().to_numpy()] = batch.column(values).flatten().to_numpy()
    return out


def gram_rows(rows: DataFrame, features: int, max_cells: int = MAX_CELLS) -> DataFrame:
    """(row, part): sum over documents of the outer product of their weights, by rows of the matrix as bytes: one
    partial matrix a task, added up after a shuffle. Rows that no task has are zeros."""
    if features * features > max_cells:
        raise InvalidInput(f"{features} terms make more than {max_cells} cells; lower max_features")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features, features))
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                x = _dense(batch, 0, 1, features)
                total += x.T @ x
        if total.any():
            for at in range(0, features, 256):
                part = total[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int32()), pa.array([r.tobytes() for r in part], pa.binary())], ["row", "part"])

    def added(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(features)
        for frame in parts:
            for part in frame["part"]:
                total += np.frombuffer(part)
        yield pd.DataFrame({"row": [key[0]], "part": [total.tobytes()]})

    parts = rows.select("ids", "values").mapInArrow(partial, "row int, part binary")
    return parts.groupBy("row").applyInPandas(added, "row int, part binary")


def gram_matrix(rows: DataFrame, features: int, max_cells: int = MAX_CELLS) -> np.ndarray:
    """The whole matrix of gram_rows, for small ones."""
    out = np.zeros((features, features))
    for r in gram_rows(rows, features, max_cells).toLocalIterator():
        out[r["row"]] = np.frombuffer(r["part"])
    return out


def solved(gram: DataFrame, features: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """decompose of the matrix of gram_rows, in one task: the driver receives features by components numbers."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((features, features))
        for batch in batches:
            for row, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole[row] = np.frombuffer(part.as_buffer())
        projection, values = decompose(whole, components)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (projection, values)], ["projection", "values"])

    found = gram.repartition(1).mapInArrow(solve, "projection binary, values binary").first()
    if found is None:
        return np.zeros((features, 0)), np.zeros(0)
    values = np.frombuffer(found["values"]).copy()
    return np.frombuffer(found["projection"]).reshape(features, len(values)).copy(), values


def decompose(gram: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection, singular values), largest first; each component's largest loading is positive."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:components]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    kept = values > max(values[:1].sum(), 1e-300) * 1e-12
    values, vectors = values[kept], vectors[:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else np.ones(0)
    return vectors * signs, np.sqrt(values)


def fit(docs: DataFrame, dimensions: int = 50, max_features: int = 2000, doc_id: str = "doc_id", tokens: str = "tokens", unit: bool = True) -> Lsa:
    """components: the smaller of dimensions and min(documents, terms) - 1. unit scales documents to length 1; without
    it coordinates are those of the SVD. Tokens are read several times: write or cache them before."""
    n = docs.count()
    stats = vocabulary_ids(document_frequencies(docs, tokens), max_features, alphabetic=True)
    vocabulary = idf(stats, n).select("term", "term_id", "idf")
    vocabulary = materialize(vocabulary, "vocabulary")
    features = vocabulary.count()
    if n < 2 or features < 2:
        raise ModelTrainingError("two documents and two terms are needed")
    rows = sparse_rows(docs, held_vocabulary(vocabulary), doc_id, tokens)
    projection, values = solved(gram_rows(rows, features), features, min(dimensions, n - 1, features - 1))
    if not len(values):
        raise ModelTrainingError("no document has a known term")
    return Lsa(vocabulary, projection, values, unit)


def transform(model: Lsa, docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, vec, known_tokens): every row; without known tokens, or where the length is at most 1e-12, zeros."""
    held = docs.sparkSession.sparkContext.broadcast((held_vocabulary(model.vocabulary), model.projection))
    unit = model.unit

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, projection = held.value
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                ids, values, known = _weights(batch, vocabulary)
                x = np.zeros((batch.num_rows, projection.shape[0]))
                x[np.repeat(np.arange(batch.num_rows), [len(i) for i in ids]), np.concatenate(ids)] = np.concatenate(values)
                x = x @ projection
                if unit:
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.where(length > 1e-12, x / np.maximum(length, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(known, pa.int32())], ["doc_id", "vec", "known_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("tokens"))
    return rows.mapInArrow(project, f"doc_id {dict(rows.dtypes)['doc_id']}, vec array<double>, known_tokens int")


def topic_terms(model: Lsa, n: int = 10) -> DataFrame:
    """(component, side, rank, term, loading): the n terms of largest positive and of most negative loading."""
    spark = model.vocabulary.sparkSession
    ids = np.arange(model.projection.shape[0])
    rows = [(int(i), int(c), float(model.projection[i, c])) for c in range(model.projection.shape[1]) for i in ids[model.projection[:, c] != 0]]
    from pyspark.sql import Window

    loadings = spark.createDataFrame(rows, "term_id int, component int, loading double").join(model.vocabulary.select("term_id", "term"), "term_id")
    side = F.when(F.col("loading") > 0, "positive").otherwise("negative")
    by = Window.partitionBy("component", "side").orderBy(F.desc(F.abs("loading")), "term")
    return loadings.withColumn("side", side).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).select("component", "side", "rank", "term", "loading")
