"""Exact cosine search: stated queries, in blocks, against all vectors, and the statuses of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.functions.text import excerpt
from textquarry.operators.terms import ranked


def valid(vec, dimensions: int | None = None):
    """Whether a vector is finite throughout, and of the given length."""
    finite = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vec) > 0)
    return finite if dimensions is None else finite & (F.size(vec) == dimensions)


def is_zero(vec):
    return ~F.exists(vec, lambda x: x != 0)


def build_index(vectors: DataFrame, doc_id: str = "doc_id", vec: str = "vec", dimensions: int | None = None, keep_zero: bool = False, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index, zero): index (doc_id, vec) of unit vectors; zero has the ids of zero vectors, which stay in the index
    only with keep_zero. Vectors that are null, not finite or of another length are an error, or left out if not
    strict."""
    ok = valid(F.col("vec"), dimensions)
    rows = vectors.select(F.col(doc_id).alias("doc_id"), F.col(vec).cast("array<double>").alias("vec"))
    if strict and (bad := rows.where(~ok).count()):
        raise InvalidInput(f"{bad} vectors are not finite or of another length")
    checked = rows.where(ok)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    unit = checked.withColumn("_n", length).withColumn("vec", F.when(F.col("_n") > 0, F.transform("vec", lambda x: x / F.col("_n"))).otherwise(F.col("vec")))
    zero = unit.where("_n = 0").select("doc_id")
    return (unit if keep_zero else unit.where("_n > 0")).select("doc_id", "vec"), zero


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_id: str = "query_id", queries_at_once: int = 4096, exclude_same: bool = False) -> DataFrame:
    """(query_id, doc_id, cosine, rank): the k highest cosines of each query over all vectors, ties by id.

    Queries (query_id, vec) are a stated set: blocks of queries_at_once go to every task, which keeps k of each
    query, and these few rows are ranked. Cosines are clamped to [-1, 1]. exclude_same leaves out the row of the
    query's own id. Zero and null query vectors have no result.
    """
    if k < 1:
        raise InvalidInput("k is at least 1")
    spark = index.sparkSession
    kinds = dict(index.dtypes)["doc_id"], dict(queries.dtypes)[query_id]
    out, block = None, []

    def against(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block], float)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = held.value
            for whole in batches:
                for batch in (whole.slice(at, 2048) for at in range(0, whole.num_rows, 2048)):
                    x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                    scores = np.clip(matrix @ x.T, -1, 1)
                    if exclude_same:
                        ids = batch.column(0).to_pylist()
                        place = {i: c for c, i in enumerate(ids)}
                        for r, q in enumerate(names):
                            if q in place:
                                scores[r, place[q]] = -np.inf
                    n = min(k, batch.num_rows)
                    least = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
                    r, c = np.nonzero((scores >= least) & np.isfinite(scores))  # with ties, which the ranking resolves
                    yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(r)), batch.column(0).take(pa.array(c)), pa.array(scores[r, c])], ["query_id", "doc_id", "cosine"])

        return index.select("doc_id", "vec").mapInArrow(scan, f"query_id {kinds[1]}, doc_id {kinds[0]}, cosine double")

    unit = build_index(queries.where(F.col("vec").isNotNull()), query_id)[0]
    for row in unit.toLocalIterator():
        block.append(tuple(row))
        if len(block) == queries_at_once:
            out = against(block) if out is None else out.unionByName(against(block))
            block = []
    if block:
        out = against(block) if out is None else out.unionByName(against(block))
    if out is None:
        return spark.createDataFrame([], f"query_id {kinds[1]}, doc_id {kinds[0]}, cosine double, rank int")
    return ranked(out, k)


def query_status(encoded: DataFrame) -> DataFrame:
    """encoded (total_tokens, known_tokens, vec) with status: empty_after_normalization, oov, zero_vector or ok."""
    status = F.when(F.col("total_tokens") == 0, "empty_after_normalization").when(F.col("known_tokens") == 0, "oov").when(is_zero(F.col("vec")), "zero_vector").otherwise("ok")
    return encoded.withColumn("status", status)


def with_excerpts(hits: DataFrame, documents: DataFrame, length: int = 180) -> DataFrame:
    """hits with title and excerpt; texts are only joined to rows that were found."""
    return hits.join(documents.select("doc_id", "title", "text"), "doc_id", "left").withColumn("excerpt", excerpt(F.col("text"), length)).drop("text")


def dual_search(index: DataFrame, queries: DataFrame, sparse: DataFrame, k: int = 5) -> DataFrame:
    """Hits by dense cosine with the cosine of sparse weights (query_id, doc_id, cosine) beside it, 0 where no term
    is shared. Build the index with keep_zero to rank documents without known terms too."""
    return search(index, queries, k).join(sparse.withColumnRenamed("cosine", "sparse_cosine"), ["query_id", "doc_id"], "left").fillna(0.0, ["sparse_cosine"])
