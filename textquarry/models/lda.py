"""Linear discriminant analysis of labelled vectors, from class sums and the scatter within classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import ModelTrainingError


@dataclass(frozen=True)
class Lda:
    classes: tuple[str, ...]
    center: np.ndarray
    scalings: np.ndarray


def fit(vectors: DataFrame, label: str = "label", vec: str = "vec", tolerance: float = 1e-4, max_classes: int = 10_000) -> Lda:
    """Two classes of two rows each at least. Tasks emit a count, a sum and a matrix of products per class they see;
    the driver adds these up and solves two small eigenproblems."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            for c in sorted(set(labels)):
                own = x[labels == c]
                held = sums.setdefault(c, [0, 0.0, 0.0])
                held[0] += len(own)
                held[1] = held[1] + own.sum(0)
                held[2] = held[2] + own.T @ own
        if sums:
            columns = [pa.array(list(sums)), pa.array([s[0] for s in sums.values()], pa.int64()), *[pa.array([np.ascontiguousarray(s[i]).tobytes() for s in sums.values()], pa.binary()) for i in (1, 2)]]
            yield pa.RecordBatch.from_arrays(columns, ["label", "n", "sums", "products"])

    rows = vectors.where(F.col(label).isNotNull()).select(F.col(label).cast("string"), F.col(vec).cast("array<double>"))
    count, total, products = {}, {}, 0.0
    for r in rows.mapInArrow(partial, "label string, n long, sums binary, products binary").toLocalIterator():
        if len(count) >= max_classes and r["label"] not in count:
            raise ModelTrainingError(f"more than {max_classes} classes")
        count[r["label"]] = count.get(r["label"], 0) + r["n"]
        total[r["label"]] = total.get(r["label"], 0.0) + np.frombuffer(r["sums"])
        products = products + np.frombuffer(r["products"]).reshape(len(np.frombuffer(r["sums"])), -1)
    if len(count) < 2 or min(count.values()) < 2:
        raise ModelTrainingError("two classes of two documents each are needed")
    classes = tuple(sorted(count))
    n, sizes = sum(count.values()), np.array([count[c] for c in classes], float)
    means = np.array([total[c] / count[c] for c in classes])
    center = (sizes / n) @ means
    within = products - (means.T * sizes) @ means
    deviation = np.sqrt(np.maximum(np.diag(within), 0) / n)
    deviation[deviation == 0] = 1.0
    factor = 1.0 / (n - len(classes)) if n > len(classes) else 1.0
    values, vectors_ = np.linalg.eigh(factor * within / np.outer(deviation, deviation))
    kept = np.sqrt(np.maximum(values, 0)) > tolerance
    if not kept.any():
        raise ModelTrainingError("the vectors of each class are all alike")
    scalings = (vectors_[:, kept] / deviation[:, None]) / np.sqrt(values[kept])
    between = (np.sqrt(sizes * factor)[:, None] * (means - center)) @ scalings
    _, s, vt = np.linalg.svd(between, full_matrices=False)
    rank = int((s > tolerance * s[0]).sum()) if len(s) else 0
    return Lda(classes, center, (scalings @ vt.T)[:, : min(rank, len(classes) - 1)])


def transform(model: Lda, vectors: DataFrame, doc_id: str = "doc_id", vec: str = "vec") -> DataFrame:
    """(doc_id, vec): coordinates, at most one fewer than classes."""
    kind = dict(vectors.dtypes)[doc_id]
    held = vectors.sparkSession.sparkContext.broadcast((model.center, model.scalings))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, scalings = held.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list((x - center) @ scalings), pa.list_(pa.float64()))], ["doc_id", "vec"])

    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(vec).cast("array<double>"))
    return rows.mapInArrow(project, f"doc_id {kind}, vec array<double>")
