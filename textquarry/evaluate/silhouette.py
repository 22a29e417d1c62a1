"""Mean silhouette by Euclidean distance. Its definition compares all pairs, so blocks meet blocks in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import shared_path


def silhouette(vectors: DataFrame, label: str = "label", vec: str = "vec", block_rows: int = 4096) -> dict:
    """{"value", "reason", "rows", "classes"}: value is null, with a reason, for fewer than two classes or no more
    rows than classes. A row alone in its class has silhouette 0. Rows without label or vector do not count.

    Rows are written once in blocks of about block_rows at most to the shared folder; each task holds one block and
    the sums of distances to each class, and reads the others one by one, so its memory does not grow with the rows."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    out = {"value": None, "reason": None, "rows": n, "classes": len(sizes)}
    if len(sizes) < 2:
        return out | {"reason": "fewer than two classes"}
    if n <= len(sizes):
        return out | {"reason": "no more rows than classes"}
    blocks = max(min(n, 64), -(-n // block_rows))
    folder = shared_path(spark, "blocks")
    rows.withColumn("block", F.pmod(F.xxhash64("vec", "label"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    names = sorted(sizes)
    order, count = {c: i for i, c in enumerate(names)}, np.array([sizes[c] for c in names], float)

    def read(block: int) -> tuple[np.ndarray, np.ndarray] | None:
        system, path = fs.FileSystem.from_uri(folder)
        if system.get_file_info(f"{path}/block={block}").type == fs.FileType.NotFound:
            return None
        table = ds.dataset(f"{path}/block={block}", filesystem=system, format="parquet").to_table(["label", "vec"]).combine_chunks()
        flat = pa.compute.list_flatten(table["vec"]).to_numpy()
        return np.array([order[c] for c in table["label"].to_pylist()]), flat.reshape(table.num_rows, -1)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                own = read(block)
                if own is None:
                    continue
                labels, x = own
                sums = np.zeros((len(x), len(names)))
                squares = (x * x).sum(1)
                for other in range(blocks):
                    if (found := read(other)) is None:
                        continue
                    classes, y = found
                    square = np.maximum(squares[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)
                    if other == block:
                        np.fill_diagonal(square, 0)
                    member = np.zeros((len(y), len(names)))
                    member[np.arange(len(y)), classes] = 1
                    sums += np.sqrt(square) @ member
                rows_ = np.arange(len(x))
                inner = sums[rows_, labels] / np.maximum(count[labels] - 1, 1)
                outer = sums / count
                outer[rows_, labels] = np.inf
                near = outer.min(1)
                value = np.where(count[labels] > 1, (near - inner) / np.maximum(np.maximum(near, inner), 1e-300), 0)
                yield pa.RecordBatch.from_arrays([pa.array([float(value.sum())])], ["total"])

    total = spark.range(0, blocks, 1, blocks).mapInArrow(scores, "total double").agg(F.sum("total")).first()[0]
    return out | {"value": total / n}
