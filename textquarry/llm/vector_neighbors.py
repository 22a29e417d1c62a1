"""Problem 2: the k most similar vectors of every vector, by projections in a kd-tree.

Unit vectors are projected to a few dimensions by a Gaussian (2-stable) matrix: the squared projected distance
of two vectors, over their squared distance, is chi-square distributed. A kd-tree over the projections orders
the collection; a query takes its leaves by projected distance from it and verifies the vectors in them that are
near enough in the projection, and stops once what is left lies so far there that a vector nearer than the k-th
found would do so with a probability of at most 1 - confidence. The top of the tree, fitted on a bounded sample of
projections, cuts the collection into a bounded number of cells that tasks read from the shared folder, in pieces
where they are large; every row is indexed and every usable vector is a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.skew import lookup_join
from textquarry.session import materialize, shared_path


def chi_square_quantile(p: float, degrees: int) -> float:
    """For an even number of degrees, from the closed form of the distribution."""
    def above(x):
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while above(high) > 1 - p:
        high *= 2
    for _ in range(100):
        low, high = ((low + high) / 2, high) if above((low + high) / 2) > 1 - p else (low, (low + high) / 2)
    return high


def projection(dimensions: int, projected: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, projected))


def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, threshold) of each inner node in heap order: the widest dimension, cut at its median."""
    dims, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    own = {0: np.arange(len(points))}
    for node in range(2**depth - 1):
        at = own.pop(node)
        here = points[at]
        if len(here):
            dims[node] = np.argmax(np.var(here, axis=0))
            cuts[node] = np.median(here[:, dims[node]])
        right = here[:, dims[node]] >= cuts[node] if len(here) else np.empty(0, bool)
        own[2 * node + 1], own[2 * node + 2] = at[~right], at[right]
    return dims, cuts


def descend(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= cuts[node])
    return node - len(dims)


def leaf_order(points: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows sorted by the leaves of a kd-tree of their own, and where leaves begin."""
    order, starts, todo = [], [], [np.arange(len(points))]
    at = 0
    while todo:
        own = todo.pop()
        if len(own) <= leaf_rows:
            order.append(own)
            starts.append(at)
            at += len(own)
            continue
        axis = np.argmax(np.ptp(points[own], axis=0))
        half = np.argpartition(points[own, axis], len(own) // 2)
        todo += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
    return (np.concatenate(order) if order else np.empty(0, np.int64)), np.array(starts, np.int64)


class Block:
    """Vectors of one cell, in leaf order, with their projections and the box of each leaf in the projection. Of
    equal cosines the smaller of ties comes first."""

    def __init__(self, keys: np.ndarray, ties: np.ndarray, units: np.ndarray, matrix: np.ndarray, leaf_rows: int):
        points = units @ matrix
        order, self.starts = leaf_order(points, leaf_rows)
        self.keys, self.ties, self.units, points = keys[order], ties[order], units[order], points[order]
        self.ends = np.append(self.starts[1:], len(order))
        self.low, self.high = np.minimum.reduceat(points, self.starts), np.maximum.reduceat(points, self.starts)
        self.squares = (points * points).sum(axis=1)
        # With a last coordinate, one product tells how near two projections are.
        self.points = np.column_stack([points, -self.squares / 2]).astype(np.float32)
        self.asking = np.column_stack([points, np.ones(len(points))]).astype(np.float32)
        self.near_units = self.units.astype(np.float32)


def box_distances(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of one box from many."""
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    return np.einsum("ij,ij->i", gap, gap)


class Search:
    """The k best of each vector of a block, over blocks given one after another."""

    def __init__(self, block: Block, k: int, least: float, quantile: float):
        self.block, self.k, self.quantile = block, k, quantile
        self.cosine = np.full((len(block.keys), k), least)
        self.key, self.tie = np.zeros((2, len(block.keys), k), np.int64)
        self.found = np.zeros((len(block.keys), k), bool)

    def reach(self, at: slice = slice(None)) -> np.ndarray:
        """Of each query, the squared projected distance at which its search stops."""
        return self.quantile * (2 - 2 * np.maximum(-1.0, self.cosine[at].min(axis=1))) + 1e-6

    def leaf_reach(self) -> np.ndarray:
        return np.maximum.reduceat(self.reach(), self.block.starts)

    def over(self, other: Block, leaves_at_once: int = 16) -> None:
        """Take the leaves of another block, nearest first, until none is in reach.

        Where the projection last kept more than a tenth of the vectors, it is passed over. Cosines in single
        precision, with a margin, then leave few pairs to be verified: of each query, those that can be among the
        best so far, and among the best of these leaves."""
        block, wide = self.block, False
        for leaf, (a, b) in enumerate(zip(block.starts, block.ends, strict=True)):
            far = box_distances(block.low[leaf], block.high[leaf], other.low, other.high)
            order = np.argsort(far, kind="stable")
            for at in range(0, len(order), leaves_at_once):
                reach = self.reach(slice(a, b))
                near = order[at : at + leaves_at_once]
                near = near[far[near] <= reach.max()]
                if not len(near):
                    break
                rows = np.concatenate([np.arange(other.starts[x], other.ends[x]) for x in near])
                hits = None
                if not wide or leaf == 0:
                    hits = np.flatnonzero(block.asking[a:b] @ other.points[rows].T >= ((block.squares[a:b] - reach) / 2 - 1e-3).astype(np.float32)[:, None])
                    wide = len(hits) > 0.1 * (b - a) * len(rows)
                if wide:
                    cosines = block.near_units[a:b] @ other.near_units[rows].T
                    least = (self.cosine[a:b].min(axis=1) - 1e-5).astype(np.float32)
                    hits = np.flatnonzero(cosines >= least[:, None])
                    best = self.k + 1  # one may be the query itself
                    if len(hits) > 4 * best * (b - a) and len(rows) > best:
                        least = np.maximum(least, np.partition(cosines, -best, axis=1)[:, -best] - np.float32(2e-5))
                        hits = np.flatnonzero(cosines >= least[:, None])
                q, c = np.divmod(hits, len(rows))
                cosine = np.einsum("ij,ij->i", block.units[a + q], other.units[rows[c]])
                self._take(a + q, other.keys[rows[c]], other.ties[rows[c]], cosine)

    def _take(self, q: np.ndarray, key: np.ndarray, tie: np.ndarray, cosine: np.ndarray) -> None:
        """Put verified pairs among the best of their queries."""
        better = (cosine >= self.cosine[q].min(axis=1)) & (key != self.block.keys[q])
        q, key, tie, cosine = q[better], key[better], tie[better], cosine[better]
        if not len(q):
            return
        asked = np.unique(q)
        whole = np.concatenate([np.repeat(asked, self.k), q])
        cosine = np.concatenate([self.cosine[asked].ravel(), cosine])
        key, tie = np.concatenate([self.key[asked].ravel(), key]), np.concatenate([self.tie[asked].ravel(), tie])
        found = np.concatenate([self.found[asked].ravel(), np.ones(len(q), bool)])
        order = np.lexsort((key, tie, ~found, -cosine, whole))
        starts = np.searchsorted(whole[order], asked)
        best = order[starts[:, None] + np.arange(self.k)]
        self.cosine[asked], self.key[asked], self.tie[asked], self.found[asked] = cosine[best], key[best], tie[best], found[best]


def usable_vectors(df: DataFrame, vec_id: str, vec: str, dimensions: int) -> DataFrame:
    """(vec_id, digest, unit): vectors of the right length, finite and not all zero, scaled to length 1; vectors
    of one direction, to twelve decimals, have equal digests of 128 bits. unit holds doubles as bytes."""
    kind = dict(df.dtypes)[vec_id]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(batch.column(1)), dimensions), False)
            batch = batch.filter(right)
            values = batch.column(1).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions) + 0.0
            kept = np.flatnonzero(np.isfinite(values).all(axis=1) & (values != 0).any(axis=1))
            values = values[kept]
            scaled = values / np.abs(values).max(axis=1, keepdims=True)
            scaled = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array([xxhash.xxh3_128_digest(u.tobytes()) for u in np.round(scaled, 12) + 0.0], pa.binary()), pa.array([u.tobytes() for u in scaled], pa.binary())],
                ["vec_id", "digest", "unit"],
            )

    chosen = df.select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    return chosen.mapInArrow(units, f"vec_id {kind}, digest binary, unit binary")


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimensions)


def nearest_vectors(
    df: DataFrame, vec_id: str = "vec_id", vec: str = "vec", k: int = 5, min_cosine: float = -1.0, dimensions: int = 64, projected: int = 16,
    confidence: float = 0.99, cell_rows: int = 4096, leaf_rows: int = 256, sample_rows: int = 1 << 18, sample_of_cell: int = 16, seed: int = 7,
) -> DataFrame:
    """(vec_id, neighbor_id, cosine, rank) of the k highest cosines of every usable vector, ties to the smaller id.

    Only neighbours of at least min_cosine come out, and the search goes no farther. A neighbour is missed
    with a probability of at most 1 - confidence. Vectors of one direction are one point with its k + 1 smallest ids,
    however many rows share it, so no group is gathered; rows join back with hot groups spread. Null ids,
    null, short, long, non-finite and zero vectors have no neighbours and are nobody's. The driver holds the
    projections of sample_rows rows at most, on which the tree is fitted, and the boxes of the cells, of which there
    are sample_rows / sample_of_cell at most. A cell of more than cell_rows rows is asked and read in pieces of
    that size, so memory in a task is bounded whatever the collection.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[vec_id]
    usable = materialize(usable_vectors(df, vec_id, vec, dimensions), "units")
    by_digest = Window.partitionBy("digest").orderBy("vec_id")
    first = usable.withColumn("_rank", F.row_number().over(by_digest)).where(F.col("_rank") <= k + 1)
    points = first.groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min_by("unit", "_rank").alias("unit"))
    tie = F.col("ids")[0].cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(0).cast("long")
    points = materialize(points.select("digest", "ids", "unit", F.xxhash64("digest").alias("key"), tie.alias("tie")), "points")
    n = points.count()
    matrix = projection(dimensions, projected, seed)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_matrix(batch.column(0), dimensions) @ matrix).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in at], pa.binary())], ["point"])

    share = math.ceil(1e6 * sample_rows / max(1, n))
    drawn = points.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) < share).select("unit").mapInArrow(project, "point binary").limit(sample_rows).toArrow()
    sampled = np.frombuffer(b"".join(drawn["point"].to_pylist()), np.float32).reshape(-1, projected)
    depth = max(0, math.ceil(math.log2(max(1, n) / cell_rows)))
    dims, cuts = fit_tree(sampled, min(depth, max(0, math.floor(math.log2(max(1, len(sampled)) / sample_of_cell)))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _matrix(batch.column(1), dimensions) @ matrix
            box = [pa.array([p.tobytes() for p in at], pa.binary()), pa.array(descend(at, dims, cuts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *box], ["key", "unit", "tie", "point", "cell"])

    folder = shared_path(spark, "cells")
    cells = points.select("key", "unit", "tie").mapInArrow(placed, "key long, unit binary, tie long, point binary, cell long")
    piece = F.pmod("key", F.lit(max(1, n // (64 * cell_rows * (len(cuts) + 1)))))  # spreads the writing of large cells
    cells.repartition("cell", piece).sortWithinPartitions("cell").write.partitionBy("cell").parquet(folder)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, projected))
            grouped = frame.groupby(batch.column(1).to_numpy())
            low, high, rows = grouped.min(), grouped.max(), grouped.size()
            bounds = [pa.array(x.to_numpy().tolist(), pa.list_(pa.float64())) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(low.index, pa.int64()), *bounds, pa.array(rows.to_numpy(), pa.int64())], ["cell", "low", "high", "rows"])

    parts = spark.read.schema("point binary, cell long").parquet(folder).mapInArrow(boxes, "cell long, low array<double>, high array<double>, rows long")
    sides = [f(F.col(c)[i]).alias(f"{c}_{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(projected)]
    held = parts.groupBy("cell").agg(F.sum("rows").alias("rows"), *sides).orderBy("cell").toPandas()  # one row a cell, their number is bounded
    filled, rows = held["cell"].to_numpy(np.int64), held["rows"].to_numpy(np.int64)
    low, high = (held[[f"{c}_{i}" for i in range(projected)]].to_numpy(float) for c in ("low", "high"))
    quantile = chi_square_quantile(confidence, projected)
    parts_upto = np.cumsum(-(-rows // cell_rows))
    given = spark.sparkContext.broadcast((filled, low, high, parts_upto))

    def read(cell: int) -> Iterator[pa.Table]:
        """A cell's rows in pieces of about cell_rows, in the same order for every reader."""
        system, path = fs.FileSystem.from_uri(folder)
        held: list[pa.RecordBatch] = []
        for file in sorted(ds.dataset(f"{path}/cell={cell}", filesystem=system, format="parquet").files):
            for batch in ds.dataset(file, filesystem=system, format="parquet").to_batches(columns=["key", "tie", "unit"], batch_size=cell_rows, use_threads=False):
                held.append(batch)
                if sum(b.num_rows for b in held) >= cell_rows:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    def block_of(table: pa.Table) -> Block:
        return Block(table["key"].to_numpy(), table["tie"].to_numpy(), _matrix(table["unit"], dimensions), matrix, leaf_rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, low, high, upto = given.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                own = int(np.searchsorted(upto, number, side="right"))
                before = int(upto[own - 1]) if own else 0
                part, parts = number - before, int(upto[own]) - before
                # Of a cell in several pieces the asking rows are those of one part, by their keys.
                whole = [t.filter(pa.array(t["key"].to_numpy() % parts == part)) if parts > 1 else t for t in read(int(filled[own]))]
                block = block_of(pa.concat_tables(whole))
                if not len(block.keys):
                    continue
                state = Search(block, k, min_cosine, quantile)
                state.over(block)
                far = box_distances(low[own], high[own], low, high)
                for other in np.argsort(far, kind="stable"):
                    if far[other] > state.leaf_reach().max():
                        break
                    leaf_far = box_distances(low[other], high[other], block.low, block.high)
                    if (other == own and parts == 1) or (leaf_far > state.leaf_reach()).all():
                        continue
                    for table in read(int(filled[other])):
                        if other == own:
                            table = table.filter(pa.array(table["key"].to_numpy() % parts != part))
                        if table.num_rows:
                            state.over(block_of(table))
                q, rank = np.nonzero(state.found)
                yield pa.RecordBatch.from_arrays([pa.array(block.keys[q]), pa.array(state.key[q, rank]), pa.array(state.cosine[q, rank])], ["key", "other", "cosine"])

    tasks = spark.range(0, int(parts_upto[-1]), 1, int(min(parts_upto[-1], 100_000))) if len(filled) else spark.range(0)  # as a rule a task for each piece
    near = tasks.mapInArrow(search, "key long, other long, cosine double")
    ids = points.select("key", "ids")
    others = near.join(ids.withColumnsRenamed({"key": "other", "ids": "other_ids"}), "other").groupBy("key").agg(F.flatten(F.collect_list(F.transform("other_ids", lambda i: F.struct((-F.col("cosine")).alias("c"), i.alias("i"))))).alias("far"))
    own_ids = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("i")))
    lists = points.select("digest", "key", "ids").join(others, "key", "left")
    lists = lists.select("digest", F.slice(F.array_sort(F.concat(own_ids, F.coalesce("far", F.array().cast(f"array<struct<c:double,i:{kind}>>")))), 1, k + 1).alias("list"))
    sizes = usable.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    each = lookup_join(usable.select("vec_id", "digest"), lists.join(sizes, "digest"), "digest", "rows", "vec_id")
    kept = F.slice(F.filter("list", lambda x: x["i"] != F.col("vec_id")), 1, k)
    return each.select("vec_id", F.posexplode(kept).alias("rank", "n")).select("vec_id", F.col("n.i").alias("neighbor_id"), F.least(F.lit(1.0), -F.col("n.c")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(neighbors: DataFrame, min_cosine: float) -> DataFrame:
    """(vec_a, vec_b) with vec_a < vec_b: each pair of neighbours of at least min_cosine once."""
    return neighbors.where(F.col("cosine") >= min_cosine).select(F.least("vec_id", "neighbor_id").alias("vec_a"), F.greatest("vec_id", "neighbor_id").alias("vec_b")).distinct()
