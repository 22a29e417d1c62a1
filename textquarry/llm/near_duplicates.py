"""Problem 3: records that share most of their content, by a parity-sketch join.

A record is its set of word shingles. Alike sets meet in a cell of their parity sketches (`parity_join`: a
pigeonhole join in bands of sizes that loses no pair); those whose bit sketches differ in more bits than alike sets
of their sizes can differ in shingles are dropped; the rest are verified on the sets themselves, by all 64 bits of
each shingle's hash. Links make classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.words import words
from textquarry.llm.leakage import hashed
from textquarry.llm.parity_join import ODD, SKETCH, SKETCH_WORDS, Bands, bit_sketch, candidate_pairs, filled_cells, mixed, set_hash, signed, verified_links, within_bound
from textquarry.operators.components import connected_components
from textquarry.operators.skew import lookup_join
from textquarry.session import drop_table, materialize

BAND_FACTOR, CELLS = 1024, 1024  # wide bands, so that few sets are guests, and so many cells that few hold two shingles


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of `width` successive words, in order; fewer words make one shingle of them all."""
    width = min(width, max(1, len(hashes)))
    n = len(hashes) - width + 1
    total = np.zeros(max(0, n), np.uint64)
    for i in range(width if n > 0 else 0):
        total = mixed(total * ODD[0] + hashes[i : i + n] * ODD[1 + i % 4])
    return np.unique(total)


def shingle_sets(df: DataFrame, record_id: str, title: str | None, text: str, width: int, min_words: int, bands: Bands) -> DataFrame:
    """(record_id, set_id, size, filled, s0.., elements): the shingle set of each row whose text has min_words words
    or more.

    elements are the shingles' 64-bit hashes; set_id, made of all of them, is the same for equal sets. The content
    is title, line break, text; a null title is empty, a null text has no words.
    """
    kind = dict(df.dtypes)[record_id]
    columns = [F.col(record_id).alias("record_id"), (F.col(title) if title else F.lit("")).cast("string").alias("title"), F.col(text).cast("string").alias("text")]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                kept, found = [], []
                for i, (head, body) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                    own = words(body.as_py())
                    if len(own) >= max(1, min_words):
                        kept.append(i)
                        found.append(shingles(hashed(words(head.as_py()) + own), width))
                ids = np.array([set_hash(s)[0] for s in found], np.uint64)
                sketch = np.array([bit_sketch(s) for s in found], np.int64).reshape(-1, SKETCH_WORDS)
                numbers = [signed(ids), pa.array([len(s) for s in found], pa.int32()), pa.array(filled_cells(found, bands), pa.int32())]
                arrays = [batch.column(0).take(pa.array(kept, pa.int64())), *numbers, *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([s.tobytes() for s in found], pa.binary())], names)

    names = ["record_id", "set_id", "size", "filled", *SKETCH, "elements"]
    return df.select(*columns).mapInArrow(sets, f"record_id {kind}, set_id long, size int, filled int, {', '.join(f'{c} long' for c in SKETCH)}, elements binary")


def near_duplicates(df: DataFrame, record_id: str = "row_id", title: str | None = "title", text: str = "text", width: int = 5, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes: (record_id, class_id, class_rows, links) for every row that counts; class_id is
    the smallest record_id of the rows alike to it directly or through others, links the number of other sets
    its set is alike to. links: (a, b, similarity) between set_ids, all pairs of alike sets, also within a large
    family, where their number grows with its square.

    Rows with equal sets (named by 64 bits) are one node, however many there are; joins back to rows spread hot
    sets and classes. Null ids are dropped, repeated rows are copies, an empty table gives empty results. The
    threshold has to be above a third.
    """
    bands = Bands(threshold, BAND_FACTOR, CELLS)
    whole = materialize(shingle_sets(df.where(F.col(record_id).isNotNull()), record_id, title, text, width, min_words, bands), "sets")
    sets = materialize(whole.drop("record_id").dropDuplicates(["set_id"]), "distinct")
    rows = materialize(whole.select("record_id", "set_id"), "rows")
    drop_table(whole)
    found = materialize(candidate_pairs(sets.withColumn("side", F.lit(3)), bands), "candidates")
    pairs = materialize(within_bound(found, sets, threshold), "possible")
    links = materialize(verified_links(pairs, sets, threshold), "verified")
    for table in (found, pairs, sets):
        drop_table(table)
    components = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("links"))
    nodes = rows.groupBy("set_id").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(components.withColumnRenamed("node", "set_id"), "set_id", "left").join(degree, "set_id", "left")
    nodes = nodes.select("set_id", "first", "copies", F.coalesce("component", "set_id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = nodes.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_rows"), F.count(F.lit(1)).alias("class_sets"))
    of_set = lookup_join(nodes.select("set_id", "copies", "component", "links"), classes, "component", "class_sets", "set_id").drop("component")
    of_row = lookup_join(rows, of_set, "set_id", "copies", "record_id")
    return of_row.select("record_id", "class_id", "class_rows", "links"), links


def pairs_within_classes(classes: DataFrame, block: int = 2048) -> DataFrame:
    """(row_a, row_b) with row_a < row_b for each pair of rows in one class; the output itself is quadratic. The
    rows of a large class are cut into blocks, and each pair of blocks is joined apart."""
    repeated = classes.where("class_rows > 1").withColumn("_blocks", F.ceil(F.col("class_rows") / block))
    own = repeated.withColumn("_own", F.pmod(F.xxhash64("record_id"), "_blocks"))
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    key = [F.col("class_id"), F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high")]
    a, b = each.select(*key, F.col("record_id").alias("row_a"), F.col("_own").alias("_a")), each.select(*key, F.col("record_id").alias("row_b"), F.col("_own").alias("_b"))
    met = a.join(b, ["class_id", "_low", "_high"]).where((F.col("row_a") < F.col("row_b")) & ((F.col("_low") == F.col("_high")) | (F.col("_a") != F.col("_b"))))
    return met.select("row_a", "row_b")
