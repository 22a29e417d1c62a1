"""Problem 1: how often, and in how many records, every word occurs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.words import words

SCHEMA = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _partials(batches: Iterator[pa.RecordBatch], held_terms: int) -> Iterator[pa.RecordBatch]:
    """Count each record's terms, combine by hash, and pass on whenever held_terms are held."""
    occurrences: Counter[str] = Counter()
    records: Counter[str] = Counter()

    def passed_on() -> pa.RecordBatch:
        arrays = [pa.array(occurrences.keys(), pa.string()), pa.array(occurrences.values(), pa.int64())]
        out = pa.RecordBatch.from_arrays([*arrays, pa.array([records[t] for t in occurrences], pa.int64())], schema=SCHEMA)
        occurrences.clear()
        records.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            found = words(text.as_py())
            occurrences.update(found)
            records.update(set(found))
            if len(occurrences) >= held_terms:
                yield passed_on()
    yield passed_on()


def term_counts(records: DataFrame, text: str = "text", held_terms: int = 200_000) -> DataFrame:
    """(term, occurrences, records) for every word of the column text.

    Null and blank texts have no words. Memory in a task is bounded by held_terms, without loss: what is
    passed on early is summed after the shuffle. An empty table gives no rows; other columns are not read.
    """
    partial = records.select(F.col(text).cast("string")).mapInArrow(
        lambda batches: _partials(batches, held_terms), "term string, occurrences long, records long"
    )
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(records: DataFrame, text: str = "text", min_records: int = 3, max_share: float = 0.1) -> DataFrame:
    """(term, occurrences, records, mark): mark is `rare` below min_records records, else `common` above
    max_share of all rows (rows without text included), else null."""
    total = records.select(F.count(F.lit(1))).scalar()
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(max_share) * total, "common")
    return term_counts(records, text).withColumn("mark", mark)
