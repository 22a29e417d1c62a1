"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import materialize


def lookup_join(rows: DataFrame, mapping: DataFrame, key: str, weight: str, spread: str, parts: int = 1000, salts: int = 256) -> DataFrame:
    """Inner join of rows with a mapping that has each key once and, in weight, how many rows hold it.

    Keys with at least a parts-th of the mapped weight can be parts in number at most, so they are broadcast
    under a proven bound; their rows are spread by a hash of the column spread and meet no partner in the
    shuffle. All other keys join by shuffle. Null keys match nothing; the result has no order.
    """
    values = [c for c in mapping.columns if c not in (key, weight)]
    mapping = materialize(mapping, "mapping")  # it is read three times
    least = F.coalesce(mapping.select(F.sum(weight)).scalar(), F.lit(0)) / parts
    hot = mapping.where(F.col(weight) >= least).select(key, F.struct(*values).alias("_hot"))
    cold = mapping.where(F.col(weight) < least).select(key, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int") + 1).otherwise(0)
    both = marked.withColumn("_salt", salt).join(cold, [key, "_salt"], "left")
    found = both.withColumn("_value", F.coalesce("_hot", "_cold")).where(F.col("_value").isNotNull())
    return found.select(*rows.columns, *[F.col("_value")[c].alias(c) for c in values])
