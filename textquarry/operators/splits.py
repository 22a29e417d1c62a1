"""Deterministic splits and samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.functions.java_random import JavaRandom

SPLITS = ("train", "validation", "test")


def allocate(rows: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Rows by largest remainder; of equal remainders the later name is served first."""
    exact = {name: rows * share for name, share in shares.items()}
    sizes = {name: math.floor(x) for name, x in exact.items()}
    ranked = sorted(shares, key=lambda name: (exact[name] - sizes[name], name), reverse=True)
    for name in ranked[: rows - sum(sizes.values())]:
        sizes[name] += 1
    return sizes


def seeded_splits(df: DataFrame, shares: Mapping[str, float], seed: int = 42, label: str = "label", row_id: str = "id") -> DataFrame:
    """df with split per label: ids ordered by their SHA-256, shuffled by the standard library's generator seeded
    with "seed:label", cut by allocate.

    Exactly this order needs one task for a label's ids, of which it sees nothing but (id); where a label is too
    large for that, use hashed_splits.
    """
    order = dict(shares)

    def assigned(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids = group.sort_values(["digest", "id"])["id"].tolist()
        Random(f"{seed}:{key[0]}").shuffle(ids)
        sizes = allocate(len(ids), order)
        return pd.DataFrame({"id": ids, "split": [s for s in SPLITS for _ in range(sizes.get(s, 0))]})

    ids = df.select(F.col(row_id).cast("string").alias("id"), F.col(label).alias("label"), F.sha2(F.col(row_id).cast("string"), 256).alias("digest"))
    splits = ids.groupBy("label").applyInPandas(assigned, "id string, split string")
    return df.drop("split").withColumn("_id", F.col(row_id).cast("string")).join(splits.withColumnRenamed("id", "_id"), "_id").drop("_id")


def hashed_splits(df: DataFrame, shares: Mapping[str, float], label: str = "label", row_id: str = "id", seed: int = 0) -> DataFrame:
    """df with split: of each label the exact number of rows that allocate gives, in the order of a seeded SHA-256.

    Labels are cut into 4096 parts by hash; only ranks inside parts are sorted, so a label may hold any share of
    the rows. Equal ids tie by nothing else and stay together in no promised order.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")), 256)
    keyed = df.drop("split").withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 3))
    sizes = keyed.groupBy(label, "_part").count()
    whole = Window.partitionBy(label)
    before = F.sum("count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select(F.col(label).alias("_label"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("count").over(whole).alias("_rows"))
    rank = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_digest", row_id))
    ranked = keyed.withColumn("_rank", rank).join(placed, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    names = [s for s in SPLITS if s in shares]
    exact = {s: F.col("_rows") * F.lit(float(shares[s])) for s in names}
    # Largest remainder in SQL: a split gains a row if fewer splits precede it by remainder than rows are left.
    remainder = {s: exact[s] - F.floor(exact[s]) for s in names}
    left = F.col("_rows") - sum(F.floor(exact[s]) for s in names)
    size = {s: F.floor(exact[s]) + (sum(((remainder[t] > remainder[s]) | ((remainder[t] == remainder[s]) & F.lit(t > s))).cast("int") for t in names if t != s) + F.lit(0) < left).cast("int") for s in names}
    position, split, edge = F.col("_before") + F.col("_rank"), F.lit(names[-1]), F.lit(0)
    edges = []
    for s in names:
        edge = edge + size[s]
        edges.append((s, edge))
    for s, e in reversed(edges[:-1]):
        split = F.when(position <= e, s).otherwise(split)
    return ranked.withColumn("split", split).drop("_digest", "_part", "_rank", "_label", "_p", "_before", "_rows")


def sample_per_group(df: DataFrame, per_class: int | None = None, per_split: int | Mapping[str, int] | None = None, row_id: str = "id") -> DataFrame:
    """The first rows of each (label, split) by SHA-256 of id, then id: at most per_class, and at most per_split of
    the split (a missing split: none); both mean the smaller."""
    limits = [F.lit(per_class)] if per_class is not None else []
    if isinstance(per_split, Mapping):
        table = F.create_map(*[F.lit(x) for pair in per_split.items() for x in pair]) if per_split else F.create_map().cast("map<string,int>")
        limits.append(F.coalesce(table[F.col("split")], F.lit(0)))
    elif per_split is not None:
        limits.append(F.lit(per_split))
    if not limits:
        return df
    by = Window.partitionBy("label", "split").orderBy(F.sha2(F.col(row_id).cast("string"), 256), row_id)
    most = max([per_class or 0, *(per_split.values() if isinstance(per_split, Mapping) else [per_split or 0])], default=0)
    # The constant bound lets each task keep few rows of a group before the shuffle.
    first = df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= most)
    return first.where(F.col("_rank") <= (F.least(*limits) if len(limits) > 1 else limits[0])).drop("_rank")


def split_overlaps_exact(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """One row: texts that stand in more than one split."""
    return df.groupBy(text).agg(F.min(split).alias("a"), F.max(split).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("shared_texts"))


def validation_groups(token_lists: Iterator[list[str]] | list, fraction: float, seed: int) -> tuple[list[int], list[int]]:
    """(train, validation) positions; lists of equal tokens stay together, max(2, round half up) groups are taken
    after a seeded shuffle, and two must be left."""
    groups: dict[tuple, list[int]] = {}
    for i, tokens in enumerate(token_lists):
        groups.setdefault(tuple(tokens), []).append(i)
    order = list(groups.values())
    JavaRandom(seed).shuffle(order)
    taken = max(2, math.floor(len(order) * fraction + 0.5))
    if len(order) - taken < 2:
        raise InvalidInput("too few distinct documents for a validation part")
    return sorted(i for g in order[taken:] for i in g), sorted(i for g in order[:taken] for i in g)
