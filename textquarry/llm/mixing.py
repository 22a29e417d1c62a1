"""Problem 9: a mix of sources with target shares of tokens, small sources repeated up to a cap."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.encoding import DEFAULT_RANKS, token_counts
from textquarry.session import materialize


def sainte_lague(weights: dict, capacities: dict, seats: int) -> dict:
    """Seats by highest quotients weight / (2 seats + 1), none beyond its capacity; ties go to the smaller name.

    Most seats follow from a divisor at once; the last few are given one by one, as are those that a full
    party leaves to the others.
    """
    open_, given = {k: w for k, w in weights.items() if w > 0 and capacities.get(k, 0) > 0}, dict.fromkeys(weights, 0)
    while open_ and seats > 0:
        left, total = seats - sum(given.values()), sum(open_.values())
        if left <= 0:
            break
        goal = left + sum(given[k] for k in open_)
        # A party's seats differ from its even share by less than the number of parties: start safely below.
        start = {k: min(capacities[k], max(given[k], math.floor(w / total * goal) - len(open_))) for k, w in open_.items()}
        full = [k for k in open_ if start[k] >= capacities[k]]
        given |= start
        if full:
            for k in full:
                del open_[k]
            continue
        heap = [(-w / (2 * given[k] + 1), str(k), k) for k, w in open_.items()]
        heapq.heapify(heap)
        for _ in range(seats - sum(given.values())):
            _, name, k = heapq.heappop(heap)
            given[k] += 1
            if given[k] >= capacities[k]:
                del open_[k]
                break
            heapq.heappush(heap, (-open_[k] / (2 * given[k] + 1), name, k))
        else:
            break
    return given


def mix_sources(
    documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 0.5,
    ranks_file: str = DEFAULT_RANKS, blocks: int = 4_000, shard_tokens: int = 50_000_000, max_shards: int = 4096, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report): mix has (doc_id, source, tokens, copies) of each document in the mix, report
    (source, documents, tokens, target_share, max_repeats, mixed_tokens, actual_share, largest_share, met).

    The mix holds `share` of all tokens. Each source's documents are put in seeded random order within shards
    of about shard_tokens and cut into blocks of equal tokens (all tokens over `blocks`; a document belongs to
    the block in which it begins). Sainte-Laguë gives each source its blocks by target share, none more than
    max_repeats times its own, then each of its shards its part; in a shard every block is taken as often as
    the quota holds all, and seeded blocks once more for the rest. What a full source leaves goes to the others
    by their weights, so shares above target show in the report with the shortfalls.

    Null and empty texts have no tokens and are left out; sources without target, null ones included, count in
    the total but are not mixed. Targets are a short list given by the user (at most 10 000, else an error).
    """
    wanted = {t["source"]: t for t in targets.where("source is not null").limit(10_001).collect()}
    if len(wanted) > 10_000:
        raise ValueError("too many targets")
    kind = dict(documents.dtypes)[doc_id]
    sized = token_counts(documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_text")), "_text", ranks_file)
    sized = materialize(sized.select("doc_id", "source", "tokens"), "sized")
    of_source = F.broadcast(targets.select("source").distinct())
    total = sized.select(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    sums = {r["source"]: (r["documents"], r["tokens"]) for r in sized.join(of_source, "source").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")).collect()}
    block = max(1, total // blocks)
    spark = documents.sparkSession
    shards = spark.createDataFrame([(s, min(max_shards, 1 + tokens // shard_tokens)) for s, (_, tokens) in sums.items()], "source string, shards long")
    order = F.xxhash64(F.lit(seed), "doc_id", "tokens")
    placed = sized.where("tokens > 0").join(F.broadcast(shards), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), "shards")).withColumn("_order", order)
    by_shard = Window.partitionBy("source", "shard").orderBy("_order", "doc_id")
    begins = F.sum("tokens").over(by_shard.rowsBetween(Window.unboundedPreceding, -1))
    placed = materialize(placed.withColumn("block", F.floor(F.coalesce(begins, F.lit(0)) / block)).select("doc_id", "source", "tokens", "shard", "block"), "placed")
    stock = [tuple(r) for r in placed.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).collect()]
    own: dict[str, dict[int, int]] = {}
    for name, shard, tokens in stock:
        own.setdefault(name, {})[shard] = math.ceil(tokens / block)
    repeats = {s: max(0, t["max_repeats"] or 0) for s, t in wanted.items()}
    capacity = {s: repeats[s] * sum(own.get(s, {}).values()) for s in wanted}
    seats = sainte_lague({s: t["target_share"] or 0.0 for s, t in wanted.items()}, capacity, round(total * share / block))
    quotas = []
    for s, shards_ in own.items():
        by = sainte_lague(shards_, {k: repeats[s] * n for k, n in shards_.items()}, seats[s])
        quotas += [(s, k, by[k] // n, by[k] % n) for k, n in shards_.items()]
    quota = spark.createDataFrame(quotas, "source string, shard long, every int, extra int")
    names = placed.select("source", "shard", "block").distinct()
    counts = spark.createDataFrame([(s, k, n) for s, x in own.items() for k, n in x.items()], "source string, shard long, n_blocks int")
    # Blocks in which no document begins are drawn too: a long document stands for all the blocks it fills.
    drawn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks").cast("long") - 1)).alias("block")
    ranked = counts.select("source", "shard", drawn).withColumn("_rank", F.row_number().over(Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block")))
    copies = ranked.join(quota, ["source", "shard"]).select("source", "shard", "block", (F.col("every") + (F.col("_rank") <= F.col("extra")).cast("int")).alias("copies")).where("copies > 0")
    mix = placed.join(copies.join(names, ["source", "shard", "block"], "left_semi"), ["source", "shard", "block"]).select(F.col("doc_id").cast(kind), "source", "tokens", "copies")
    mixed = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    report = (
        spark.createDataFrame([(s, *sums.get(s, (0, 0)), t["target_share"], t["max_repeats"]) for s, t in wanted.items()], "source string, documents long, tokens long, target_share double, max_repeats int")
        .join(mixed, "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
        .withColumn("actual_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(1)))
        .withColumn("largest_share", F.col("max_repeats") * F.col("tokens") / F.lit(max(1.0, total * share)))
        .withColumn("met", F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01)
    )
    return mix, report
