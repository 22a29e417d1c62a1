"""Retrieval metrics over a table of hits; every query counts, found or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_metrics(queries: DataFrame, hits: DataFrame, qrels: DataFrame, zero: DataFrame | None = None) -> DataFrame:
    """queries with recall5, rr10 and loss_reason.

    queries: query_id, status and whatever else; hits: query_id, doc_id, rank; qrels: query_id, doc_id with score
    above 0. loss_reason of recall below 1: the status if not ok, else zero_relevant_document if a relevant
    document has a zero vector, else ranking.
    """
    relevant = qrels.where("score > 0").select("query_id", "doc_id").distinct() if "score" in qrels.columns else qrels.select("query_id", "doc_id").distinct()
    met = relevant.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    if zero is not None:
        met = met.join(zero.select("doc_id", F.lit(True).alias("_zero")), "doc_id", "left")
    else:
        met = met.withColumn("_zero", F.lit(None).cast("boolean"))
    sums = met.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("relevant"), F.count_if(F.col("rank") <= 5).alias("_five"), F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("_first"),
        F.coalesce(F.bool_or("_zero"), F.lit(False)).alias("_zero"),
    )
    each = queries.join(sums, "query_id", "left")
    recall = F.coalesce(F.col("_five") / F.col("relevant"), F.lit(0.0))
    reason = F.when(F.col("recall5") == 1, "none").when(F.col("status") != "ok", F.col("status")).when(F.col("_zero"), "zero_relevant_document").otherwise("ranking")
    return each.withColumn("recall5", recall).withColumn("rr10", F.coalesce(1 / F.col("_first"), F.lit(0.0))).withColumn("loss_reason", reason).drop("_five", "_first", "_zero")


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """One row over all queries: means of recall5 and rr10, queries with hits in 5 and 10, token coverage, mean and
    95th percentile (nearest rank) of search_seconds, and maps of statuses and loss reasons in key order."""
    def histogram(column: str):
        counts = metrics.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n"))))).scalar()

    tokens = F.sum("total_tokens")
    out = metrics.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("recall5").alias("recall5"), F.avg("rr10").alias("mrr10"), F.count_if(F.col("recall5") > 0).alias("hit5"),
        F.count_if(F.col("rr10") > 0).alias("hit10"), F.sum("known_tokens").alias("known_tokens"), tokens.alias("total_tokens"),
        F.when(tokens > 0, F.sum("known_tokens") / tokens).otherwise(0.0).alias("coverage"), F.avg("search_seconds").alias("mean_seconds"),
        F.expr("percentile_disc(0.95) within group (order by search_seconds)").alias("p95_seconds"),
    )
    return out.select("*", histogram("status").alias("statuses"), histogram("loss_reason").alias("loss_reasons"))


def label_precision(hits: DataFrame, query_labels: DataFrame, doc_labels: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, hit): documents of the query's own label among its first k, over k however few there
    are. Queries without hits do not count."""
    labels = hits.where(F.col("rank") <= k).join(query_labels.select("query_id", F.col("label").alias("_q")), "query_id").join(doc_labels.select("doc_id", F.col("label").alias("_d")), "doc_id")
    return labels.groupBy("query_id").agg((F.count_if(F.col("_q") == F.col("_d")) / k).alias("precision")).withColumn("hit", (F.col("precision") > 0).cast("int"))


def mean_precision(precision: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: evaluated and skipped queries, mean precision and hit rate over the evaluated."""
    out = precision.agg(F.count(F.lit(1)).alias("evaluated"), F.avg("precision").alias("precision"), F.avg("hit").alias("hit"))
    return out.select("evaluated", (queries.agg(F.count(F.lit(1))).scalar() - F.col("evaluated")).alias("skipped"), "precision", "hit")


def examples(hits: DataFrame, n: int = 3) -> DataFrame:
    """The hits of the first n queries by id; a report, as the limit says."""
    first = hits.select("query_id").distinct().orderBy("query_id").limit(n)
    return hits.join(F.broadcast(first), "query_id", "left_semi").orderBy("query_id", "rank")
