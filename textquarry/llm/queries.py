"""Queries p1_ to p10_ over the tables of a data folder, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import category
from textquarry.llm.encoding import encode_corpus
from textquarry.llm.format_duplicates import SPELLINGS, collapsed
from textquarry.llm.leakage import leaked_items
from textquarry.llm.mixing import mix_sources
from textquarry.llm.near_duplicates import near_duplicates, pairs_within_classes
from textquarry.llm.reading_level import reading_levels
from textquarry.llm.split_overlap import overlap_report, overlapping_rows, passage_coverage, split_overlaps
from textquarry.llm.target_sample import draw_sample, plan_sample
from textquarry.llm.term_frequency import term_frequencies
from textquarry.llm.vector_neighbors import nearest_vectors, similar_pairs
from textquarry.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _large(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are worked on at length."""
    return spread(_table(spark, sf_dir, name))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _large(spark, sf_dir, "documents").select("text").unionByName(_large(spark, sf_dir, "canonical_corpus").select("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_records(spark, sf_dir)).where("mark is not null").select("term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_records(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(p2_neighbors(spark, sf_dir), 0.85)


def p2_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(_large(spark, sf_dir, "vectors"), k=5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_duplicates(_large(spark, sf_dir, "lenta"), width=3, threshold=0.5, min_words=20)
    return pairs_within_classes(classes)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_large(spark, sf_dir, "lenta"), width=3, threshold=0.5, min_words=20)[0]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping_rows(*split_overlaps(_large(spark, sf_dir, "canonical_corpus")))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = split_overlaps(_large(spark, sf_dir, "canonical_corpus"))
    return overlap_report(links, members, passage_coverage(members))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(_large(spark, sf_dir, "reviews"))[1]


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(_large(spark, sf_dir, "reviews"))[0]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leaked_items(_large(spark, sf_dir, "documents"), _table(spark, sf_dir, "query_evaluations"))
    return leaks.where("shared_run >= 8").select("query_id", "doc_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_large(spark, sf_dir, "documents"), _table(spark, sf_dir, "query_evaluations"))


def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both datasets: category as the targets have it, and the year as stratum."""
    lenta, reviews = _table(spark, sf_dir, "lenta"), _table(spark, sf_dir, "reviews")
    year = F.regexp_extract("date", r"(\d{4})", 1)
    return lenta.select(F.lit("lenta").alias("dataset"), category(F.col("topic")).alias("category"), year.alias("stratum"), F.col("row_id")).unionByName(
        reviews.select(F.lit("reviews").alias("dataset"), category(F.col("sentiment"), SPELLINGS).alias("category"), F.year("created_at").cast("string").alias("stratum"), F.col("review_id").alias("row_id"))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = plan_sample(_sample_rows(spark, sf_dir), _table(spark, sf_dir, "sample_targets"))
    return report.where("shortfall > 0").select("dataset", "category")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_sample(_sample_rows(spark, sf_dir), _table(spark, sf_dir, "sample_targets"))[1]


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sample_rows(spark, sf_dir)
    quotas, _ = plan_sample(rows, _table(spark, sf_dir, "sample_targets"))
    return draw_sample(rows, quotas)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_large(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_large(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_large(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading_levels(_large(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_labels"))
    return levels.where("band = 5 and words >= 40").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(_large(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
