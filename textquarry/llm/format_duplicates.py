"""Problem 5: records that differ only in how they are written, collapsed with their copies counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import category, nfc
from textquarry.functions.words import INVISIBLE
from textquarry.operators.skew import lookup_join
from textquarry.session import materialize

# Fixed value: a misspelled label of the data.
SPELLINGS = {"neautral": "neutral"}
RUNS = r"[\p{L}\p{Nd}]+"


def canonical_runs(text):
    """Runs of letters and digits in lower case, in an array; invisible characters join, all others separate."""
    return F.regexp_extract_all(F.lower(nfc(F.translate(text, INVISIBLE, ""))), F.lit(RUNS), F.lit(0))


def canonical_json(text):
    """A JSON object whatever its order and spacing; text that is none stands for itself, marked as such."""
    parsed = F.to_json(F.try_parse_json(text))
    return F.when(text.isNotNull(), F.coalesce(parsed, F.concat(F.lit("?"), text)))


def _key(*columns):
    """128 bits for values that may be null."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def collapsed(df: DataFrame, record_id: str = "review_id", text: str = "review", label: str = "sentiment", attributes: str = "attrs", min_runs: int = 4) -> tuple[DataFrame, DataFrame]:
    """(records, members) of the groups of equal records.

    records: (kept_id, copies, raw_forms) with one row for each distinct record, singles included; kept_id is
    the smallest id. members: (kept_id, record_id) for each other record of a group. Byte-identical rows
    collapse first, so only distinct rows are canonicalised; then equal canonical records collapse, their
    counts summed. Both steps aggregate before the shuffle, and members find their group by a join that
    spreads hot groups. Null text or fewer than min_runs runs: the record does not count. Null labels and
    attributes equal only null.
    """
    rows = df.select(F.col(record_id).alias("_id"), F.col(text).alias("_text"), F.col(label).alias("_label"), F.col(attributes).alias("_attrs")).where("_text is not null and _id is not null")
    raw_key = _key("_text", "_label", "_attrs")
    raw = rows.groupBy("_text", "_label", "_attrs").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    forms = raw.withColumn("_runs", canonical_runs(F.col("_text"))).select(
        raw_key.alias("_raw"), "_first", "_copies", F.size("_runs").alias("_n"), F.array_join("_runs", " ").alias("_canonical"),
        category(F.col("_label"), SPELLINGS).alias("_sentiment"), canonical_json(F.col("_attrs")).alias("_attributes"),
    )
    # Written once: three steps read it, and a filter on it would otherwise be moved before the collapse, so that
    # every row would be canonicalised.
    forms = materialize(forms, "forms").where(F.col("_n") >= min_runs)
    canonical = ["_canonical", "_sentiment", "_attributes"]
    groups = forms.groupBy(*canonical).agg(F.min("_first").alias("kept_id"), F.sum("_copies").alias("copies"), F.count(F.lit(1)).alias("raw_forms"))
    repeated = groups.where("copies > 1").select(_key(*canonical).alias("_group"), "kept_id", "raw_forms")
    of_form = lookup_join(forms.select(_key(*canonical).alias("_group"), "_raw", "_copies"), repeated, "_group", "raw_forms", "_raw")
    members = lookup_join(rows.select("_id", raw_key.alias("_raw")), of_form.select("_raw", "kept_id", "_copies"), "_raw", "_copies", "_id")
    return groups.select("kept_id", "copies", "raw_forms"), members.where("_id <> kept_id").select("kept_id", F.col("_id").alias(record_id))
