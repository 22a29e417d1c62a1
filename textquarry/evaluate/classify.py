"""Classification metrics from a confusion matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, classes: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for each pair of classes, zero where none."""
    spark = df.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in classes for b in classes], "label string, prediction string")
    counts = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction")).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, ["label", "prediction"], "left").fillna(0, ["n"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of a confusion matrix; a ratio over zero is 0."""
    right = matrix.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("_right"))
    predicted = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("_predicted"))
    both = right.join(predicted, "label").withColumn("precision", _ratio(F.col("_right"), F.col("_predicted"))).withColumn("recall", _ratio(F.col("_right"), F.col("support")))
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return both.select("label", "precision", "recall", f1.alias("f1"), "support")


def summary(matrix: DataFrame) -> DataFrame:
    """One row: accuracy and the plain means of precision, recall and f1."""
    accuracy = matrix.agg(_ratio(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)), F.sum("n"))).scalar()
    means = class_report(matrix).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return means.select(accuracy.alias("accuracy"), "*")
