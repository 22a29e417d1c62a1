"""Multinomial naive Bayes over token counts, as grouped sums and one join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import ModelTrainingError
from textquarry.operators.terms import document_frequencies, term_frequencies, top_terms


@dataclass(frozen=True)
class NaiveBayes:
    classes: tuple[str, ...]
    priors: tuple[float, ...]
    terms: DataFrame  # (term, log_probability ARRAY<DOUBLE> in the order of classes)


def fit(docs: DataFrame, label: str = "label", tokens: str = "tokens", min_df: int = 2, max_features: int = 50_000, alpha: float = 1.0, max_classes: int = 1000) -> NaiveBayes:
    """Priors ln(n_c / N) without smoothing; ln((count + alpha) / (total + alpha V)) per class and term.

    The vocabulary is the max_features most frequent terms of at least min_df documents. Rows without label are
    left out; rows without known tokens count in the priors. The driver holds the classes alone.
    """
    import math

    usable = docs.where(F.col(label).isNotNull())
    counts = {r[label]: r["n"] for r in usable.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()}
    if not counts or len(counts) > max_classes:
        raise ModelTrainingError(f"labels are needed, {max_classes} at most; there are {len(counts)}")
    classes = tuple(sorted(counts))
    rows = sum(counts.values())
    kept = top_terms(document_frequencies(usable, tokens, min_df), max_features).select("term")
    each = usable.select(label, F.explode(tokens).alias("term")).groupBy("term").agg(*[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    each = each.join(kept, "term")
    sums = each.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(classes))]).first()
    if not sums["v"]:
        raise ModelTrainingError("no term is frequent enough")
    logs = [F.log((F.col(f"n{i}") + alpha) / F.lit(sums[f"n{i}"] + alpha * sums["v"])) for i in range(len(classes))]
    return NaiveBayes(classes, tuple(math.log(counts[c] / rows) for c in classes), each.select("term", F.array(*logs).alias("log_probability")))


def predict(model: NaiveBayes, docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, prediction, probabilities MAP): every row; without known tokens the priors decide. Of equal
    probabilities the earlier class wins."""
    known = term_frequencies(docs, doc_id, tokens).join(model.terms, "term")
    n = range(len(model.classes))
    sums = known.groupBy("doc_id").agg(*[F.sum(F.col("tf") * F.col("log_probability")[i]).alias(f"s{i}") for i in n])
    joined = docs.select(F.col(doc_id).alias("doc_id")).join(sums, "doc_id", "left")
    scores = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.lit(model.priors[i]) for i in n]
    scored = joined.select("doc_id", F.array(*scores).alias("s")).withColumn("m", F.array_max("s"))
    exp = scored.withColumn("e", F.transform("s", lambda x: F.exp(x - F.col("m"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(c) for c in model.classes])
    return exp.select("doc_id", F.element_at(names, F.array_position("s", F.col("m")).cast("int")).alias("prediction"), F.map_from_arrays(names, F.transform("e", lambda x: x / total)).alias("probabilities"))
