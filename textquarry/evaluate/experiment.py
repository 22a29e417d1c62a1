"""The experiment on sentiment: clean, split, fit each normalization, choose on validation, judge once on test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.evaluate.classify import class_report, confusion, summary
from textquarry.functions.normalize import vocabulary
from textquarry.models import naive_bayes
from textquarry.operators.dedup import majority_labels
from textquarry.operators.splits import hashed_splits
from textquarry.session import materialize

SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def measured(model: naive_bayes.NaiveBayes, rows: DataFrame) -> tuple[dict, DataFrame]:
    """(metrics, confusion matrix) of a model over rows (doc_id, label, tokens)."""
    found = naive_bayes.predict(model, rows).join(rows.select("doc_id", "label"), "doc_id")
    matrix = materialize(confusion(found, model.classes), "confusion")
    return summary(matrix).first().asDict(), matrix


def sentiment_experiment(reviews: DataFrame, text: str = "review", label: str = "sentiment", spellings: Mapping[str, str] | None = None, methods: Sequence[str] = ("none", "stem"), shares: Mapping[str, float] = SHARES) -> tuple[dict, naive_bayes.NaiveBayes, DataFrame]:
    """(report, model, confusion matrix). The text's most frequent label is its label, tied texts are out; splits are
    of exact sizes per label. Each method's macro F1 on the validation rows decides, of equal ones the first; only
    the chosen model meets the test rows. One label alone, or no validation rows, is an error."""
    cleaned = majority_labels(reviews, text, label, dict(spellings or {})).select(F.sha2("text", 256).alias("doc_id"), "text", "label")
    rows = materialize(hashed_splits(cleaned, shares, row_id="doc_id"), "experiment")
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    if not sizes.get("validation") or rows.select("label").distinct().count() < 2:
        raise InvalidInput("two labels and validation rows are needed")
    models, metrics = {}, {}
    for method in methods:
        tokens = materialize(vocabulary(rows, "text", method).withColumn("tokens", F.col("normalized")).select("doc_id", "label", "split", "tokens"), "tokens")
        model = naive_bayes.fit(tokens.where("split = 'train'"))
        models[method] = model, tokens
        metrics[method] = measured(model, tokens.where("split = 'validation'"))[0]
    chosen = max(methods, key=lambda m: (metrics[m]["macro_f1"], -list(methods).index(m)))
    model, tokens = models[chosen]
    test, matrix = measured(model, tokens.where("split = 'test'"))
    classes = {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in class_report(matrix).collect()}
    return {"sizes": sizes, "validation": metrics, "chosen": chosen, "test": test, "classes": classes}, model, matrix
