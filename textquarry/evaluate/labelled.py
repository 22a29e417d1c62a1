"""Evaluation of retrieval on a labelled corpus: models see the training split alone, the test split asks.

A hit is right if it has the label of its query; TF-IDF and LSA answer the same queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.evaluate.retrieval import examples, label_precision, mean_precision
from textquarry.evaluate.silhouette import silhouette
from textquarry.models import lda, lsa
from textquarry.operators import terms
from textquarry.search.blocks import best_of_blocks, dense_rows, dense_scores, sparse_rows, sparse_scores
from textquarry.search.index import build_index
from textquarry.session import materialize

DENSE = 256  # terms of the most training rows, which are compared as columns of a matrix


def train_and_test(corpus: DataFrame, train: str = "train", test: str = "test") -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, label, split, tokens) that models may see, and those that ask; rows without label are in
    neither, nor are those of other splits."""
    known = corpus.where(F.col("label").isNotNull())
    return known.where(F.col("split") == train), known.where(F.col("split") == test)


def weighted_rows(rows: DataFrame, numbered: DataFrame, row_id: str) -> DataFrame:
    """(row_id, ids, values): the numbers and TF-IDF weights of each row's known terms; rows without any are left out.
    Terms grow with the corpus, so they are joined by shuffle even where Spark would have the driver send them."""
    raw = terms.term_frequencies(rows.where(F.col("doc_id").isNotNull())).join(numbered.hint("merge"), "term")
    pairs = F.collect_list(F.struct("term_id", ((1 + F.log("tf")) * F.col("idf")).alias("weight"))).alias("_t")
    return raw.groupBy(F.col("doc_id").alias(row_id)).agg(pairs).select(row_id, F.col("_t.term_id").alias("ids"), F.col("_t.weight").alias("values"))


def sparse_hits(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, cosine, rank): of each test row with a term of the training rows the k best training rows by
    TF-IDF cosine, to nine decimals, ties by id. Where fewer than k share a term the first other rows by id follow
    with 0; they are among the first 2k ids, which are a bounded list. Test rows grow with the corpus, so they are
    compared in blocks in the tasks; no term or row of either passes through the driver but DENSE terms."""
    weights = materialize(terms.idf(terms.document_frequencies(train), train.count()), "weights")
    first = terms.top_terms(weights, DENSE, "df").select("term", (F.col("rank") - 1).cast("long").alias("_first"))
    number = F.coalesce(F.col("_first"), F.monotonically_increasing_id() + DENSE).alias("term_id")
    numbered = materialize(weights.join(F.broadcast(first), "term", "left").select("term", "idf", number), "numbered")
    documents, asked = (materialize(weighted_rows(rows, numbered, c), "weighted") for rows, c in ((train, "doc_id"), (test, "query_id")))
    best = materialize(best_of_blocks(documents, asked, k, sparse_rows(DENSE), sparse_scores, digits=9, above=0.0), "best")
    few = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("doc_id").alias("met")).where(F.col("n") < k)
    first = train.select("doc_id").orderBy("doc_id").limit(2 * k)
    rest = few.join(F.broadcast(first.agg(F.array_sort(F.collect_list("doc_id")).alias("first"))))
    rest = rest.select("query_id", F.explode(F.array_except("first", "met")).alias("doc_id"), F.lit(0.0).alias("cosine"))
    return terms.ranked(best.drop("rank").unionByName(rest), k)


def dense_hits(model: lsa.Lsa, train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, cosine, rank): as `sparse_hits`, by cosine of the model's vectors; test rows without a known
    term or of zero length have no hit. Vectors of test rows do not pass through the driver."""
    known = materialize(lsa.transform(model, test).where("known_tokens > 0"), "known")
    asked = build_index(known)[0].withColumnRenamed("doc_id", "query_id")
    documents = build_index(materialize(lsa.transform(model, train), "vectors"), keep_zero=True)[0]
    return best_of_blocks(documents, asked, k, dense_rows, dense_scores)


def evaluate_labelled(corpus: DataFrame, dimensions: int = 50, max_features: int = 2000, k: int = 5) -> dict:
    """Precision and hit rate of TF-IDF and LSA over the test rows that have a term known from training, silhouettes of
    the test rows by LSA and by discriminants, and the hits of three queries.

    corpus: (doc_id, label, split, tokens). No known query is an error."""
    train, test = (materialize(rows, "split") for rows in train_and_test(corpus))
    labels = [test.select(F.col("doc_id").alias("query_id"), "label"), train.select("doc_id", "label")]
    model = lsa.fit(train, dimensions, max_features, unit=False)
    hits = {"tfidf": materialize(sparse_hits(train, test, k), "hits"), "lsa": materialize(dense_hits(model, train, test, k), "hits")}
    found = {name: mean_precision(label_precision(h, *labels, k), labels[0]).first().asDict() for name, h in hits.items()}
    if not found["tfidf"]["evaluated"]:
        raise InvalidInput("no test row has a term of the training rows")
    vectors = [lsa.transform(model, rows).join(rows.select("doc_id", "label"), "doc_id") for rows in (train, test)]
    by = {"lsa": silhouette(vectors[1])}
    if train.select("label").distinct().count() > 1:
        by["lda"] = silhouette(lda.transform(lda.fit(vectors[0]), vectors[1]).join(test.select("doc_id", "label"), "doc_id"))
    shown = [r.asDict() for r in examples(hits["lsa"]).join(hits["tfidf"].select("query_id", "doc_id", F.col("cosine").alias("tfidf_cosine")), ["query_id", "doc_id"], "left").collect()]
    return {"train": train.count(), "test": test.count(), "retrieval": found, "silhouette": by, "examples": shown}
