"""Named queries over the tables of a data folder: each shows an operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.evaluate.classify import class_report, confusion, summary
from textquarry.evaluate.labelled import evaluate_labelled, sparse_hits, train_and_test
from textquarry.evaluate.retrieval import aggregate_metrics, label_precision, mean_precision, query_metrics
from textquarry.evaluate.silhouette import silhouette
from textquarry.functions import text as T
from textquarry.functions.lexicon import STOP_WORDS
from textquarry.functions.normalize import prepared_tokens, vocabulary
from textquarry.models import cnn, lda, lsa, naive_bayes, word2vec
from textquarry.operators import dedup, splits, terms
from textquarry.search.index import build_index, query_status, search, with_excerpts
from textquarry.session import materialize, shared_path, spread
from textquarry.sources.readers import canonical_violations, read_table

SPELLINGS = {"neautral": "neutral"}
SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on at length."""
    return spread(table(spark, sf_dir, name))


def _clean(column: str):
    return T.without_words(T.normalized_tokens(F.col(column)), STOP_WORDS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of documents without stop words, written once as several steps read them."""
    return materialize(_texts(spark, sf_dir, "documents").select("doc_id", _clean("text").alias("tokens")), "tokens")


def _query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_evaluations").select("query_id", _clean("text").alias("tokens"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF cosines of all queries with all documents that share a term."""
    docs = _docs(spark, sf_dir)
    weights = terms.idf(terms.document_frequencies(docs), docs.count())
    weights = materialize(weights, "weights")
    queries = terms.tfidf(terms.term_frequencies(_query_tokens(spark, sf_dir), "query_id"), weights)
    return terms.sparse_cosines(queries.withColumnRenamed("doc_id", "query_id"), terms.term_frequencies(docs), weights)


def tfidf_search(spark, sf_dir):
    hits = terms.ranked(_sparse(spark, sf_dir).withColumn("cosine", F.round("cosine", 9)), 10)
    return hits.select("query_id", "doc_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def token_counts(spark, sf_dir):
    return _texts(spark, sf_dir, "documents").select("doc_id", F.size(T.normalized_tokens(F.col("text"))).cast("long").alias("n"))


def clean_token_counts(spark, sf_dir):
    return _texts(spark, sf_dir, "documents").select("doc_id", F.size(_clean("text")).cast("long").alias("n"))


def folded_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("title")).alias("folded"))


def without_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~T.has_tokens(F.col("text"))).select("doc_id")


def frequent_terms(spark, sf_dir):
    return terms.top_terms(terms.collection_frequencies(_docs(spark, sf_dir)), 100).select("term", "cf", F.col("rank").cast("long").alias("rank"))


def term_idf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return terms.idf(terms.document_frequencies(docs, least=3), docs.count()).select("term", "df", "cf", F.round("idf", 6).alias("idf"))


def tfidf_top_terms(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    weights = terms.tfidf(terms.term_frequencies(docs), terms.idf(terms.document_frequencies(docs), docs.count()))
    top = terms.ranked(weights.withColumn("weight", F.round("weight", 9)), 3, "doc_id", "weight", "term")
    return top.select("doc_id", "term", F.col("rank").cast("long").alias("rank"), F.round("weight", 6).alias("weight"))


def term_counts_by_language(spark, sf_dir):
    rows = _texts(spark, sf_dir, "documents").select("lang", F.explode(_clean("text")).alias("term"))
    return rows.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary_ids(spark, sf_dir):
    return terms.vocabulary_ids(terms.collection_frequencies(_docs(spark, sf_dir)), 2000, first_id=2).select("term", F.col("term_id").cast("long").alias("term_id"))


def query_coverage(spark, sf_dir):
    known = terms.collection_frequencies(_docs(spark, sf_dir))
    return terms.coverage(_query_tokens(spark, sf_dir), known, "query_id").withColumnRenamed("doc_id", "query_id")


def query_statuses(spark, sf_dir):
    rows = query_coverage(spark, sf_dir).select("query_id", F.col("known").alias("known_tokens"), F.col("total").alias("total_tokens"), F.array(F.lit(1.0)).alias("vec"))
    return query_status(rows).select("query_id", "known_tokens", "total_tokens", "status")


def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


def hashed_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.surrogate_id(F.col("text")).alias("id"))


def comparison_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.comparison_key(F.col("title")).alias("key"))


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "canonical_corpus").select("id", "text", "label", "split")


def canonical_checks(spark, sf_dir):
    return canonical_violations(_corpus(spark, sf_dir))


def deduplicated_keep(spark, sf_dir):
    return dedup.deduplicate(_corpus(spark, sf_dir).where("text is not null"), "keep", "majority", "drop").select("id", "label", "split")


def deduplicated_drop(spark, sf_dir):
    return dedup.deduplicate(_corpus(spark, sf_dir).where("text is not null"), "drop", "majority", "drop").select("id", "label", "split")


def majority_sentiment(spark, sf_dir):
    return dedup.majority_labels(table(spark, sf_dir, "reviews"), "review", "sentiment", SPELLINGS)


def majority_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c"), "o_orderstatus")
    return dedup.majority_labels(orders, "c", "o_orderstatus")


def majority_counts(spark, sf_dir):
    return dedup.majority_statistics(table(spark, sf_dir, "reviews"), "review", "sentiment", SPELLINGS)


def unrepeated_urls(spark, sf_dir):
    valid_ = (T.strip(F.coalesce("title", F.lit(""))) != "") & (T.strip(F.coalesce("text", F.lit(""))) != "")
    return dedup.unrepeated(table(spark, sf_dir, "lenta"), "url", valid_).select("row_id", "url")


def first_articles(spark, sf_dir):
    return dedup.first_of_text(table(spark, sf_dir, "lenta").select("row_id", "title", "text"), ["title", "text"], "row_id").select("row_id")


def hashed_articles(spark, sf_dir):
    rows = table(spark, sf_dir, "lenta").where("url is not null").groupBy("url").agg(F.min_by("topic", "row_id").alias("topic"))
    return dedup.top_by_hash(rows, ["topic"], "url", 250).select("topic", "url")


def articles_per_topic(spark, sf_dir):
    return dedup.distinct_per_group(table(spark, sf_dir, "lenta"), "topic", ["title", "text"])


def article_splits(spark, sf_dir):
    return splits.hashed_splits(table(spark, sf_dir, "lenta").select("row_id", T.category(F.col("topic")).alias("label")), SHARES, row_id="row_id").select("row_id", "label", "split")


def split_sizes(spark, sf_dir):
    return article_splits(spark, sf_dir).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def sampled_corpus(spark, sf_dir):
    return splits.sample_per_group(_corpus(spark, sf_dir), 20, {"train": 30, "test": 10}).select("id", "label", "split")


def shared_texts(spark, sf_dir):
    return splits.split_overlaps_exact(_corpus(spark, sf_dir))


def class_sizes(spark, sf_dir):
    return table(spark, sf_dir, "reviews").select(T.category(F.col("sentiment"), SPELLINGS).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def relevant_documents(spark, sf_dir):
    judged = table(spark, sf_dir, "qrels").where("score > 0")
    return table(spark, sf_dir, "documents").join(judged, "doc_id", "left_semi").select("doc_id", "source")


def background_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "qrels").where("score > 0"), "doc_id", "left_anti").select("doc_id")


def unknown_judgments(spark, sf_dir):
    return table(spark, sf_dir, "qrels").join(table(spark, sf_dir, "documents"), "doc_id", "left_anti").select("query_id", "doc_id")


def title_matches(spark, sf_dir):
    """Queries that are a document's title or its whole text, but for white space and case."""
    queries = table(spark, sf_dir, "query_evaluations").select("query_id", T.comparison_key(F.col("text")).alias("key"))
    keys = F.array_distinct(F.array(T.comparison_key(F.col("title")), T.comparison_key(F.col("text"))))
    documents = table(spark, sf_dir, "documents").select("doc_id", F.explode(keys).alias("key")).where("key <> ''")
    return queries.join(documents, "key").select("query_id", "doc_id").distinct()


def query_terms(spark, sf_dir):
    """The three heaviest terms of each query."""
    docs = _docs(spark, sf_dir)
    weights = terms.idf(terms.document_frequencies(docs), docs.count())
    asked = terms.tfidf(terms.term_frequencies(_query_tokens(spark, sf_dir), "query_id"), weights)
    top = terms.ranked(asked.withColumn("weight", F.round("weight", 9)), 3, "doc_id", "weight", "term")
    return top.select(F.col("doc_id").alias("query_id"), "term", F.col("rank").cast("long").alias("rank"), F.round("weight", 6).alias("weight"))


def _split_corpus(spark, sf_dir):
    rows = _texts(spark, sf_dir, "canonical_corpus")
    return rows.select(F.col("id").alias("doc_id"), T.category(F.col("label")).alias("label"), T.category(F.col("split")).alias("split"), _clean("text").alias("tokens"))


def split_hits(spark, sf_dir):
    """The nearest training rows of every test row by TF-IDF, fitted on the training rows alone."""
    train, test = (materialize(rows, "split") for rows in train_and_test(_split_corpus(spark, sf_dir)))
    hits = sparse_hits(train, test)
    return hits.select("query_id", "doc_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def split_precision(spark, sf_dir):
    train, test = (materialize(rows, "split") for rows in train_and_test(_split_corpus(spark, sf_dir)))
    asked = test.select(F.col("doc_id").alias("query_id"), "label")
    # Labels grow with the corpus: the hint keeps the driver from sending them.
    found = mean_precision(label_precision(sparse_hits(train, test), asked.hint("merge"), train.select("doc_id", "label").hint("merge")), asked)
    return found.select("evaluated", "skipped", F.round("precision", 6).alias("precision"), F.round("hit", 6).alias("hit"))


def table_round_trip(spark, sf_dir):
    """The canonical corpus written as a delimited table and read back by the reader of such tables."""
    path = shared_path(spark, "table")
    rows = _corpus(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[\r\n]", " "))
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_table(spark, path, ("id", "text", "label", "split"), ",").select("id", "text", "label", "split")


def json_attributes(spark, sf_dir):
    row = F.from_json("attrs", "size string, height bigint, weight bigint, fit string, gift boolean")
    return table(spark, sf_dir, "reviews").where("attrs is not null").select(row.alias("a")).groupBy("a.size", "a.fit").agg(F.count(F.lit(1)).alias("n"), F.sum("a.height").alias("height"), F.count("a.gift").alias("gifts"))


def _labelled(spark, sf_dir):
    """Reviews with tokens, class and a split by hash: a fifth is for testing."""
    rows = _texts(spark, sf_dir, "reviews").select("review_id", T.category(F.col("sentiment"), SPELLINGS).alias("label"), T.normalized_tokens(F.col("review")).alias("tokens"))
    return rows.where("label is not null").withColumn("test", F.substring(F.sha2(F.col("review_id").cast("string"), 256), 1, 1).isin("0", "1", "2"))


def _bayes(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return naive_bayes.fit(rows.where("not test")), rows.where("test")


def bayes_terms(spark, sf_dir):
    model, _ = _bayes(spark, sf_dir)
    return model.terms.select("term", F.posexplode("log_probability")).select("term", F.element_at(F.array(*map(F.lit, model.classes)), F.col("pos") + 1).alias("label"), F.round("col", 6).alias("log_probability"))


def _predicted(spark, sf_dir):
    model, rows = _bayes(spark, sf_dir)
    found = naive_bayes.predict(model, rows, "review_id").withColumnRenamed("doc_id", "review_id")
    return model, found.join(rows.select("review_id", "label"), "review_id")


def bayes_predictions(spark, sf_dir):
    return _predicted(spark, sf_dir)[1].select("review_id", "label", "prediction")


def bayes_confusion(spark, sf_dir):
    model, rows = _predicted(spark, sf_dir)
    return confusion(rows, model.classes)


def bayes_report(spark, sf_dir):
    return class_report(bayes_confusion(spark, sf_dir)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def bayes_summary(spark, sf_dir):
    return summary(bayes_confusion(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


def _vectors(spark, sf_dir):
    return build_index(table(spark, sf_dir, "vectors"), "vec_id", dimensions=64, strict=False)[0]


def vector_search(spark, sf_dir):
    index = _vectors(spark, sf_dir)
    hits = search(index, index.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 5, exclude_same=True)
    return hits.select("query_id", "doc_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def _label_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    queries = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    hits = search(build_index(rows)[0], queries.select("query_id", "vec"), 5, exclude_same=True)
    return label_precision(hits, queries.select("query_id", "label"), rows.select("doc_id", "label")), queries


def label_precisions(spark, sf_dir):
    return _label_hits(spark, sf_dir)[0].select("query_id", "precision", F.col("hit").cast("long").alias("hit"))


def mean_label_precision(spark, sf_dir):
    return mean_precision(*_label_hits(spark, sf_dir)).select("evaluated", "skipped", F.round("precision", 6).alias("precision"), F.round("hit", 6).alias("hit"))


def retrieval_metrics(spark, sf_dir):
    hits = terms.ranked(_sparse(spark, sf_dir).withColumn("cosine", F.round("cosine", 9)), 10)
    queries = query_statuses(spark, sf_dir).select("query_id", "status")
    rows = query_metrics(queries, hits, table(spark, sf_dir, "qrels").where("score > 0"))
    return rows.select("query_id", F.round("recall5", 6).alias("recall5"), F.round("rr10", 6).alias("rr10"), "loss_reason")


def evaluation_summary(spark, sf_dir):
    out = aggregate_metrics(table(spark, sf_dir, "query_evaluations"))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("recall5", "mrr10", "coverage", "mean_seconds", "p95_seconds")], "hit5", "hit10", "known_tokens", "total_tokens")


def loss_reasons(spark, sf_dir):
    return aggregate_metrics(table(spark, sf_dir, "query_evaluations")).select(F.explode("loss_reasons").alias("reason", "n"))


def embedding_silhouette(spark, sf_dir):
    found = silhouette(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec"))
    return spark.createDataFrame([(round(found["value"], 6), found["rows"])], "silhouette double, n long")


# The queries below have no SQL: the stemmer, decompositions and training loops are tested on fixtures.


def stemmed_vocabulary(spark, sf_dir):
    rows = vocabulary(_texts(spark, sf_dir, "lenta").select("row_id", F.concat_ws("\n", "title", "text").alias("content")), "content")
    return rows.select("row_id", F.explode("normalized").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def loaded_corpus(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.coalesce("author_id", F.concat(F.lit("#"), "doc_id")).alias("id"), "title", "text", F.col("doc_id").alias("seq"))
    return dedup.load_corpus(rows, 1_000_000_000)[0].select("id", "seq")


def _prepared(spark, sf_dir):
    return materialize(_texts(spark, sf_dir, "documents").select("doc_id", "source", "title", "text", prepared_tokens(F.col("text")).alias("tokens")), "prepared")


def lsa_singular_values(spark, sf_dir):
    model = lsa.fit(_prepared(spark, sf_dir), 50)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(model.singular_values)], "component int, value double")


def lsa_search(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    model = lsa.fit(rows, 50)
    queries = table(spark, sf_dir, "query_evaluations").select("query_id", prepared_tokens(F.col("text")).alias("tokens"))
    encoded = lsa.transform(model, queries, "query_id").withColumnRenamed("doc_id", "query_id")
    hits = search(build_index(lsa.transform(model, rows))[0], encoded.select("query_id", "vec"), 10)
    return with_excerpts(hits, rows)


def labelled_evaluation(spark, sf_dir):
    """TF-IDF and LSA over the test split, with silhouettes."""
    found = evaluate_labelled(_split_corpus(spark, sf_dir))
    rows = [(name, r["evaluated"], r["skipped"], r["precision"], r["hit"], found["silhouette"].get("lsa", {}).get("value") if name == "lsa" else None) for name, r in found["retrieval"].items()]
    return spark.createDataFrame(rows, "model string, evaluated long, skipped long, precision double, hit double, silhouette double")


def topic_terms(spark, sf_dir):
    return lsa.topic_terms(lsa.fit(_prepared(spark, sf_dir), 10))


def discriminants(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    vectors = lsa.transform(lsa.fit(rows, 50, unit=False), rows).join(rows.select("doc_id", F.col("source").alias("label")), "doc_id")
    return lda.transform(lda.fit(vectors), vectors)


def word_vector_documents(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    return word2vec.transform(word2vec.fit(rows, partitions=8), rows)


def cnn_documents(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    return cnn.transform(cnn.fit(rows), rows, whole=True)


_HELPERS = {"table"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in (*_HELPERS, "queries")}
    return own
