"""Word vectors, and documents as their weighted sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput, ModelTrainingError
from textquarry.operators.terms import document_frequencies, idf, term_frequencies
from textquarry.session import materialize


@dataclass(frozen=True)
class WordVectors:
    vectors: DataFrame  # (term, vec ARRAY<DOUBLE>, idf)
    dimensions: int


def fit(docs: DataFrame, dimensions: int = 50, epochs: int = 3, window: int = 5, min_count: int = 2, seed: int = 42, tokens: str = "tokens", partitions: int = 1) -> WordVectors:
    """Skip-gram vectors with hierarchical softmax. One partition gives the same vectors each time; more train in
    parallel. idf is counted over all rows."""
    if min(dimensions, epochs, window, min_count, partitions) < 1:
        raise InvalidInput("all parameters are positive")
    from pyspark.ml.functions import vector_to_array

    ordered = docs.select(tokens).orderBy(F.xxhash64(tokens)) if partitions == 1 else docs.select(tokens)
    try:
        model = Word2Vec(vectorSize=dimensions, minCount=min_count, windowSize=window, maxIter=epochs, seed=seed, stepSize=0.025, numPartitions=partitions, maxSentenceLength=1_000_000, inputCol=tokens, outputCol="_v").fit(ordered)
    except Exception as e:
        raise ModelTrainingError("no word is frequent enough") from e
    vectors = model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec"))
    weights = idf(document_frequencies(docs, tokens), docs.count()).select("term", "idf")
    return WordVectors(materialize(vectors.join(weights, "term"), "words"), dimensions)


def transform(model: WordVectors, docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, vec, known_tokens): the sum of tf * idf * vector of known terms, scaled to length 1; zeros for rows
    without known tokens or of length zero."""
    known = term_frequencies(docs, doc_id, tokens).join(model.vectors, "term")
    n = range(model.dimensions)
    sums = known.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("known_tokens"), *[F.sum(F.col("tf") * F.col("idf") * F.col("vec")[i]).alias(f"v{i}") for i in n])
    whole = docs.select(F.col(doc_id).alias("doc_id")).join(sums, "doc_id", "left").select("doc_id", F.coalesce("known_tokens", F.lit(0)).alias("known_tokens"), F.array(*[F.coalesce(F.col(f"v{i}"), F.lit(0.0)) for i in n]).alias("vec"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return whole.withColumn("_length", length).select("doc_id", F.when(F.col("_length") > 0, F.transform("vec", lambda x: x / F.col("_length"))).otherwise(F.col("vec")).alias("vec"), "known_tokens")
