"""Term statistics of token arrays: frequencies, document frequencies, weights and vocabularies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import materialize


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
            counts = [Counter(t) if t else {} for t in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(batch.num_rows), [len(c) for c in counts])
            columns = [pa.array([x for c in counts for x in part(c)], kind) for part, kind in ((dict.keys, pa.string()), (dict.values, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], ["doc_id", "term", "tf"])


def term_frequencies(docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, term, tf) of each row, counted where the row is, without a shuffle; a document is one row. Null
    and empty arrays have no terms."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("tokens"))
    return rows.mapInArrow(_counted, f"doc_id {dict(rows.dtypes)['doc_id']}, term string, tf long")


def collection_frequencies(docs: DataFrame, tokens: str = "tokens", least: int = 1) -> DataFrame:
    """(term, cf) of terms that occur at least so often; counts combine before the shuffle."""
    return docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf")).where(F.col("cf") >= least)


def document_frequencies(docs: DataFrame, tokens: str = "tokens", least: int = 1) -> DataFrame:
    """(term, df, cf): the counts of each row are summed up before the shuffle."""
    rows = term_frequencies(docs.select(F.lit(0).alias("doc_id"), tokens), "doc_id", tokens)
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= least)


def idf(frequencies: DataFrame, documents) -> DataFrame:
    """frequencies with idf = ln((1 + N) / (1 + df)) + 1; documents is N, a number or a column."""
    n = documents if not isinstance(documents, int) else F.lit(documents)
    return frequencies.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def tfidf(frequencies: DataFrame, weights: DataFrame, sublinear: bool = True) -> DataFrame:
    """(doc_id, term, tf, weight): (1 + ln tf) or tf, times idf, over the Euclidean norm of the document's known
    terms. Terms without idf are left out; documents without known terms have no rows."""
    scale = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = frequencies.join(weights.select("term", "idf"), "term").withColumn("weight", scale * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return raw.withColumn("weight", F.when(norm > 0, F.col("weight") / norm).otherwise(0.0)).select("doc_id", "term", "tf", "weight")


def top_terms(frequencies: DataFrame, n: int, by: str = "cf") -> DataFrame:
    """The n most frequent terms with their rank from 1; equal ones in order of the term. A top-n, so each task
    passes on n rows at most before the ranks are given to n rows in one."""
    first = frequencies.orderBy(F.desc(by), "term").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "term")))


def vocabulary_ids(frequencies: DataFrame, n: int, first_id: int = 0, alphabetic: bool = False, by: str = "cf") -> DataFrame:
    """(term, term_id, ...) of the top n: ids by rank, or in alphabetical order."""
    top = top_terms(frequencies, n, by)
    order = F.row_number().over(Window.orderBy("term")) if alphabetic else F.col("rank")
    return top.withColumn("term_id", order - 1 + first_id).drop("rank")


def coverage(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, known, total): occurrences of tokens that the vocabulary has, and of all; every row comes out."""
    known = vocabulary.select("term", F.lit(1).alias("_known"))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(tokens).alias("term")).join(known, "term", "left")
    return each.groupBy("doc_id").agg(F.count("_known").alias("known"), F.count("term").alias("total"))


def sparse_cosines(queries: DataFrame, documents: DataFrame, weights: DataFrame, sublinear: bool = True, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(query_id, doc_id, cosine) of unit query weights (query_id, term, weight) and term frequencies (doc_id, term, tf)
    of documents, for pairs with a common term.

    Queries are a stated set: up to broadcast_rows of their terms go to every task, where documents are scored
    without moving their terms; more are joined by term. Only the lengths of documents need the weights of all terms."""
    scale = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    asked = queries.select("query_id", "term", F.col("weight").alias("_q")).join(weights.select("term", "idf"), "term")
    asked = materialize(asked, "asked")
    if asked.count() <= broadcast_rows:
        asked = F.broadcast(asked)
    scores = documents.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * scale * F.col("idf")).alias("_s"))
    raw = documents.join(weights.select("term", "idf"), "term").withColumn("_w", scale * F.col("idf"))
    lengths = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return scores.join(lengths, "doc_id").select("query_id", "doc_id", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(0.0).alias("cosine"))


def ranked(scores: DataFrame, k: int, group: str = "query_id", score: str = "cosine", tie: str = "doc_id") -> DataFrame:
    """The k best of each group by score, then by tie, with rank from 1; tasks keep k of a group before the shuffle."""
    by = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
