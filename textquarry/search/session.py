"""A search over one corpus: prepare, train, index, answer; and evaluation of many models on one collection."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput, ModelExportError, ModelImportError
from textquarry.evaluate.retrieval import aggregate_metrics, query_metrics
from textquarry.functions.normalize import PROFILE, prepared_tokens
from textquarry.models import store
from textquarry.operators.dedup import load_corpus
from textquarry.operators.terms import ranked, sparse_cosines, term_frequencies, tfidf
from textquarry.search.index import build_index, dual_search, query_status, search, with_excerpts
from textquarry.session import materialize
from textquarry.sources.readers import read_corpus, read_judgments, read_queries, read_table
from textquarry.sources.sinks import checksum, write_json


@dataclass
class StageTimings:
    """Wall-clock seconds of named stages."""

    seconds: dict[str, float] = field(default_factory=dict)

    def run(self, name: str, step):
        began = time.perf_counter()
        out = step()
        self.seconds[name] = time.perf_counter() - began
        return out


@dataclass(frozen=True)
class SearchSession:
    algorithm: str
    model: object
    documents: DataFrame  # (doc_id, title, text)
    index: DataFrame
    zero: DataFrame

    def encode(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, text) with total_tokens, known_tokens, vec and status."""
        tokens = queries.select("query_id", "text", prepared_tokens(F.col("text")).alias("tokens"))
        vectors = store.backend(self.algorithm).transform(self.model, tokens, "query_id", "tokens").withColumnRenamed("doc_id", "query_id")
        return query_status(tokens.join(vectors, "query_id").withColumn("total_tokens", F.size("tokens")))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, status, known_tokens, total_tokens, hits): hits is empty unless the status is ok."""
        encoded = materialize(self.encode(queries), "queries")
        hits = with_excerpts(search(self.index, encoded.where("status = 'ok'").select("query_id", "vec"), k), self.documents)
        each = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "cosine", "excerpt"))).alias("hits")
        lists = hits.groupBy("query_id").agg(each)
        return encoded.join(lists, "query_id", "left").select("query_id", "status", "known_tokens", "total_tokens", F.coalesce("hits", F.array()).alias("hits"))


def tokenized(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("doc_id"), "title", "text", prepared_tokens(F.col("text")).alias("tokens"))


def open_session(algorithm: str, model, documents: DataFrame) -> SearchSession:
    """documents: (doc_id, title, text, tokens). All vectors zero is an error."""
    vectors = materialize(store.backend(algorithm).transform(model, documents, "doc_id", "tokens"), "vectors")
    index, zero = build_index(vectors)
    if index.isEmpty():
        raise InvalidInput("every document has a zero vector")
    return SearchSession(algorithm, model, documents.select("doc_id", "title", "text"), index, zero)


def train(spark: SparkSession, source: str, output: str, algorithm: str = "lsa", limit: int = 1000, **parameters) -> dict:
    """Read, prepare, train, index and save; returns the manifest with counters and seconds of each stage. The
    folder gets the documents too, so that it opens without the source."""
    if Path(output).exists():
        raise ModelExportError(f"{output} exists")
    backend, timings = store.backend(algorithm), StageTimings()

    def prepare():
        corpus, counters = load_corpus(read_corpus(spark, source), limit)
        return materialize(tokenized(corpus), "tokens"), counters.first().asDict()

    documents, counters = timings.run("preparation", prepare)
    tokens = documents.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    if not tokens:
        raise InvalidInput("no document has tokens after normalization")
    model = timings.run("training", lambda: backend.fit(documents, **parameters))
    session = timings.run("indexing", lambda: open_session(algorithm, model, documents))
    details = counters | {"tokens": tokens, "zero_documents": session.zero.count(), "seconds": timings.seconds, "source": source, "algorithm": algorithm}
    manifest = timings.run("saving", lambda: store.save(model, output, details, documents.select("doc_id", "title", "text")))
    return manifest


def open_model(spark: SparkSession, folder: str, algorithm: str | None = None) -> SearchSession:
    manifest = store.read_manifest(folder)
    model = store.load(spark, folder, algorithm)
    documents = spark.read.parquet(f"file://{Path(folder).resolve()}/documents")
    return open_session(manifest["kind"], model, materialize(documents.withColumn("tokens", prepared_tokens(F.col("text"))), "tokens"))


def read_collection(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(documents, queries, qrels, manifest) of a folder, if its checksums, profile, sizes and relations hold."""
    root = Path(folder)
    try:
        manifest = json.loads((root / "manifest.json").read_text("utf-8"))
        changed = [name for name, digest in manifest["sha256"].items() if checksum(root / name) != digest]
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise ModelImportError(f"{folder} is no collection") from e
    if changed or set(manifest["sha256"]) != {"corpus.csv", "queries.jsonl", "qrels.jsonl"}:
        raise ModelImportError(f"{folder}: changed: {', '.join(changed) or 'the list of files'}")
    if manifest.get("profile") != PROFILE or manifest.get("stop_words") != store.stop_word_hash():
        raise ModelImportError(f"{folder} was made with another normalization")
    documents = read_table(spark, f"file://{root.resolve()}/corpus.csv", ("id", "title", "text"))
    queries = read_queries(spark, f"file://{root.resolve()}/queries.jsonl")
    qrels = read_judgments(spark, f"file://{root.resolve()}/qrels.jsonl", queries)
    sizes = {"documents": documents.count(), "queries": queries.count(), "judgments": qrels.count()}
    if any(manifest.get(k) != n for k, n in sizes.items()):
        raise ModelImportError(f"{folder}: sizes are {sizes}")
    if documents.select("id").distinct().count() != sizes["documents"] or qrels.join(documents, qrels["doc_id"] == documents["id"], "left_anti").count() or queries.join(qrels, "query_id", "left_anti").count():
        raise ModelImportError(f"{folder}: documents, queries and judgments do not fit")
    return documents, queries, qrels, manifest


def _query_seconds(session: SearchSession, queries: DataFrame, most: int = 10_000) -> DataFrame:
    """(query_id, search_seconds): each query asked alone, from its text to its hits, and measured."""
    rows = queries.select("query_id", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise InvalidInput(f"more than {most} queries to time one by one")
    seconds = []
    for r in rows:
        began = time.perf_counter()
        session.search(session.documents.sparkSession.createDataFrame([tuple(r)], "query_id string, text string"), 10).collect()
        seconds.append((r["query_id"], time.perf_counter() - began))
    return session.documents.sparkSession.createDataFrame(seconds, "query_id string, search_seconds double")


def evaluate(spark: SparkSession, collection: str, models: dict[str, str], output: str | None = None, timed: bool = False) -> dict:
    """Metrics of each model folder over all queries of a collection, whose documents must be the model's own; all
    queries of a model are one job, and their seconds are null. With timed each query is asked once more, alone, and
    measured. With output, a new folder gets report.json and the rows per query."""
    if output and Path(output).exists():
        raise ModelExportError(f"{output} exists")
    documents, queries, qrels, manifest = read_collection(spark, collection)
    report, tables = {"collection": manifest, "models": {}}, {}
    for algorithm, folder in models.items():
        before = store.read_manifest(folder)
        timings = StageTimings()
        session = timings.run("open", lambda f=folder, a=algorithm: open_model(spark, f, a))
        same = session.documents.select(F.col("doc_id").alias("id"), "text").exceptAll(documents.select("id", "text")).isEmpty() and session.documents.count() == documents.count()
        if not same:
            raise InvalidInput(f"{folder} was trained on other documents")

        def measured(session=session):
            encoded = materialize(session.encode(queries), "queries")
            hits = ranked(search(session.index, encoded.where("status = 'ok'").select("query_id", "vec"), 10).drop("rank"), 10)
            return materialize(query_metrics(encoded.drop("vec", "tokens"), hits, qrels, session.zero), "metrics")

        rows = timings.run("search", measured)
        rows = rows.join(_query_seconds(session, queries), "query_id", "left") if timed else rows.withColumn("search_seconds", F.lit(None).cast("double"))
        summary = aggregate_metrics(rows).first().asDict()
        if store.read_manifest(folder) != before:
            raise InvalidInput(f"{folder} changed while it was evaluated")
        report["models"][algorithm] = {"folder": folder, "seconds": timings.seconds, "metrics": summary}
        tables[algorithm] = rows
    if output:
        Path(output).mkdir(parents=True)
        write_json(report, f"{output}/report.json")
        for algorithm, rows in tables.items():
            rows.write.parquet(f"file://{Path(output).resolve()}/{algorithm}")
    return report


def explain_query(session: SearchSession, sparse: DataFrame, text: str, discriminants=None, top: int = 10) -> dict:
    """What a query becomes: its heaviest terms (of a weight table doc_id, term, weight), its coordinates, and those
    by discriminants if a model of them is given. Unknown words alone are an error."""
    from textquarry.models import lda

    spark = session.documents.sparkSession
    encoded = session.encode(spark.createDataFrame([("query", text)], "query_id string, text string"))
    row = encoded.first()
    if row["status"] != "ok":
        raise InvalidInput(f"the query cannot be searched: {row['status']}")
    heavy = [(r["term"], r["weight"]) for r in sparse.orderBy(F.desc("weight"), "term").limit(top).collect()]
    out = {"terms": heavy, "coordinates": list(row["vec"])}
    if discriminants is not None:
        out["discriminants"] = list(lda.transform(discriminants, encoded, "query_id").first()["vec"])
    return out




def analyze(session: SearchSession, text: str, k: int = 5) -> dict:
    """What an LSA model makes of a query (its terms with weights, its coordinates), and the k documents nearest by
    LSA with their TF-IDF cosine beside, over the model's vocabulary."""
    if session.algorithm != "lsa":
        raise InvalidInput("only LSA models have terms with weights")
    spark = session.documents.sparkSession
    vocabulary = session.model.vocabulary
    asked = spark.createDataFrame([("query", text)], "query_id string, text string").select("query_id", prepared_tokens(F.col("text")).alias("tokens"))
    weights = tfidf(term_frequencies(asked, "query_id"), vocabulary).withColumnRenamed("doc_id", "query_id")
    explained = explain_query(session, weights, text, top=k)
    tokens = session.documents.select("doc_id", prepared_tokens(F.col("text")).alias("tokens"))
    sparse = sparse_cosines(weights, term_frequencies(tokens), vocabulary)
    hits = dual_search(session.index, session.encode(asked.withColumn("text", F.lit(text))).select("query_id", "vec"), sparse, k)
    rows = with_excerpts(hits, session.documents, 200).orderBy("rank").collect()
    return explained | {"documents": [r.asDict() for r in rows]}
