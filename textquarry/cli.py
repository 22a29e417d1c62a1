"""Command line: prepare, vocabulary, train, search, topics, analyze, subset, evaluate, evaluate-labels, experiment,
classify. Exit 0, 1 on an error of
execution, 2 on wrong arguments; results go to standard output, errors to standard error."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import functions as F

from textquarry.errors import InvalidInput, QuarryError
from textquarry.session import build_session
from textquarry.sources.readers import query_text
from textquarry.sources.sinks import render

_OF = {"lsa": {"dimensions", "max_features"}, "word2vec": {"dimensions", "epochs", "min_count", "window", "seed"}, "cnn": {"dimensions", "epochs", "min_count", "max_features", "seed", "filters", "width", "max_length", "batch", "sampling", "validation", "learning_rate", "temperature"}}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textquarry")
    p.add_argument("--format", choices=("text", "json", "pretty-json"), default="text")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name, *required, **optional):
        c = commands.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            c.add_argument(f"--{o.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return c

    command("vocabulary", text=None, file=None, method="stem", stopwords=None, synonyms=None)
    command("prepare", "input", "output", "config")
    t = command("train", "input", "output", limit=1000)
    t.add_argument("--algorithm", choices=sorted(_OF), default="lsa")
    for name, kind in {**dict.fromkeys(("dimensions", "max-features", "epochs", "min-count", "window", "seed", "filters", "width", "max-length", "batch"), int), **dict.fromkeys(("validation", "learning-rate", "temperature"), float), "sampling": str}.items():
        t.add_argument(f"--{name}", type=kind)
    command("search", "model", query=None, file=None, top=5, algorithm=None)
    command("topics", "model", top=10)
    command("analyze", "model", query=None, file=None, top=5)
    command("evaluate-labels", "input", dimensions=50, max_features=2000)
    command("experiment", "input", "output")
    command("subset", "corpus", "queries", "qrels", "output", documents=10_000, query_count=500, seed=42)
    command("evaluate", "collection", lsa_model=None, word2vec_model=None, cnn_model=None, output=None).add_argument("--timed", action="store_true")
    command("classify", "input", "model", text=None, file=None)
    return p


def run(args: argparse.Namespace) -> dict:
    from textquarry.search import session as sessions

    spark = build_session("textquarry")
    spark.sparkContext.setLogLevel("ERROR")
    match args.command:
        case "vocabulary":
            from textquarry.functions.lexicon import STOP_WORDS, read_stop_words, read_synonyms
            from textquarry.functions.normalize import vocabulary

            stop = STOP_WORDS if args.stopwords == "default" else read_stop_words(args.stopwords) if args.stopwords else None
            if args.synonyms and args.synonyms != "default":
                read_synonyms(args.synonyms)
            import json

            from textquarry.functions.lexicon import SYNONYMS

            groups = SYNONYMS if args.synonyms == "default" else {g["canonical"]: g["variants"] for g in json.load(open(args.synonyms, encoding="utf-8"))["groups"]} if args.synonyms else None
            row = vocabulary(spark.createDataFrame([(query_text(args.text, args.file),)], "text string"), "text", args.method, stop, groups).first()
            return {"tokens": row["original"], "normalized": row["normalized"], "frequencies": dict(sorted(row["frequencies"].items())), "steps": row["steps"]}
        case "prepare":
            from textquarry.operators.prepare import load_config, prepare_file

            return prepare_file(spark, args.input, args.output, load_config(args.config))
        case "train":
            names = {n.replace("-", "_") for n in ("dimensions", "max-features", "epochs", "min-count", "window", "seed", "filters", "width", "max-length", "batch", "validation", "learning-rate", "temperature", "sampling")}
            given = {n: v for n in names if (v := getattr(args, n)) is not None}
            foreign = set(given) - _OF[args.algorithm]
            if foreign:
                raise InvalidInput(f"not for {args.algorithm}: {', '.join(sorted(foreign))}")
            if args.algorithm == "cnn":
                from textquarry.models.cnn import CnnParameters

                given = {"parameters": CnnParameters(**given)}
            return sessions.train(spark, args.input, args.output, args.algorithm, args.limit, **given)["details"]
        case "search":
            text = query_text(args.query, args.file)
            row = sessions.open_model(spark, args.model, args.algorithm).search(spark.createDataFrame([("query", text)], "query_id string, text string"), args.top).first()
            return {"status": row["status"], "known_tokens": row["known_tokens"], "total_tokens": row["total_tokens"], "hits": [h.asDict() for h in row["hits"]]}
        case "topics":
            from textquarry.models import lsa, store

            rows = lsa.topic_terms(store.load(spark, args.model, "lsa"), args.top).orderBy("component", "side", "rank").collect()
            out: dict = {}
            for r in rows:
                out.setdefault(f"{r['component']} {r['side']}", []).append(r["term"])
            return out
        case "analyze":
            return sessions.analyze(sessions.open_model(spark, args.model, "lsa"), query_text(args.query, args.file), args.top)
        case "evaluate-labels":
            from textquarry.evaluate.labelled import evaluate_labelled
            from textquarry.functions.normalize import prepared_tokens
            from textquarry.sources.readers import read_canonical

            corpus = read_canonical(spark, args.input).select(F.col("id").alias("doc_id"), "label", "split", prepared_tokens(F.col("text")).alias("tokens"))
            return evaluate_labelled(corpus, args.dimensions, args.max_features)
        case "experiment":
            from pathlib import Path

            from textquarry.evaluate.experiment import sentiment_experiment
            from textquarry.models import store
            from textquarry.sources.readers import read_reviews
            from textquarry.sources.sinks import write_json

            report, model, matrix = sentiment_experiment(read_reviews(spark, args.input), spellings={"neautral": "neutral"})
            store.save(model, args.output, report)
            write_json(report | {"confusion": [r.asDict() for r in matrix.orderBy("label", "prediction").collect()]}, str(Path(args.output) / "report.json"))
            return report
        case "subset":
            from textquarry.evaluate.subset import build_subset
            from textquarry.functions.normalize import PROFILE
            from textquarry.models.store import stop_word_hash
            from textquarry.sources.readers import read_corpus, read_judgments, read_queries
            from textquarry.sources.sinks import write_collection

            queries = read_queries(spark, args.queries)
            documents, chosen, qrels, statistics = build_subset(read_corpus(spark, args.corpus), queries, read_judgments(spark, args.qrels, queries), args.documents, args.query_count, args.seed)
            return write_collection(documents, chosen, qrels, args.output, statistics | {"profile": PROFILE, "stop_words": stop_word_hash(), "seed": args.seed})
        case "evaluate":
            models = {n: m for n in ("lsa", "word2vec", "cnn") if (m := getattr(args, f"{n}_model"))}
            if not models:
                raise InvalidInput("name a model")
            return sessions.evaluate(spark, args.collection, models, args.output, args.timed)["models"]
        case "classify":
            from pathlib import Path

            from textquarry.functions.normalize import prepared_tokens
            from textquarry.models import naive_bayes, store
            from textquarry.operators.dedup import majority_labels
            from textquarry.sources.readers import read_reviews

            if Path(args.model).exists():
                model = store.load(spark, args.model, "naive_bayes")
            else:
                rows = majority_labels(read_reviews(spark, args.input), "review", "sentiment", {"neautral": "neutral"})
                model = naive_bayes.fit(rows.withColumn("tokens", prepared_tokens(F.col("text"))))
                store.save(model, args.model)
            row = spark.createDataFrame([(0, query_text(args.text, args.file))], "doc_id int, text string").withColumn("tokens", prepared_tokens(F.col("text")))
            if not row.first()["tokens"]:
                raise InvalidInput("the text has no tokens")
            found = naive_bayes.predict(model, row).first()
            return {"prediction": found["prediction"], "probabilities": {c: found["probabilities"][c] for c in model.classes}}
    raise InvalidInput(args.command)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        result = run(args)
    except (QuarryError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(render({k: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else v for k, v in result.items()}, args.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
