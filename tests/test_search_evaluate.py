import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry import cli
from textquarry.errors import InvalidInput, ModelImportError
from textquarry.evaluate import classify, retrieval
from textquarry.evaluate.experiment import sentiment_experiment
from textquarry.evaluate.labelled import evaluate_labelled, sparse_hits
from textquarry.evaluate.silhouette import silhouette
from textquarry.evaluate.subset import build_subset
from textquarry.operators import terms
from textquarry.search import session as sessions
from textquarry.search.index import build_index, dual_search, query_status, search


def test_index_order(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [5.0, 0.0]), ("opposite", [-1.0, 0.0]), ("orthogonal", [0.0, 2.0]), ("zero", [0.0, 0.0])], "doc_id string, vec array<double>")
    index, zero = build_index(df)
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, vec array<double>")
    got = [(r["doc_id"], r["cosine"]) for r in search(index, queries, 10).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 1.0), ("orthogonal", 0.0), ("opposite", -1.0)]
    assert [r["doc_id"] for r in zero.collect()] == ["zero"]
    assert search(index, queries, 1).first()["doc_id"] == "a" and search(index, queries.where("false"), 1).count() == 0
    assert build_index(df, keep_zero=True)[0].count() == 5
    for bad in ([float("nan"), 1.0], [1.0], None, [None, 1.0]):
        with pytest.raises(InvalidInput):
            build_index(spark.createDataFrame([("x", bad)], "doc_id string, vec array<double>"), dimensions=2)
        assert build_index(spark.createDataFrame([("x", bad)], "doc_id string, vec array<double>"), dimensions=2, strict=False)[0].count() == 0
    with pytest.raises(InvalidInput):
        search(index, queries, 0)
    sparse = spark.createDataFrame([("q", "b", 0.5)], "query_id string, doc_id string, cosine double")
    assert {r["doc_id"]: r["sparse_cosine"] for r in dual_search(index, queries, sparse, 2).collect()} == {"a": 0.0, "b": 0.5}


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    index = build_index(df)[0]
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in search(index, df.withColumnRenamed("doc_id", "query_id"), 3, queries_at_once=33, exclude_same=True).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -2)
    assert got == {(q, r + 1): int(d) for q in range(200) for r, d in enumerate(np.argsort(-cosines[q])[:3])}


def test_statuses(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (3, 0, [0.0]), (3, 1, [0.0]), (3, 2, [1.0])], "total_tokens int, known_tokens int, vec array<double>")
    assert [r["status"] for r in query_status(df).collect()] == ["empty_after_normalization", "oov", "zero_vector", "ok"]


@pytest.mark.parametrize(("rank", "recall", "rr"), [(1, 1, 1), (5, 1, 0.2), (6, 0, 1 / 6), (10, 0, 0.1), (11, 0, 0)])
def test_cutoffs(spark, rank, recall, rr):
    queries = spark.createDataFrame([("q", "ok")], "query_id string, status string")
    hits, qrels = spark.createDataFrame([("q", "d", rank)], "query_id string, doc_id string, rank int"), spark.createDataFrame([("q", "d", 1), ("q", "e", 0)], "query_id string, doc_id string, score int")
    row = retrieval.query_metrics(queries, hits, qrels).first()
    assert (row["recall5"], row["rr10"]) == (recall, rr) and row["loss_reason"] == ("none" if recall else "ranking")


def test_aggregates(spark):
    rows = [("a", "ok", 2 / 3, 0.5, "ranking", 3, 5, 0.1), ("b", "oov", 0.0, 0.0, "oov", 0, 2, 0.2), ("c", "ok", 0.0, 0.0, "zero_relevant_document", 3, 3, 0.4), ("d", "empty_after_normalization", 0.0, 0.0, "empty_after_normalization", 0, 0, None)]
    df = spark.createDataFrame(rows, "query_id string, status string, recall5 double, rr10 double, loss_reason string, known_tokens int, total_tokens int, search_seconds double")
    row = retrieval.aggregate_metrics(df).first()
    assert abs(row["recall5"] - 1 / 6) < 1e-12 and row["mrr10"] == 0.125 and abs(row["coverage"] - 0.6) < 1e-12 and row["p95_seconds"] == 0.4
    assert dict(row["statuses"]) == {"empty_after_normalization": 1, "ok": 2, "oov": 1} and sum(row["loss_reasons"].values()) == 4
    zero = spark.createDataFrame([("e",)], "doc_id string")
    queries, qrels = spark.createDataFrame([("q", "ok")], "query_id string, status string"), spark.createDataFrame([("q", "e", 1)], "query_id string, doc_id string, score int")
    assert retrieval.query_metrics(queries, spark.createDataFrame([], "query_id string, doc_id string, rank int"), qrels, zero).first()["loss_reason"] == "zero_relevant_document"


def test_label_precision(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "doc_id string, label string")
    queries = spark.createDataFrame([("q", "x"), ("oov", "x")], "query_id string, label string")
    precision = retrieval.label_precision(hits, queries, labels)
    assert precision.first()["precision"] == 0.4
    assert retrieval.mean_precision(precision, queries).first().asDict() == {"evaluated": 1, "skipped": 1, "precision": 0.4, "hit": 1.0}
    assert retrieval.examples(hits).count() == 3


def test_published_confusion_matrix(spark):
    names = ["negative", "neutral", "positive"]
    # Counts that follow from the published precision, recall and support of each class.
    counts = [[2712, 1376, 245], [920, 2908, 487], [74, 608, 3707]]
    matrix = spark.createDataFrame([(a, b, counts[i][j]) for i, a in enumerate(names) for j, b in enumerate(names)], "label string, prediction string, n long")
    row = classify.summary(matrix).first()
    right, total = sum(counts[i][i] for i in range(3)), sum(map(sum, counts))
    assert abs(row["accuracy"] - right / total) < 1e-12
    report = {r["label"]: r for r in classify.class_report(matrix).collect()}
    assert abs(report["neutral"]["recall"] - 2908 / sum(counts[1])) < 1e-12 and report["neutral"]["support"] == sum(counts[1])
    rows = spark.createDataFrame([("negative", "neutral"), ("neutral", "neutral")], "label string, prediction string")
    small = classify.confusion(rows, names)
    assert small.count() == 9 and {r["label"]: r["precision"] for r in classify.class_report(small).collect()} == {"negative": 0.0, "neutral": 0.5, "positive": 0.0}


def test_silhouette(spark):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((60, 3)), [str(i % 3) for i in range(59)] + ["alone"]
    df = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y, strict=True)] + [(None, "0"), ([1.0] * 3, None)], "vec array<double>, label string")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    values = []
    for i in range(60):
        own = [j for j in range(60) if y[j] == y[i] and j != i]
        if not own:
            values.append(0)
            continue
        a, b = d[i, own].mean(), min(d[i, [j for j in range(60) if y[j] == c]].mean() for c in set(y) - {y[i]})
        values.append((b - a) / max(a, b))
    assert abs(silhouette(df)["value"] - np.mean(values)) < 1e-9
    assert silhouette(df.where("label = '1'"))["reason"] and silhouette(df.where("label = 'alone'").union(df.where("label = '1'").limit(1)))["value"] is None


CORPUS = [("d1", "Титул", "ракета спутник космос", 1), ("d2", "", " ... ", 2), ("d3", "", "ракета летит", 3), ("d4", "", "ракета летит", 4), ("d5", "", "кот спит дома", 5), ("d6", "", "пёс лает", 6), ("d7", "", "сад цветёт", 7)]


def subset(spark, queries, qrels, size, count):
    docs = spark.createDataFrame(CORPUS, "id string, title string, text string, seq long")
    return build_subset(docs, spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(qrels, "query_id string, doc_id string, score int"), size, count)


def test_subset(spark):
    docs, queries, qrels, stats = subset(spark, [("q1", "титул"), ("q2", "кот спит дома")], [("q1", "d1", 1), ("q2", "d5", 1)], 4, 2)
    rows = docs.orderBy("seq").collect()
    assert {r["id"] for r in rows[:2]} == {"d1", "d5"} and [r["id"] for r in rows[2:]] == ["d3", "d6"]
    assert (stats["empty_candidates"], stats["duplicate_background_candidates"], stats["query_title_matches"], stats["query_body_matches"]) == (1, 1, 1, 1)
    assert queries.count() == qrels.count() == 2


def test_exclusions(spark):
    queries = [("a", "..."), ("b", "нет оценок"), ("c", "пусто"), ("d", "титул"), ("e", "ТИТУЛ")]
    qrels = [("a", "d1", 1), ("c", "d2", 1), ("d", "d1", 1), ("e", "d1", 1)]
    *_, stats = subset(spark, queries, qrels, 2, 1)
    assert stats["excluded_queries"] == {"duplicate_query": 1, "empty_query": 1, "missing_or_empty_relevant_document": 1, "no_positive_judgment": 1}
    *_, stats = subset(spark, [("a", "раз"), ("b", "два")], [("a", "d3", 1), ("b", "d4", 1)], 3, 1)
    assert stats["excluded_queries"] == {"duplicate_relevant_body": 1}
    with pytest.raises(InvalidInput):
        subset(spark, queries, qrels, 2, 5)
    with pytest.raises(InvalidInput):
        subset(spark, queries, qrels, 50, 1)


def files(tmp_path):
    texts = {"space-a": "ракета спутник орбита космос ракета", "space-b": "спутник орбита космос ракета", "cat-a": "кот дом молоко кот", "cat-b": "дом молоко кот", "sport-a": "мяч гол команда", "sport-b": "гол команда мяч матч"}
    with open(tmp_path / "corpus.jsonl", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"_id": i, "title": i, "text": t}, ensure_ascii=False) + "\n" for i, t in texts.items())
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps({"_id": q, "text": t}, ensure_ascii=False) + "\n" for q, t in [("q1", "Ракеты спутники"), ("q2", "кот"), ("q3", "неизвестность"), ("q4", "команда")]), "utf-8")
    (tmp_path / "qrels.jsonl").write_text("".join(json.dumps({"query-id": q, "corpus-id": d, "score": 1}) + "\n" for q, d in [("q1", "space-a"), ("q2", "cat-a"), ("q3", "cat-b"), ("q4", "sport-a")]), "utf-8")


def test_train_search_evaluate(spark, tmp_path, capsys):
    files(tmp_path)
    at = lambda name: str(tmp_path / name)
    assert cli.main(["subset", "--corpus", at("corpus.jsonl"), "--queries", at("queries.jsonl"), "--qrels", at("qrels.jsonl"), "--output", at("collection"), "--documents", "6", "--query-count", "4"]) == 0
    assert cli.main(["train", "--input", at("collection/corpus.csv"), "--output", at("lsa"), "--dimensions", "3"]) == 0
    capsys.readouterr()
    assert cli.main(["--format", "json", "search", "--model", at("lsa"), "--query", "Ракеты спутники", "--top", "2"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["status"] == "ok" and {h["doc_id"] for h in found["hits"]} == {"space-a", "space-b"}
    assert cli.main(["--format", "json", "search", "--model", at("lsa"), "--query", "неизвестность"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "oov"
    report = sessions.evaluate(spark, at("collection"), {"lsa": at("lsa")}, at("report"))
    metrics = report["models"]["lsa"]["metrics"]
    assert metrics["queries"] == 4 and metrics["recall5"] == 0.75 and metrics["statuses"]["oov"] == 1
    assert json.load(open(at("report/report.json")))["models"]["lsa"]["metrics"]["queries"] == 4
    assert cli.main(["train", "--input", at("collection/corpus.csv"), "--output", at("lsa")]) == 1
    assert cli.main(["train", "--input", at("collection/corpus.csv"), "--output", at("x"), "--window", "3"]) == 1
    assert "not for lsa" in capsys.readouterr().err and not (tmp_path / "x").exists()
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
    for name in ("corpus.csv", "queries.jsonl", "qrels.jsonl"):
        path = tmp_path / "collection" / name
        body = path.read_bytes()
        path.write_bytes(body + b"\n")
        with pytest.raises(ModelImportError):
            sessions.read_collection(spark, at("collection"))
        path.write_bytes(body)
    assert metrics["mean_seconds"] is None
    timed = sessions.evaluate(spark, at("collection"), {"lsa": at("lsa")}, timed=True)["models"]["lsa"]["metrics"]
    assert timed["mean_seconds"] > 0 and timed["p95_seconds"] >= timed["mean_seconds"]
    capsys.readouterr()
    assert cli.main(["--format", "json", "analyze", "--model", at("lsa"), "--query", "Ракеты спутники", "--top", "2"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert len(found["documents"]) == 2 and found["documents"][0]["sparse_cosine"] > 0 and found["terms"] and len(found["coordinates"]) == 3
    session = sessions.open_model(spark, at("lsa"))
    weights = spark.createDataFrame([("query", "космос", 0.5)], "doc_id string, term string, weight double")
    assert sessions.explain_query(session, weights, "космос")["terms"] == [("космос", 0.5)]
    with pytest.raises(InvalidInput):
        sessions.explain_query(session, weights, "неизвестность")


def labelled_rows(spark, n=60):
    rng = random.Random(3)
    words = {"спорт": "матч гол клуб тренер победа".split(), "наука": "опыт атом учёный лаборатория открытие".split()}
    rows = []
    for i in range(n):
        label = ("спорт", "наука")[i % 2]
        rows.append((f"r{i:03}", label, "test" if i % 5 == 0 else "train", [rng.choice(words[label]) for _ in range(8)] + [rng.choice(["город", "день"])]))
    rows += [("x1", "спорт", "test", ["неведомое"]), ("x2", None, "test", ["гол"]), ("x3", "спорт", "other", ["гол"]), ("x4", "спорт", "test", None)]
    return rows, spark.createDataFrame(rows, "doc_id string, label string, split string, tokens array<string>")


def test_labelled_evaluation(spark):
    rows, corpus = labelled_rows(spark)
    report = evaluate_labelled(corpus, 3, 50)
    assert (report["train"], report["test"]) == (48, 14) and len({r["query_id"] for r in report["examples"]}) == 3
    for model in ("tfidf", "lsa"):
        assert report["retrieval"][model]["evaluated"] == 12 and report["retrieval"][model]["skipped"] == 2 and report["retrieval"][model]["precision"] == 1.0
    assert report["silhouette"]["lsa"]["value"] > 0 and report["silhouette"]["lda"]["value"] > 0
    with pytest.raises(InvalidInput):
        evaluate_labelled(corpus.where("split = 'train' or doc_id = 'x1'"), 3, 50)


def test_sparse_hits_are_filled_up(spark):
    """Documents without a common term follow by id, as each has cosine 0."""
    train = spark.createDataFrame([(f"d{i}", ["а", "б"] if i == 4 else ["в"]) for i in range(8)], "doc_id string, tokens array<string>")
    test = spark.createDataFrame([("q", ["а"]), ("none", ["я"])], "doc_id string, tokens array<string>")
    got = [(r["query_id"], r["doc_id"], r["cosine"] > 0) for r in sparse_hits(train, test, 5).orderBy("query_id", "rank").collect()]
    assert got == [("q", "d4", True)] + [("q", f"d{i}", False) for i in range(4)]


def test_sparse_hits_keep_the_driver_free(spark, monkeypatch):
    """No term of the test rows is sent or collected, however few there are; small blocks give the hits of all pairs."""
    from textquarry.evaluate import labelled
    from textquarry.search import blocks

    def broadcast(*_args, **_kwargs):
        raise AssertionError("test rows are scored from a table on the driver")

    monkeypatch.setattr(terms, "sparse_cosines", broadcast)
    for name, n in (("DOCUMENTS", 7), ("QUERIES", 5), ("_PAIRS", 3)):
        monkeypatch.setattr(blocks, name, n)
    monkeypatch.setattr(labelled, "DENSE", 4)
    rng = random.Random(6)
    tokens = {i: [f"t{int(rng.random() ** 2 * 30)}" for _ in range(12)] for i in range(90)}
    texts = {f"d{i:02}": tokens[i // 2] for i in range(60)} | {f"q{i:02}": tokens[30 + i] for i in range(23)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, tokens array<string>")
    train, test = rows.where("doc_id < 'e'"), rows.where("doc_id > 'e'")
    got = {}
    for r in sparse_hits(train, test, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["cosine"]))
    df = {}
    for name, words in texts.items():
        for t in set(words) if name < "e" else ():
            df[t] = df.get(t, 0) + 1

    def unit(words):
        raw = {t: (1 + np.log(words.count(t))) * (np.log(61 / (1 + df[t])) + 1) for t in set(words) if t in df}
        return {t: w / np.sqrt(sum(x * x for x in raw.values())) for t, w in raw.items()}

    units = {name: unit(words) for name, words in texts.items()}
    for q in (name for name in texts if name > "e"):
        every = sorted((-round(sum(w * units[d].get(t, 0) for t, w in units[q].items()), 9), d) for d in texts if d < "e")[:5]
        assert [d for d, _ in got[q]] == [d for _, d in every] and [c for _, c in got[q]] == pytest.approx([-c for c, _ in every], abs=2e-9)


def test_split_precision_keeps_the_driver_free(spark, tmp_path, monkeypatch):
    from textquarry.plans.queries import split_precision

    def broadcast(*_args, **_kwargs):
        raise AssertionError("test rows are scored from a table on the driver")

    monkeypatch.setattr(terms, "sparse_cosines", broadcast)
    rows = [(f"r{i:02}", f"ракета{i % 4} орбита{i % 4}", "ab"[i % 4 // 2], "test" if i >= 24 else "train") for i in range(32)]
    rows += [("x1", "неведомое", "a", "test"), ("x2", "ракета1", None, "test"), ("x3", "ракета1", "b", "other")]
    spark.createDataFrame(rows, "id string, text string, label string, split string").write.parquet(str(tmp_path / "canonical_corpus.parquet"))
    assert [tuple(r) for r in split_precision(spark, str(tmp_path)).collect()] == [(8, 1, 1.0, 1.0)]


def test_split_precision_sends_neither_terms_nor_labels(spark, tmp_path, monkeypatch):
    """The tables of terms and labels grow with the corpus; small as they are here, Spark would broadcast them."""
    from textquarry.evaluate import labelled
    from textquarry.plans.queries import split_precision

    original, plans = labelled.materialize, []

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def watched(df, name):
        if name == "weighted":
            plans.append(plan_of(df))
        return original(df, name)

    monkeypatch.setattr(labelled, "materialize", watched)
    rows = [(f"r{i:02}", f"ракета{i % 4} орбита{i % 4}", "ab"[i % 4 // 2], "test" if i >= 24 else "train") for i in range(32)]
    spark.createDataFrame(rows, "id string, text string, label string, split string").write.parquet(str(tmp_path / "canonical_corpus.parquet"))
    found = split_precision(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(8, 0, 1.0, 1.0)]
    plans.append(plan_of(found))
    assert len(plans) == 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_dense_hits_keep_the_driver_free(spark, monkeypatch):
    """Vectors of test rows and the matrix of terms by terms are not collected; small blocks give the hits of all pairs."""
    from textquarry.evaluate.labelled import dense_hits
    from textquarry.models import lsa
    from textquarry.search import blocks

    for name, n in (("DOCUMENTS", 7), ("QUERIES", 5)):
        monkeypatch.setattr(blocks, name, n)
    rng = random.Random(7)
    rows = [(f"d{i:02}", [f"t{rng.randrange(12)}" for _ in range(6)]) for i in range(40)] + [("d40", ["t3"]), ("d41", ["t3"]), ("d42", None)]
    rows += [(f"q{i:02}", [f"t{rng.randrange(12)}" for _ in range(6)]) for i in range(17)] + [("q17", ["unknown"]), ("q18", ["t3"])]
    df = spark.createDataFrame(rows, "doc_id string, tokens array<string>")
    train, test = df.where("doc_id < 'e'"), df.where("doc_id > 'e'")
    kind, collect = type(df), type(df).collect

    def collected(self):
        assert "part" not in self.columns and "vec" not in self.columns
        return collect(self)

    def iterated(self, *_):
        raise AssertionError(f"{self.columns} are read by the driver")

    with monkeypatch.context() as watched:
        watched.setattr(kind, "collect", collected)
        watched.setattr(kind, "toLocalIterator", iterated)
        model = lsa.fit(train, 4, unit=False)
        hits = dense_hits(model, train, test, 5).orderBy("query_id", "rank").collect()
    vectors = {r["doc_id"]: np.array(r["vec"]) for part in (train, test) for r in lsa.transform(model, part).collect()}
    unit = {i: v / max(np.linalg.norm(v), 1e-300) for i, v in vectors.items()}
    got = {}
    for r in hits:
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["cosine"]))
    assert set(got) == {i for i in unit if i > "e"} - {"q17"} and [d for d, _ in got["q18"][:2]] == ["d40", "d41"]
    for q, found in got.items():
        every = sorted((float(unit[q] @ unit[d]) for d in unit if d < "e"), reverse=True)[:5]
        assert [c for _, c in found] == pytest.approx(every) and all(float(unit[q] @ unit[d]) == pytest.approx(c) for d, c in found)


def test_sparse_cosines_joined_or_sent(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, [f"t{rng.randrange(20)}" for _ in range(15)]) for i in range(40)], "doc_id long, tokens array<string>")
    weights = terms.idf(terms.document_frequencies(docs), 40).cache()
    frequencies = terms.term_frequencies(docs)
    unit = terms.tfidf(frequencies, weights)
    want = {}
    rows = {}
    for r in unit.collect():
        rows.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for a in range(5):
        for b, other in rows.items():
            if c := sum(w * other.get(t, 0) for t, w in rows[a].items()):
                want[a, b] = c
    asked = unit.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    for limit in (0, 10**6):
        got = {(r["query_id"], r["doc_id"]): r["cosine"] for r in terms.sparse_cosines(asked, frequencies, weights, broadcast_rows=limit).collect()}
        assert got == pytest.approx(want)


def test_experiment(spark, tmp_path):
    rng = random.Random(4)
    words = {"positive": "хорошее платье нравится".split(), "negative": "плохая ткань порвалась".split(), "neautral": "обычный товар норма".split()}
    rows = [(" ".join(rng.choices(words[k], k=6)) + f" номер{i}", k) for i in range(60) for k in words]
    reviews = spark.createDataFrame(rows + [(None, "positive"), ("пусто", None)], "review string, sentiment string")
    report, model, matrix = sentiment_experiment(reviews, spellings={"neautral": "neutral"})
    assert report["sizes"] == {"train": 126, "validation": 27, "test": 27} and set(report["validation"]) == {"none", "stem"}
    assert report["chosen"] == "none" and report["test"]["accuracy"] == 1.0 and report["classes"]["neutral"]["support"] == 9
    assert model.classes == ("negative", "neutral", "positive") and matrix.count() == 9
    with pytest.raises(InvalidInput):
        sentiment_experiment(reviews.where("sentiment = 'positive'"))


def test_vocabulary_and_classifier(spark, tmp_path, capsys):
    assert cli.main(["--format", "json", "vocabulary", "--text", "Отличные машины", "--stopwords", "default", "--synonyms", "default"]) == 0
    assert json.loads(capsys.readouterr().out)["normalized"] == ["хорош", "машин"]
    rows = "review\tsentiment\n" + "".join(f"{t} {i}\t{s}\n" for i in range(4) for t, s in (("хорошо отлично", "positive"), ("плохо ужасно", "negative"), ("нормально", "neautral")))
    (tmp_path / "r.tsv").write_text(rows, "utf-8")
    command = ["--format", "json", "classify", "--input", str(tmp_path / "r.tsv"), "--model", str(tmp_path / "nb"), "--text"]
    for text in ("очень плохо", "плохо", "неведомо"):
        assert cli.main([*command, text]) == 0
        found = json.loads(capsys.readouterr().out)
        assert abs(sum(found["probabilities"].values()) - 1) < 1e-9 and list(found["probabilities"]) == ["negative", "neutral", "positive"]
    assert cli.main([*command, "!!!"]) == 1


def test_streams(spark, tmp_path):
    from textquarry.streaming.ingest import first_of_stream, windowed_term_counts

    rows = spark.createDataFrame([(1, "кот кот дом", "2024-01-01 10:00:00"), (2, "дом", "2024-01-01 11:00:00"), (3, "дом", "2024-01-03 11:00:00"), (3, "дом", "2024-01-03 11:00:00")], "id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("counts", windowed_term_counts(stream, "at")), ("first", first_of_stream(stream, "id", "at"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("update" if name == "counts" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert {(str(r["window"]["start"])[:10], r["term"]): r["n"] for r in spark.sql("select * from counts").collect()} == {("2024-01-01", "кот"): 2, ("2024-01-01", "дом"): 2, ("2024-01-03", "дом"): 2}
    assert spark.sql("select * from first").count() == 3
