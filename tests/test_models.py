import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput, ModelExportError, ModelImportError, ModelTrainingError
from textquarry.functions.java_random import JavaRandom
from textquarry.models import cnn, lda, lsa, naive_bayes, store, word2vec
from textquarry.operators import terms


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"doc_id long, tokens array<string>{extra}")


def test_idf_and_weights(spark):
    df = docs(spark, [["a", "a", "b"], ["a"], [], None])
    found = {r["term"]: (r["df"], r["cf"], r["idf"]) for r in terms.idf(terms.document_frequencies(df), 2).collect()}
    assert found["a"] == (2, 3, 1.0) and found["b"][:2] == (1, 1) and abs(found["b"][2] - (math.log(1.5) + 1)) < 1e-12
    weights = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "term string, idf double")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in terms.tfidf(terms.term_frequencies(docs(spark, [["a", "a", "b", "x"]])), weights).collect()}
    a, b = (1 + math.log(2)) * 2, 3.0
    assert set(got) == {(0, "a"), (0, "b")} and abs(got[0, "a"] - a / math.hypot(a, b)) < 1e-12


def test_vocabularies(spark):
    df = docs(spark, [["b", "a", "c", "c"], ["a", "b"], ["d"]])
    by = terms.collection_frequencies(df)
    assert [(r["term"], r["term_id"]) for r in terms.vocabulary_ids(by, 3, 2).orderBy("term_id").collect()] == [("a", 2), ("b", 3), ("c", 4)]
    assert [r["term"] for r in terms.vocabulary_ids(by.where("term <> 'a'"), 2, alphabetic=True).orderBy("term_id").collect()] == ["b", "c"]
    assert {r["term"] for r in terms.collection_frequencies(df, least=2).collect()} == {"a", "b", "c"}
    known = {r["doc_id"]: (r["known"], r["total"]) for r in terms.coverage(docs(spark, [["a", "x", "a"], [], None]), by).collect()}
    assert known == {0: (2, 3), 1: (0, 0), 2: (0, 0)}


def test_bayes_closed_form(spark):
    rows = [(["a", "a", "b"], "x"), (["a", "b"], "x"), (["b", "c"], "x"), (["c", "c", "b"], "y"), (["z"], None)]
    df = docs(spark, rows, ", label string")
    model = naive_bayes.fit(df, min_df=2)
    assert model.classes == ("x", "y") and np.allclose(model.priors, [math.log(3 / 4), math.log(1 / 4)])
    got = {r["term"]: r["log_probability"] for r in model.terms.collect()}
    assert np.allclose(got["a"], [math.log((3 + 1) / (7 + 3)), math.log(1 / (3 + 3))]) and np.allclose(got["c"], [math.log(2 / 10), math.log(3 / 6)])
    found = {r["doc_id"]: r for r in naive_bayes.predict(model, docs(spark, [["c", "c", "c"], ["unknown"], None, ["a"]])).collect()}
    assert [found[i]["prediction"] for i in range(4)] == ["y", "x", "x", "x"]
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-12 for r in found.values())
    assert abs(found[1]["probabilities"]["x"] - 0.75) < 1e-12
    for bad in (df.where("label is null"), df.where("false")):
        with pytest.raises(ModelTrainingError):
            naive_bayes.fit(bad)


def test_singular_values(spark):
    model = lsa.fit(docs(spark, [["a"], ["a"], ["a"], ["b"], ["b"], ["c"]]), 2)
    assert np.allclose(model.singular_values, [math.sqrt(3), math.sqrt(2)])
    wide = lsa.fit(docs(spark, [[f"t{i:02d}"] for i in range(20) for _ in range(20 - i)]), 50)
    assert np.allclose(wide.singular_values, [math.sqrt(20 - i) for i in range(19)])
    with pytest.raises(InvalidInput):
        lsa.gram_matrix(None, 5000)
    with pytest.raises(ModelTrainingError):
        lsa.fit(docs(spark, [["a"]]), 2)


def test_lsa_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [[f"t{x}" for x in rng.zipf(1.5, 30) % 25] for _ in range(40)]
    df = docs(spark, rows)
    model = lsa.fit(df, 5, unit=False)
    weights = terms.tfidf(terms.term_frequencies(df), model.vocabulary)
    matrix = np.zeros((40, model.projection.shape[0]))
    for r in weights.join(model.vocabulary.select("term", "term_id"), "term").collect():
        matrix[r["doc_id"], r["term_id"]] = r["weight"]
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(s[:5], model.singular_values)
    got = np.array([r["vec"] for r in lsa.transform(model, df).orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got), np.abs(matrix @ vt[:5].T), atol=1e-8)
    unit = lsa.Lsa(model.vocabulary, model.projection, model.singular_values, True)
    odd = {r["doc_id"]: r for r in lsa.transform(unit, docs(spark, [["t1", "t1", "x"], ["x"], None])).collect()}
    assert abs(np.linalg.norm(odd[0]["vec"]) - 1) < 1e-12 and odd[0]["known_tokens"] == 2
    assert not any(odd[1]["vec"]) and not any(odd[2]["vec"]) and odd[2]["known_tokens"] == 0
    top = lsa.topic_terms(model, 3).collect()
    assert all(r["rank"] <= 3 and (r["loading"] > 0) == (r["side"] == "positive") for r in top)


def test_discriminants(spark):
    rng = np.random.default_rng(1)
    centers = {"a": np.zeros(4), "b": np.array([3.0, 0, 0, 0]), "c": np.array([0, 3.0, 0, 0])}
    rows = [(i, (centers[c] + rng.standard_normal(4) * [1, 1, 5, 5]).tolist(), c) for i, c in enumerate("abc" * 60)] + [(900, None, "a"), (901, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>, label string")
    model = lda.fit(df.where("vec is not null"))
    found = {r["doc_id"]: r["vec"] for r in lda.transform(model, df).collect()}
    assert len(found) == 181 and all(len(v) == 2 for v in found.values())
    means = {c: np.mean([found[i] for i, _, x in rows if x == c and i in found], axis=0) for c in "abc"}
    right = sum(min(means, key=lambda c: np.linalg.norm(means[c] - found[i])) == x for i, _, x in rows[:180])
    assert right > 150
    spread = np.concatenate([[found[i] - means[x]] for i, _, x in rows[:180]]).var(axis=0)
    assert np.allclose(spread * 180 / 177, 1, atol=1e-6)
    with pytest.raises(ModelTrainingError):
        lda.fit(df.where("label = 'a' and vec is not null"))


def test_word_vectors(spark):
    rows = [["кот", "пёс", "кот", "дом"], ["дом", "сад", "дом", "кот"], ["сад", "пёс"]] * 6 + [["никогда"], None]
    df = docs(spark, [r or [] for r in rows])
    model = word2vec.fit(df, 8, 2, min_count=2)
    vectors = {r["term"]: (np.array(r["vec"]), r["idf"]) for r in model.vectors.collect()}
    found = {r["doc_id"]: r for r in word2vec.transform(model, df).collect()}
    want = 2 * vectors["кот"][0] * vectors["кот"][1] + vectors["пёс"][0] * vectors["пёс"][1] + vectors["дом"][0] * vectors["дом"][1]
    assert np.allclose(found[0]["vec"], want / np.linalg.norm(want)) and found[0]["known_tokens"] == 4
    assert not any(found[18]["vec"]) and found[18]["known_tokens"] == 0 and len(found) == 20
    again = {r["term"]: np.array(r["vec"]) for r in word2vec.fit(df, 8, 2, min_count=2).vectors.collect()}
    assert all(np.allclose(again[t], v) for t, (v, _) in vectors.items())
    with pytest.raises(ModelTrainingError):
        word2vec.fit(docs(spark, [["a"]]), 4, min_count=5)


def test_pair_sampling_fingerprint():
    documents = [[2 + i * 200 + j for j in range(20 + i * 4)] for i in range(40)]
    random, digest, n = JavaRandom(42), hashlib.sha256(), 0
    for _ in range(9):
        for rows, sources in cnn.batches(documents, 128, 16, random):
            n += 1
            for row, source in zip(rows, sources, strict=True):
                digest.update(struct.pack(f">{len(row) + 2}i", source, len(row), *row))
    assert (n, digest.hexdigest()) == (27, "e8f7cf9f12d9778190c8ce968c9dadb0f5614b00a1901695c22c26c18b38dea1")


def test_short_and_long_fragments():
    document = list(range(2, 258))
    random = JavaRandom(42)
    for _ in range(50):
        a, b = cnn.fragments(document, 128, random, "short_long")
        assert 4 <= len(a) <= 16 and 64 <= len(b) <= 128 and list(a) == list(range(a[0], a[0] + len(a)))
    assert cnn.fragments([2], 128, JavaRandom(1), "short_long") == ([2], [2])
    assert all(cnn.known(x) for x in cnn.fragments([1] * 99 + [2], 128, JavaRandom(42), "short_long"))
    assert len(cnn.usable_documents([[2, 3], [2, 3], [1, 1], [3], []])) == 2
    with pytest.raises(ModelTrainingError):
        cnn.usable_documents([[2], [2], [1]])


def test_contrastive_loss():
    v, partners = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]]), np.array([1, 0, 3, 2])
    good = math.log(1 + 2 * math.exp(-5))
    assert abs(cnn.contrastive_loss(v, partners, 0.2)[0] - good) < 1e-12
    assert abs(cnn.contrastive_loss(v, np.array([2, 3, 0, 1]), 0.2)[0] - (good + 5)) < 1e-12
    assert abs(cnn.contrastive_loss(np.ones((4, 2)), partners, 0.2)[0] - math.log(3)) < 1e-12


def test_gradients():
    p = cnn.CnnParameters(dimensions=4, filters=3, width=3, max_features=10, batch=2)
    w, (ids, mask) = cnn.initial_weights(p, 6), cnn.padded([[2, 3, 4], [5, 6], [2, 7, 1, 3], [4, 4]])

    def loss():
        return cnn.contrastive_loss(cnn.forward(w, ids, mask, 3)[0], np.arange(4) ^ 1, 0.5)

    vectors, kept = cnn.forward(w, ids, mask, 3)
    found = cnn.backward(w, kept, cnn.contrastive_loss(vectors, np.arange(4) ^ 1, 0.5)[1], 3)
    for k, x in w.items():
        for i in range(x.size):
            old = x.flat[i]
            x.flat[i] = old + 1e-6
            up = loss()[0]
            x.flat[i] = old - 1e-6
            down = loss()[0]
            x.flat[i] = old
            assert abs((up - down) / 2e-6 - found[k].flat[i]) < 1e-6
    longer, longer_mask = cnn.padded([[2, 3, 4], [5, 6], [2, 7, 1, 3], [4, 4], [2] * 9])
    assert np.allclose(cnn.forward(w, longer, longer_mask, 3)[0][:4], vectors)


def test_cnn_learns(spark):
    rows = [[f"{'ab'[i % 2]}{(i * 7 + j) % 11}" for j in range(24)] for i in range(20)]
    df = docs(spark, [*rows, ["unknown"] * 12 + ["a1"], None])
    p = cnn.CnnParameters(dimensions=8, filters=8, epochs=6, batch=5, max_length=12, learning_rate=0.02, validation=0.2)
    model = cnn.fit(df.where("doc_id < 20"), p)
    assert model.history[-1]["loss"] < model.history[0]["loss"] and 1 <= cnn.best_epoch(model) <= 6
    found = {r["doc_id"]: r for r in cnn.transform(model, df).collect()}
    assert abs(np.linalg.norm(found[0]["vec"]) - 1) < 1e-5 and found[0]["known_tokens"] == 12
    assert found[20]["known_tokens"] == 0 and not any(found[20]["vec"]) and not any(found[21]["vec"])
    for bad in ({"width": 2}, {"batch": 1}, {"sampling": "x"}, {"dimensions": 0}, {"max_features": 100_000, "dimensions": 100}):
        with pytest.raises(InvalidInput):
            cnn.CnnParameters(**bad)


def test_store(spark, tmp_path):
    df = docs(spark, [["a", "b"], ["b", "c"], ["a", "c"], ["d", "a"]]).withColumn("label", F.when(F.col("doc_id") < 2, "x").otherwise("y"))
    models = {
        "lsa": lsa.fit(df, 2), "naive_bayes": naive_bayes.fit(df, min_df=1), "cnn": cnn.fit(df, cnn.CnnParameters(dimensions=4, filters=4, epochs=1, batch=2, min_count=1)),
        "word2vec": word2vec.fit(df, 4, 1, min_count=1),
    }
    for kind, model in models.items():
        folder = str(tmp_path / kind)
        store.save(model, folder)
        again = store.load(spark, folder, kind)
        module = {"lsa": lsa, "cnn": cnn, "word2vec": word2vec}.get(kind)
        if module:
            vectors = [[r["vec"] for r in module.transform(m, df).orderBy("doc_id").collect()] for m in (model, again)]
            assert np.allclose(*vectors)
        else:
            assert again.priors == model.priors
        with pytest.raises(ModelExportError):
            store.save(model, folder)
        with pytest.raises(ModelImportError):
            store.load(spark, folder, "other")
    (tmp_path / "lsa/arrays.npz").write_bytes(b"x")
    manifest = tmp_path / "word2vec/manifest.json"
    manifest.write_text(manifest.read_text().replace("lower -> yo", "yo -> lower"))
    for kind in ("lsa", "word2vec", "missing"):
        with pytest.raises(ModelImportError):
            store.load(spark, str(tmp_path / kind))
    with pytest.raises(InvalidInput):
        store.backend("bm25")


def test_cnn_encodes_whole_texts(spark):
    p = cnn.CnnParameters(dimensions=4, filters=4, max_length=8, batch=2)
    model = cnn.Cnn(p, ["a", "b", "c"], cnn.initial_weights(p, 3))
    texts = [["a"] * 8, ["a"] * 8 + ["b"] * 8, ["a"] * 8 + ["c"] * 3, ["x"] * 8 + ["b"] * 8, ["x"], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r for r in cnn.transform(model, df, whole=True).collect()}
    assert [got[i]["known_tokens"] for i in range(6)] == [8, 16, 11, 8, 0, 0]
    v = [np.array(got[i]["vec"]) for i in range(6)]
    mean = v[0] + v[3]
    assert np.allclose(v[1], mean / np.linalg.norm(mean), atol=1e-6) and not np.allclose(v[0], v[2]) and not v[4].any() and not v[5].any()
    prefix = {r["doc_id"]: r["vec"] for r in cnn.transform(model, df).collect()}
    assert np.allclose(prefix[0], v[0]) and np.allclose(prefix[1], v[0])


def test_registered_models_use_the_defaults(monkeypatch):
    from inspect import signature

    from textquarry.plans import queries

    monkeypatch.setattr(queries, "_prepared", lambda spark, sf_dir: "rows")
    for module, query in ((word2vec, queries.word_vector_documents), (cnn, queries.cnn_documents)):
        own, seen = signature(module.fit), []
        monkeypatch.setattr(module, "fit", lambda *a, own=own, seen=seen, **k: seen.append(own.bind(*a, **k).arguments))
        monkeypatch.setattr(module, "transform", lambda *a, seen=seen, **k: seen.append(k))
        query(None, "")
        assert set(seen[0]) <= {"docs", "partitions"}
    assert seen[1] == {"whole": True}
