import math
import random
from collections import Counter

import numpy as np
import pytest

from textquarry.functions.words import words
from textquarry.llm.reading_level import MEASURES, SHARES, WordTable, fit_bands, measure_texts, measured, reading_levels

EASY = "Мама купила дом. Кот любит сад. Дом стоит тут. "
HARD = "Поскольку трансцендентальная концептуализация методологической парадигмы конституировала эпистемологическую дихотомию, которую феноменологический постструктурализм, несмотря на институциональную неопределённость, верифицировал, однако коррелят, вопреки тому что дискурс опосредован, остаётся. "


def corpus(n=120):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        hard = i % 2
        rows.append((i, " ".join([HARD if hard else EASY] * rng.randrange(3, 8)) + f" Слово{i}."))
        labels.append((i, 5 if hard else 1, f"ed{i % 3}"))
    return rows, labels


def test_measures():
    table = WordTable((np.array([], np.uint64), np.array([]), np.array([], np.int8)))
    texts = [" 😀 ", "Кот спит. Если дом, то сад! <br/> https://x.example/a.b?c=1", "The cat sleeps here.", "Їжак і кіт у лісі"]
    places, columns, rest = measure_texts(texts, table)
    assert places == [1, 2, 3] and columns["russian"].tolist() == [True, False, False] and len(rest[0]) == 6
    assert columns["sentence_words"][0] == 3.0 and columns["commas"][0] == 0.5 and columns["long_letters"][0] == 4
    assert measure_texts([], table)[0] == [] == measure_texts(["", "!"], table)[0]


def test_coverage_ranks(spark):
    """Ranks are those of the whole vocabulary, however few words are sent to the tasks."""
    df = spark.createDataFrame([(1, "а а а а б б в"), (2, "а б"), (3, None), (4, ""), (1, "г"), (5, "г<i>д</i>г")] + [(9, None)] * 300, "doc_id long, text string")
    for held in (200_000, 2, 0):
        got = sorted((r["doc_id"], r["rank_50"], r["rank_75"], r["rank_90"]) for r in measured(df, held_words=held).collect())
        assert got == [(1, 1, 2, 5), (1, 2, 2, 2), (2, 1, 2, 2), (5, 2, 5, 5)]  # the words of markup are counted too


def test_ranks_of_random_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{chr(1072 + int(rng.paretovariate(0.4)) % 30)}{chr(1072 + rng.randrange(20))}" for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    counts = Counter(w for t in texts for w in words(t))
    rank = {w: 1 + sum(x > n for x in counts.values()) for w, n in counts.items()}
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, term string, row int")
    for held in (5, 60):
        for r in measured(df, held_words=held).collect():
            own = sorted(rank[w] for w in words(texts[r["doc_id"]]))
            assert [r[f"rank_{round(100 * s)}"] for s in SHARES] == [own[math.ceil(s * len(own)) - 1] for s in SHARES]
            assert r["function_words"] == pytest.approx(sum(sum(w in words(t) for t in texts) > 15 for w in words(texts[r["doc_id"]])) / len(own))


def test_trees_separate():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, len(MEASURES)))
    bands = 1 + (x[:, 0] > 0) * 4
    forest = fit_bands(x, bands)

    def leaf(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    predicted = [int(sum(leaf(t, r) for t in forest).argmax()) for r in x]
    assert np.mean(np.array(predicted) == bands) > 0.97


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    held = {i for i, _, _ in labels if i % 3 == 0}
    seen = [x for x in labels if x[0] not in held] + [(7, None, "a"), (7, 9, "b"), (99999, 3, "c")]
    extra = [(1000, None), (1001, ""), (1002, "The cat is on the mat. " * 10)]
    df = spark.createDataFrame([(*r, "ru", 1) for r in rows + extra], "doc_id long, text string, lang string, band int")
    found = reading_levels(df.drop("band"), spark.createDataFrame(seen, "doc_id long, band int, annotator string"))
    got = {r["doc_id"]: r["band"] for r in found.collect()}
    assert all(got[i] == band for i, band, _ in labels if i in held)
    assert 1000 not in got and 1001 not in got and got[1002] is None


def test_without_labels(spark):
    df = spark.createDataFrame([(1, EASY)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, band int, annotator string")
    assert reading_levels(df, none).first()["band"] is None
    assert reading_levels(df.where("false"), none).count() == 0
