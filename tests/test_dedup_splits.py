import random
from itertools import pairwise

import pytest

from textquarry.errors import InvalidInput
from textquarry.functions.java_random import JavaRandom
from textquarry.operators import dedup
from textquarry.operators.skew import lookup_join
from textquarry.operators.splits import allocate, hashed_splits, sample_per_group, seeded_splits, split_overlaps_exact, validation_groups


def test_majority_labels(spark):
    rows = [("A", "positive"), ("A ", "positive"), ("A", "negative"), ("B", "neautral"), ("C", "positive"), ("C", "negative"), (" ", "positive"), ("D", None), (None, "x"), ("D", "negative")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "review string, sentiment string, n int")
    got = {r["text"]: (r["label"], r["rows"], r["labels"]) for r in dedup.majority_labels(df, "review", "sentiment", {"neautral": "neutral"}).collect()}
    assert got == {"A": ("positive", 3, 2), "B": ("neutral", 1, 1), "D": ("negative", 1, 1)}
    assert dedup.majority_statistics(df, "review", "sentiment").first().asDict() == {"rows": 10, "empty": 3, "kept": 3, "ties": 1, "resolved": 1}
    assert dedup.majority_labels(df.where("false"), "review", "sentiment").count() == 0


def test_policies(spark):
    schema = "id string, text string, label string, split string"
    df = spark.createDataFrame([("1", "a", "x", None), ("2", "a", "x", None), ("3", "b", "x", None), ("4", "c", "x", None), ("5", "c", "y", None), ("6", "c", "y", None), ("7", "d", "x", None), ("8", "d", "y", None)], schema)
    ids = lambda **p: sorted(r["id"] for r in dedup.deduplicate(df, **p).collect())
    assert ids(duplicates="keep", conflicts="majority", tie="drop") == ["1", "3", "5"]
    assert ids(duplicates="drop", conflicts="majority", tie="drop") == ["3", "5"]
    for bad in ({}, {"duplicates": "keep"}, {"duplicates": "keep", "conflicts": "majority"}, {"duplicates": "first"}):
        with pytest.raises(InvalidInput):
            ids(**bad)


def test_urls_and_articles(spark):
    df = spark.createDataFrame([(1, "u", "t", "x"), (2, "u", "", "y"), (3, "v", "t", "x"), (4, None, "t", "z"), (5, " ", "t", "z"), (6, "w", "t", "x")], "id long, url string, title string, text string")
    assert [r["id"] for r in dedup.unrepeated(df, "url").orderBy("id").collect()] == [3, 6]
    assert [r["id"] for r in dedup.unrepeated(df, "url", df["title"] != "", valid_first=True).orderBy("id").collect()] == [1, 3, 6]
    assert [r["id"] for r in dedup.first_of_text(df, ["title", "text"], "id").orderBy("id").collect()] == [1, 2, 4]
    assert {r["title"]: r["texts"] for r in dedup.distinct_per_group(df, "title", ["title", "text"]).collect()} == {"t": 2, "": 1}
    assert dedup.top_by_hash(df, ["title"], "id", 2).count() == 3


def greedy(rows):
    ids, bodies, kept = set(), set(), []
    for seq, i, b in rows:
        if i not in ids and b not in bodies:
            kept.append(seq)
            ids.add(i)
            bodies.add(b)
    return kept


def test_greedy_unique(spark):
    assert greedy([(1, "1", "X"), (2, "2", "X"), (3, "2", "Z")]) == [1, 3]
    rng = random.Random(2)
    rows = [(i, f"i{rng.randrange(60)}", f"b{rng.randrange(60)}") for i in range(200)] + [(200 + i, "hot", f"c{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "seq long, id string, body string")
    assert sorted(r["seq"] for r in dedup.greedy_unique(df, "seq", ["id", "body"]).collect()) == greedy(rows)


def test_load_corpus(spark):
    rows = [("1", "", "один", 1), ("2", "", " !", 2), ("1", "", "два", 3), ("3", "", "три", 4), ("4", "", "три", 5)]
    df = spark.createDataFrame(rows, "id string, title string, text string, seq long")
    corpus, counters = dedup.load_corpus(df, 2)
    assert [r["id"] for r in corpus.orderBy("seq").collect()] == ["1", "3"]
    assert counters.first().asDict() == {"scanned": 4, "empty": 1, "duplicates": 1, "documents": 2}
    assert dedup.load_corpus(df, 10)[1].first().asDict() == {"scanned": 5, "empty": 1, "duplicates": 2, "documents": 2}
    with pytest.raises(InvalidInput):
        dedup.load_corpus(df, 1)
    with pytest.raises(InvalidInput):
        dedup.load_corpus(df.where("seq = 2"), 5)


def test_first_rows_by_counting(spark):
    rng = random.Random(1)
    values = rng.sample(range(-(10**12), 10**12), 500) + list(range(100))
    df = spark.createDataFrame([(v,) for v in values], "o long")
    for n in (1, 7, 333, 600, 900):
        got = sorted(r["o"] for r in dedup.first_rows(df, "o", n, held=0, buckets=16).collect())
        assert got == sorted(values)[:n]


def test_lookup_join_with_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}", "e") for i in range(600)] + [(999, None, "e"), (998, "none", "e")], "id long, key string, value string")
    mapping = rows.where("key is not null and key <> 'none'").groupBy("key").count().selectExpr("key", "concat('v', key) as found", "count as n")
    for parts in (2, 1000):
        got = lookup_join(rows, mapping, "key", "n", "id", parts=parts).collect()
        assert len(got) == 600 and all(r["found"] == "v" + r["key"] for r in got)
    assert lookup_join(rows, mapping.where("false"), "key", "n", "id").count() == 0


@pytest.mark.parametrize(("rows", "shares", "want"), [(20, (0.67, 0.1, 0.23), None), (1, (0.5, 0, 0.5), {"train": 1, "validation": 0, "test": 0}), (6, (0.67, 0.33, 0), {"train": 4, "validation": 2, "test": 0})])
def test_allocation(rows, shares, want):
    got = allocate(rows, dict(zip(("train", "validation", "test"), shares, strict=True)))
    assert sum(got.values()) == rows and (want is None or got == want)


def test_seeded_splits(spark):
    df = spark.createDataFrame([(str(i), f"t{i}", "ab"[i % 2], None) for i in range(40)], "id string, text string, label string, split string")
    shares = {"train": 0.65, "validation": 0.1, "test": 0.25}
    got = seeded_splits(df, shares).collect()
    sizes = {(r["label"], r["split"]): 0 for r in got}
    for r in got:
        sizes[r["label"], r["split"]] += 1
    assert sizes == {(c, s): n for c in "ab" for s, n in (("train", 13), ("validation", 2), ("test", 5))}
    assert {r["id"]: r["split"] for r in got} == {r["id"]: r["split"] for r in seeded_splits(df.repartition(7), shares).collect()}
    assert seeded_splits(df.where("false"), shares).count() == 0


def test_hashed_splits_match_allocation(spark):
    rows = [(i, ["a", "b", None][i % 3] if i % 7 else "c") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string")
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    got = hashed_splits(df, shares).groupBy("label", "split").count().collect()
    for label in ("a", "b", "c", None):
        n = sum(x == label for _, x in rows)
        assert {r["split"]: r["count"] for r in got if r["label"] == label} == allocate(n, shares)


def test_samples(spark):
    df = spark.createDataFrame([(str(i), f"t{i}", "ab"[i % 2], "train" if i % 4 < 2 else "test") for i in range(80)], "id string, text string, label string, split string")
    sizes = lambda **p: {(r["label"], r["split"]): r["count"] for r in sample_per_group(df, **p).groupBy("label", "split").count().collect()}
    assert sizes(per_class=3) == {(c, s): 3 for c in "ab" for s in ("train", "test")}
    assert sizes(per_split={"train": 5}) == {("a", "train"): 5, ("b", "train"): 5}
    assert sizes(per_class=4, per_split={"train": 9, "test": 2}) == {(c, s): n for c in "ab" for s, n in (("train", 4), ("test", 2))}
    assert sample_per_group(df).count() == 80
    assert split_overlaps_exact(df).first()[0] == 0 and split_overlaps_exact(df.union(df.selectExpr("id", "text", "label", "'other'"))).first()[0] == 80


def test_java_random():
    r = JavaRandom(42)
    assert [r.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]  # as the platform documents for seed 42
    r = JavaRandom(42)
    assert [r.bits(32) for _ in range(2)] == [-1170105035, 234785527]
    items = list(range(20))
    JavaRandom(1).shuffle(items)
    assert sorted(items) == list(range(20)) and items != list(range(20))


def test_validation_groups():
    documents = [[f"d{i}"] for i in range(18)] + [["d0"], ["d1"]]
    train, held = validation_groups(documents, 0.2, 42)
    assert sorted(train + held) == list(range(20))
    assert not {tuple(documents[i]) for i in train} & {tuple(documents[i]) for i in held}
    assert len({tuple(documents[i]) for i in held}) == 4
    assert all(a < b for a, b in pairwise(train))
    with pytest.raises(InvalidInput):
        validation_groups([["a"], ["b"], ["c"]], 0.5, 1)


def test_control_numbers(spark):
    statistics = spark.createDataFrame([(5, 3)], "rows long, kept long")
    assert dedup.require_statistics(statistics, {"rows": 5, "kept": 3}) is statistics
    with pytest.raises(InvalidInput, match="kept: 3 instead of 4"):
        dedup.require_statistics(statistics, {"rows": 5, "kept": 4})
