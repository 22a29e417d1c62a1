from collections import Counter

from textquarry.functions.words import words
from textquarry.llm.term_frequency import term_counts, term_frequencies


def test_word_rule():
    assert words("Ёлка-палка don’t 3,14 1.2.3 x² по‑русски при­вет ёж a--b") == ["елка-палка", "don't", "3,14", "1.2", "3", "x", "по-русски", "привет", "еж", "a", "b"]
    assert words(None) == words("") == words(" \n") == []


def test_counts_against_plain_counting(spark):
    texts = [None, "", "  ", "один два два", "Один ОДИН три", "два " * 5000 + "конец", "один два два"]
    df = spark.createDataFrame([(t, i, "x") for i, t in enumerate(texts)], "text string, term int, records string")
    want, records = Counter(), Counter()
    for t in texts:
        want.update(words(t))
        records.update(set(words(t)))
    for held in (1, 200_000):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df, held_terms=held).collect()}
        assert got == {t: (n, records[t]) for t, n in want.items()}


def test_marks_and_bounds(spark):
    df = spark.createDataFrame([("a b",)] * 3 + [("a",)] * 27 + [(None,)] * 10, "text string")
    got = {r["term"]: r["mark"] for r in term_frequencies(df).collect()}
    assert got == {"a": "common", "b": None}
    assert {r["term"]: r["mark"] for r in term_frequencies(df, min_records=4).collect()} == {"a": "common", "b": "rare"}


def test_empty_table(spark):
    assert term_frequencies(spark.createDataFrame([], "text string")).count() == 0
