import random

from textquarry.llm.format_duplicates import collapsed

SCHEMA = "review_id long, review string, sentiment string, attrs string, kept_id int, copies string"


def run(spark, rows):
    records, members = collapsed(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    return records.collect(), {(r["kept_id"], r["review_id"]) for r in members.collect()}, members


def test_formatting_is_ignored(spark):
    rows = [
        (5, "Очень хороший товар, беру!", "positive", '{"a": 1, "b": "x"}'), (3, "очень  ХОРОШИЙ товар - беру", " Positive", '{"b":"x","a":1}'), (9, "очень​ хоро­ший товар\nберу", "POSITIVE ", '{"a":1,"b":"x"}'),
        (4, "очень хороший товар беру", "negative", '{"a":1,"b":"x"}'), (6, "очень хороший товар беру", "positive", None), (7, "очень хороший товар беру", "positive", '{"a":1,"b":"y"}'), (8, "очень хороший товар беру", "positive", None),
        (10, "ещё раз это й", "neautral", "{}"), (11, "Ещё раз это й", "Neutral", "{ }"), (12, "еще раз это й", "neutral", "{}"), (13, "один два три", "positive", None), (14, "один два три", "positive", None),
        (15, None, "positive", None), (16, "", None, None), (17, "a b c d", None, "not json"), (18, "A-b c_d", None, "not json"), (19, "a b c d", None, "not  json"), (20, "a b c d", "", "not json"),
    ]
    records, members, _ = run(spark, rows)
    assert members == {(3, 5), (3, 9), (6, 8), (10, 11), (17, 18)}
    assert {r["kept_id"]: (r["copies"], r["raw_forms"]) for r in records} == {3: (3, 3), 4: (1, 1), 6: (2, 1), 7: (1, 1), 10: (2, 2), 12: (1, 1), 17: (2, 2), 19: (1, 1), 20: (1, 1)}


def test_hot_records(spark):
    rng = random.Random(1)
    words = "хорошее платье пришло быстро и село точно".split()
    rows = [(i, "".join(w + rng.choice([" ", ", ", " - ", "\n"]) for w in words), "positive", None) for i in range(900)]
    rows += [(1000 + i, f"другой отзыв номер {i % 500}", "negative", None) for i in range(1000)]
    records, members, frame = run(spark, rows)
    assert frame.count() == len(members) == 899 + 500
    assert sum(r["copies"] for r in records) == len(rows) and len(records) == 501


def test_repeated_rows_and_empty_table(spark):
    records, members, frame = run(spark, [(1, "a b c d", "x", None)] * 3 + [(None, "a b c d", "x", None)])
    assert members == set() and records[0]["copies"] == 3
    assert run(spark, [])[:2] == ([], set())
