import unicodedata

import pytest
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.functions import text as T
from textquarry.functions.lexicon import STOP_WORDS, SYNONYMS, stop_words, synonym_table
from textquarry.functions.normalize import lemmatized, prepared_tokens, stem_token, vocabulary
from textquarry.functions.stem_ru import stem
from textquarry.functions.words import words


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_tokens(spark):
    text = unicodedata.normalize("NFD", "ЁЛКА Мир world 12 3,14 2.5 по‑русски rock’n’roll x_y")
    got = one(spark, text, lambda c: T.tokens(T.nfc(c)))
    assert got == ["ЁЛКА", "Мир", "world", "12", "3,14", "2.5", "по‑русски", "rock’n’roll", "x", "y"]
    assert one(spark, "² ½ Ⅻ ௰ १२", T.tokens) == ["१२"]
    assert one(spark, "--- !? _", T.tokens) == one(spark, None, T.tokens) == []


def test_order_of_folding(spark):
    assert one(spark, unicodedata.normalize("NFD", "ЁЖ Й"), T.fold) == "еж й"


def test_words_agree_with_workers(spark):
    texts = ["Ёлка-палка don’t 3,14 x²", "при­вет по‑русски", None, "", unicodedata.normalize("NFD", "Йод ёж"), "𝐛 a1b2"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["x"] for r in df.select(T.words(F.col("text")).alias("x")).collect()] == [words(t) for t in texts]


def test_normalization_goldens(spark):
    assert one(spark, "Ёлками и машины НЕ были ни 12,5", prepared_tokens) == "елк машин не ни 12,5".split()
    assert one(spark, "Машины-ёлки don't PYTHON", prepared_tokens) == ["машин-елк", "don't", "python"]
    assert [stem_token(w) for w in ("платье", "русско-английская", "русско‑английский")] == ["плат", "русск-английск", "русск‑английск"]


@pytest.mark.parametrize(("word", "want"), [("вежливость", "вежлив"), ("важнейшие", "важн"), ("красивейший", "красив"), ("авиационный", "авиацион"), ("пугаясь", "пуг"), ("любовь", "любов"), ("а", "а"), ("", ""), ("вв", "вв"), ("длинный", "длин")])
def test_stems(word, want):
    assert stem(word) == want


def test_vocabulary_branches(spark):
    df = spark.createDataFrame([(1, "Отличный отличный товар и не плохой"), (2, None)], "id long, text string")
    rows = {r["id"]: r for r in vocabulary(df, "text", "stem", STOP_WORDS, SYNONYMS).collect()}
    assert rows[1]["original"] == ["Отличный", "отличный", "товар", "и", "не", "плохой"]
    assert rows[1]["normalized"] == ["хорош", "хорош", "товар", "не", "плох"]
    assert rows[1]["frequencies"] == {"не": 1, "плох": 1, "товар": 1, "хорош": 2}
    keys = vocabulary(df, "text", "stem", STOP_WORDS, SYNONYMS).select(F.map_keys("frequencies").alias("k")).first()["k"]
    assert keys == sorted(keys)
    assert rows[1]["steps"] == ["tokenize", "nfc", "lower", "yo", "stem", "stop_words", "synonyms"]
    assert rows[2]["normalized"] == [] and rows[2]["original"] == []
    plain = vocabulary(df, "text", "none", None).first()
    assert plain["normalized"] == ["отличный", "отличный", "товар", "и", "не", "плохой"] and plain["steps"][-1] == "yo"
    lemmas = spark.createDataFrame([("машины", "машина"), ("елками", "ёлка"), ("были", "быть")], "form string, lemma string")
    text = spark.createDataFrame([("Ёлками-машины были x",), ("",)], "text string")
    assert [r["normalized"] for r in vocabulary(text, "text", "lemma", STOP_WORDS, None, lemmas).collect()] == [["елка-машина", "x"], []]
    with pytest.raises(InvalidInput):
        vocabulary(df, "text", "other")


def test_lemmas_keep_rows(spark):
    lemmas = spark.createDataFrame([("дома", "дом"), ("дома", "дома")], "form string, lemma string")
    df = spark.createDataFrame([(1, ["дома", "дома"]), (2, []), (3, None), (3, None)], "id long, t array<string>")
    got = sorted((r["id"], r["o"]) for r in lemmatized(df, "t", lemmas, "o").collect() if r["o"] is not None)
    assert got == [(1, ["дом", "дом"]), (2, [])] and lemmatized(df, "t", lemmas, "o").count() == 4


def test_lexicon_rules():
    assert len(STOP_WORDS) == 75 and len(set(STOP_WORDS)) == 75
    assert stop_words(["# c", "", *STOP_WORDS, "а"]) == STOP_WORDS
    for bad in (STOP_WORDS[:49], [*STOP_WORDS, "не"]):
        with pytest.raises(InvalidInput):
            stop_words(bad)
    assert synonym_table(SYNONYMS)["отличный"] == "хороший"
    for bad in (dict(list(SYNONYMS.items())[:9]), SYNONYMS | {"x": ["y"]}, SYNONYMS | {"x": ["отличный", "y"]}):
        with pytest.raises(InvalidInput):
            synonym_table(bad)


def test_keys_and_excerpts(spark):
    assert one(spark, "\xa0 a\tb \n", T.strip) == "a\tb"
    assert one(spark, " Ёж   и\n\nЁлка ", T.comparison_key) == "еж и елка"
    assert one(spark, "a \n b" + "c" * 300, T.excerpt) == ("a b" + "c" * 300)[:180]
    assert one(spark, " a\xa0\xa0b ", T.excerpt_split) == "a b"
    assert one(spark, "x", T.surrogate_id).startswith("sha256:2d711642b7")
    row = spark.createDataFrame([(" a ", None, "b")], "x string, y string, z string")
    assert row.select(T.joined([F.col("x"), F.col("y"), F.col("z")], "|")).first()[0] == "a||b"
    assert one(spark, " Neautral ", lambda c: T.category(c, {"neautral": "neutral"})) == "neutral"


def test_encoding_of_words(spark):
    df = spark.createDataFrame([(["a", "z", "b"],)], "t array<string>")
    table = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))
    assert df.select(T.encode_words(F.col("t"), table)).first()[0] == [2, 1, 3]
    assert df.select(T.encode_words(F.col("t"), table, 2)).first()[0] == [2, 1]
    assert df.select(T.encode_words(F.col("t"), table, 5)).first()[0] == [2, 1, 3, 0, 0]


def test_excerpts_count_utf16_units(spark):
    texts = ["a" * 200, "🙂" * 100, "a" + "🙂" * 100, "a" * 179 + "🙂", "a" * 178 + "🙂b", "é" * 190, "", None, "x \n y"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.excerpt(F.col("t"))).collect()]
    assert got == ["a" * 180, "🙂" * 90, "a" + "🙂" * 89, "a" * 179, "a" * 178 + "🙂", "é" * 180, "", None, "x y"]
