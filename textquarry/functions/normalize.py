"""Normalization branches: tokens as they are, stemmed, or by a dictionary of lemmas."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.functions.lexicon import STOP_WORDS, synonym_table
from textquarry.functions.stem_ru import stem
from textquarry.functions.text import canonical_words, frequency_map, normalized_tokens, tokens, without_words

METHODS = ("none", "stem", "lemma")
PROFILE = "nfc -> lower -> yo-snowball-ru-stop75-v1"
_HYPHEN = re.compile("([-‑])")
_CYRILLIC = re.compile("[а-я]+")


@lru_cache(maxsize=200_000)
def stem_token(token: str) -> str:
    """Each part between hyphens that is Cyrillic letters only is stemmed; ё is read as е before and after."""
    parts = _HYPHEN.split(token.replace("ё", "е"))
    return "".join(stem(p).replace("ё", "е") if _CYRILLIC.fullmatch(p) else p for p in parts)


def _stemmed(lists: pa.Array) -> pa.Array:
    """Each distinct token of a batch is stemmed once."""
    values = lists.flatten().dictionary_encode()
    stems = pa.array([stem_token(t) for t in values.dictionary.to_pylist()], pa.string()).take(values.indices)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, stems, mask=lists.is_null())


def stemmed(tokens_: Column) -> Column:
    """Stems of a token array; each worker keeps those of frequent tokens. Arrays without a Cyrillic letter stay
    on the JVM."""
    has = F.exists(tokens_, lambda t: t.rlike("[а-я]"))
    return F.coalesce(F.arrow_udf(_stemmed, "array<string>")(F.when(has, tokens_)), tokens_)


def lemma_token(token: str, lemmas: Callable[[str], str | None]) -> str:
    """Each Cyrillic part by the dictionary; unknown parts stay."""
    parts = _HYPHEN.split(token)
    return "".join((lemmas(p) or p).replace("ё", "е") if _CYRILLIC.fullmatch(p) else p for p in parts)


def lemmatized(df: DataFrame, column: str, lemmas: DataFrame, into: str) -> DataFrame:
    """df with the lemmas of a token array by a table (form, lemma).

    Only distinct Cyrillic parts meet the dictionary, by an equi-join of whatever sizes; their forms come back
    as one map per row. Rows keep their number, null arrays stay null.
    """
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    part = F.explode(F.array_distinct(F.flatten(F.transform(column, lambda t: F.split(t, "[-‑]"))))).alias("form")
    known = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    maps = keyed.select("_row", part).where(F.col("form").rlike("^[а-я]+$")).join(known, "form").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("form", F.translate("lemma", "ё", "е")))).alias("_map"))

    def replaced(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit("[^-‑]+|[-‑]"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.col("_map")[p], p)), "")

    joined = keyed.join(maps, "_row", "left")
    return joined.withColumn(into, F.when(F.col("_map").isNull(), F.col(column)).otherwise(F.transform(column, replaced))).drop("_row", "_map")


def vocabulary(
    df: DataFrame, text: str = "text", method: str = "stem", stop: tuple[str, ...] | None = STOP_WORDS, synonyms: dict[str, list[str]] | None = None, lemmas: DataFrame | None = None
) -> DataFrame:
    """df with original (tokens), normalized (tokens), frequencies (map, keys in order) and steps.

    Stop words and synonyms pass through the same branch as the text. Null text gives empty arrays.
    """
    if method not in METHODS:
        raise InvalidInput(f"method is one of {', '.join(METHODS)}")
    if method == "lemma" and lemmas is None:
        raise InvalidInput("method lemma needs a table of form and lemma")
    out = df.withColumn("original", tokens(F.col(text))).withColumn("normalized", normalized_tokens(F.col(text)))
    form: Callable[[str], str] = str
    if method == "stem":
        out, form = out.withColumn("normalized", stemmed(F.col("normalized"))), stem_token
    elif method == "lemma":
        out = lemmatized(out, "normalized", lemmas, "normalized")
        asked = {w for w in (*(stop or ()), *(synonyms or {}), *(v for vs in (synonyms or {}).values() for v in vs))}
        forms = {r["form"]: r["lemma"] for r in lemmas.where(F.col("form").isin([p for w in asked for p in _HYPHEN.split(w)])).groupBy("form").agg(F.min("lemma").alias("lemma")).collect()}
        form = lambda w: lemma_token(w, forms.get)
    steps = ["tokenize", "nfc", "lower", "yo", *([method] if method != "none" else [])]
    if stop:
        out, steps = out.withColumn("normalized", without_words(F.col("normalized"), sorted({form(w) for w in stop}))), [*steps, "stop_words"]
    if synonyms:
        out, steps = out.withColumn("normalized", canonical_words(F.col("normalized"), synonym_table(synonyms, form))), [*steps, "synonyms"]
    return out.withColumn("frequencies", frequency_map(F.col("normalized"))).withColumn("steps", F.lit(steps))


def prepared_tokens(text: Column) -> Column:
    """The retrieval profile: folded tokens, stemmed, without stemmed stop words."""
    return without_words(stemmed(normalized_tokens(text)), sorted({stem_token(w) for w in STOP_WORDS}))
