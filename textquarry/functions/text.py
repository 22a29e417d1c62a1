"""Text columns on the JVM: normalization, tokens, word filters, excerpts and keys.

Everything is built-in expressions inside whole-stage code, but for NFC: Spark has no function for it, so
texts that hold a character outside ranges known to be composed go through one Arrow function, all others
stay on the JVM.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.words import INVISIBLE

TOKEN_PATTERN = r"\p{L}+(?:[-‑'’]\p{L}+)*|\p{Nd}+(?:[.,]\p{Nd}+)?"
WORD_PATTERN = r"\p{L}+(?:[-']\p{L}+)*|\p{Nd}+(?:[.,]\p{Nd}+)?"
# Code points outside these ranges may be combining or decomposable.
_MAYBE_NOT_NFC = r"[^\x00-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{2010}-\x{2027}\x{2030}-\x{203A}\x{2190}-\x{21FF}]"


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC; null stays null."""
    return F.coalesce(F.pandas_udf(_composed, "string")(F.when(text.rlike(_MAYBE_NOT_NFC), text)), text)


def tokens(text: Column) -> Column:
    """Runs of letters joined by - ‑ ' ’, and numbers with one . or ,; null text has no tokens."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def fold(text: Column) -> Column:
    """NFC, lower case, ё as е, in this order."""
    return F.translate(F.lower(nfc(text)), "ё", "е")


def normalized_tokens(text: Column) -> Column:
    return tokens(fold(text))


def words(text: Column) -> Column:
    """Words without invisible characters, with plain hyphens and apostrophes, folded."""
    plain = F.translate(text, "‐‑‘’" + INVISIBLE, "--''")
    found = F.regexp_extract_all(fold(plain), F.lit(WORD_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def without_words(tokens_: Column, stop: Sequence[str]) -> Column:
    """Drop listed words, keeping order and repeats of the rest."""
    return F.filter(tokens_, lambda t: ~t.isin(list(stop)))


def canonical_words(tokens_: Column, synonyms: dict[str, str]) -> Column:
    """Replace each token that has a canonical form."""
    if not synonyms:
        return tokens_
    table = F.create_map(*[F.lit(x) for pair in sorted(synonyms.items()) for x in pair])
    return F.transform(tokens_, lambda t: F.coalesce(table[t], t))


def has_tokens(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}|\p{Nd}"), F.lit(False))


def _counted(lists: pa.Array) -> pa.Array:
    rows = [None if t is None else sorted(Counter(t).items()) for t in lists.to_pylist()]
    return pa.array(rows, pa.map_(pa.string(), pa.int64()))


def frequency_map(tokens_: Column) -> Column:
    """Map of token to count, keys in order; counted per array, whatever its length."""
    return F.arrow_udf(_counted, "map<string, bigint>")(tokens_)


def strip(text: Column) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def joined(columns: Sequence[Column], joiner: str) -> Column:
    """Stripped parts joined; null counts as empty and keeps its joiner."""
    return F.concat_ws(joiner, *[strip(F.coalesce(c, F.lit(""))) for c in columns])


def excerpt(text: Column, length: int = 180) -> Column:
    """White space collapsed, then the first UTF-16 units; a character of two units that would be cut is left out."""
    first = F.substring(F.regexp_replace(text, r"\s+", " "), 1, length)
    units = F.substring(F.encode(first, "UTF-16BE"), 1, 2 * length)
    torn = F.hex(F.substring(units, 2 * length - 1, 1)).rlike("^D[89AB]$")
    cut = F.decode(F.when(torn, F.substring(units, 1, 2 * length - 2)).otherwise(units), "UTF-16BE")
    return F.when(first.rlike(r"[\x{10000}-\x{10FFFF}]"), cut).otherwise(first)


def excerpt_split(text: Column, length: int = 200) -> Column:
    """Like excerpt, with Unicode white space and trimmed ends."""
    return F.substring(strip(F.regexp_replace(text, r"[\s\p{Z}]+", " ")), 1, length)


def body_key(text: Column) -> Column:
    return strip(nfc(text))


def comparison_key(text: Column) -> Column:
    return F.regexp_replace(strip(fold(text)), r"[\s\p{Z}]+", " ")


def surrogate_id(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def encode_words(tokens_: Column, vocabulary: Column, length: int | None = None) -> Column:
    """Ids from a map column; unknown words are 1. With a length, cut and padded by 0."""
    ids = F.transform(tokens_, lambda t: F.coalesce(vocabulary[t], F.lit(1)))
    if length is None:
        return ids
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def labels_replaced(label: Column, mapping: dict[str, str]) -> Column:
    """Replace label values that the mapping names."""
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    return F.coalesce(table[label], label)


def category(text: Column, mapping: dict[str, str] | None = None) -> Column:
    """A label without surrounding white space and letter case, after a mapping of spellings."""
    plain = F.lower(strip(text))
    return labels_replaced(plain, mapping) if mapping else plain
