"""Problem 10: how demanding each Russian document is to read, in bands 1 (easiest) to 5.

A document's coverage rank is the size of the smallest frequency-ranked vocabulary that covers a fixed share of
its words; ranks come from the counts of all words of the whole collection. The same counts tell its function words:
those that occur in a large share of all records. With word lengths and the complexity of sentences the ranks are
calibrated on labelled documents: trees fitted on a bounded sample of labels become CASE expressions, so banding a
corpus is plain SQL over a small table of measures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.words import words
from textquarry.llm.leakage import hashed
from textquarry.llm.term_frequency import term_counts
from textquarry.session import materialize

SHARES = (0.5, 0.75, 0.9)
RANKS = [f"rank_{round(100 * s)}" for s in SHARES]
MEASURES = [*RANKS, "sentence_words", "commas", "function_words", "common_words", "sentence_function_words", "letters", "long_letters"]
COMMON, FUNCTION = 0.02, 0.1  # words in more than this share of all records
HELD_WORDS = 200_000
_NOT_RUSSIAN = "іїєґўђјљњћџ"
_MARKUP = re.compile(r"<[^<>]{1,200}>|https?://\S+")
_SENTENCE_END = re.compile(r"[.!?…]+(?:\s|$)|\n+")


def vocabulary(counts: DataFrame, records: int, held: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame]:
    """((hashes, ranks, kinds), others): what is sent to the tasks, and (term, rank) of all other words.

    A word's rank is one more than the number of words that occur more often. Sent are the words of the highest
    frequencies, `held` at most, and those in more than COMMON of all records, which are no more than the words of an
    average record over COMMON; kinds is 2 above FUNCTION, 1 above COMMON, else 0. The distinct frequencies, which
    are ranked in one place, are less than the root of twice the number of words.
    """
    levels = counts.groupBy("occurrences").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("occurrences")))
    levels = materialize(levels.withColumn("upto", upto).withColumn("rank", F.col("upto") - F.col("n") + 1).drop("n"), "levels")
    ranked = counts.join(F.broadcast(levels), "occurrences")
    kind = F.when(F.col("records") > FUNCTION * records, 2).when(F.col("records") > COMMON * records, 1).otherwise(0)
    sent = (F.col("upto") <= held) | (kind > 0)
    top = ranked.where(sent).select("term", "rank", kind.alias("kind")).toArrow()
    h = hashed(top["term"].to_pylist())
    order = np.argsort(h)
    return (h[order], top["rank"].to_numpy()[order].astype(np.float64), top["kind"].to_numpy()[order].astype(np.int8)), ranked.where(~sent).select("term", "rank")


class WordTable(dict):
    """Numbers of words, and for each its letters, alphabet, rank (infinite if it was not sent) and kind."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.known = known
        self.words: list[str] = []
        self.columns = np.empty((0, 5))

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def table(self) -> np.ndarray:
        """Rows (letters, cyrillic, foreign, rank, kind) of all words, those met since the last call added."""
        new = self.words[len(self.columns) :]
        if new:
            hashes, ranks, kinds = self.known
            own = hashed(new)
            at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
            found = hashes[at] == own if len(hashes) else np.zeros(len(new), bool)
            foreign = [not {*_NOT_RUSSIAN}.isdisjoint(w) for w in new]
            rows = [[len(w) for w in new], ["а" <= w[0] <= "я" or w[0] in _NOT_RUSSIAN for w in new], foreign]
            rank, kind = np.full(len(new), np.inf), np.zeros(len(new))
            rank[found], kind[found] = ranks[at[found]], kinds[at[found]]
            self.columns = np.concatenate([self.columns, np.column_stack([*np.array(rows, float), rank, kind])])
        return self.columns

    def empty(self) -> None:
        self.clear()
        self.words, self.columns = [], np.empty((0, 5))


def _at_shares(values: np.ndarray, owner: np.ndarray, ends: np.ndarray, sizes: np.ndarray, shares) -> np.ndarray:
    """Of each document, the value that covers each share of its words."""
    ordered = values[np.lexsort((values, owner))]
    return np.column_stack([ordered[ends - sizes + np.ceil(s * sizes).astype(np.int64) - 1] for s in shares])


def measure_texts(texts: list[str], table: WordTable) -> tuple[list[int], dict[str, np.ndarray], list[list[str] | None]]:
    """(places, columns, rest) of the texts that have words: n, words, russian, known and MEASURES. Where a share is
    only covered with words that were not sent, its rank is infinite and rest has all such words of the text.

    Russian is a text most of whose words begin with a Cyrillic letter and of whose words few have letters
    that Russian lacks."""
    if len(table) > HELD_WORDS:
        table.empty()
    places, tokens, whole, sentences, commas = [], [], [], [], []
    for i, text in enumerate(texts):
        all_words = words(text)
        if not all_words:
            continue
        plain = _MARKUP.sub(" ", text) if "<" in text or "://" in text else text
        places.append(i)
        whole.append(len(all_words))
        tokens.append((words(plain) or all_words) if plain is not text else all_words)
        sentences.append(max(1, sum(1 for s in _SENTENCE_END.split(plain) if any(c.isalpha() for c in s))))
        commas.append(plain.count(","))
    sizes = np.array([len(t) for t in tokens], np.int64)
    ends = np.cumsum(sizes)
    numbers = np.fromiter((table[w] for t in tokens for w in t), np.int64, int(sizes.sum()))
    if not len(places):
        return [], {}, []
    letters, cyrillic, foreign, rank, kind = table.table()[numbers].T
    owner, starts = np.repeat(np.arange(len(places)), sizes), ends - sizes
    sums = {name: np.add.reduceat(x, starts) for name, x in {"letters": letters, "cyrillic": cyrillic, "foreign": foreign, "known": np.isfinite(rank), "function": kind == 2, "common": kind > 0}.items() for x in [x.astype(float)]}
    n, per = sizes.astype(float), np.array(sentences, float)
    covered = _at_shares(rank, owner, ends, sizes, SHARES)
    columns = {"n": sizes, "words": np.array(whole), "russian": (2 * sums["cyrillic"] > n) & (20 * sums["foreign"] < n), "known": sums["known"].astype(np.int64)}
    columns |= {name: covered[:, k] for k, name in enumerate(RANKS)}
    columns |= {"sentence_words": n / per, "commas": np.array(commas) / per, "function_words": sums["function"] / n, "common_words": sums["common"] / n, "sentence_function_words": sums["function"] / per}
    columns |= {"letters": sums["letters"] / n, "long_letters": _at_shares(letters, owner, ends, sizes, (0.9,))[:, 0]}
    rest = [[w for w in tokens[k] if not np.isfinite(table.columns[table[w], 3])] if np.isinf(covered[k]).any() else None for k in range(len(places))]
    return places, columns, rest


def measured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", held_words: int = 200_000) -> DataFrame:
    """(doc_id, words, russian, *MEASURES) of each document that has words, written once; null texts have none.

    Ranks are those of the whole vocabulary, whatever is sent to the tasks: documents that need others have their
    remaining words joined with the ranks of these, none of which is frequent."""
    kind = dict(documents.dtypes)[doc_id]
    spark = documents.sparkSession
    counts = materialize(term_counts(documents, text), "counts")
    top, others = vocabulary(counts, documents.count(), held_words)
    held = spark.sparkContext.broadcast(top)
    types = {"n": pa.int32(), "words": pa.int32(), "russian": pa.bool_(), "known": pa.int32(), **dict.fromkeys(MEASURES, pa.float64())}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = WordTable(held.value), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                valid = batch.filter(pa.compute.is_valid(batch.column(1)))
                places, columns, rest = measure_texts(valid.column(1).to_pylist(), table)
                arrays = [pa.array(columns.get(name, []), t) for name, t in types.items()]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(places)), pa.int64()), valid.column(0).take(pa.array(places, pa.int64())), *arrays, pa.array(rest, pa.list_(pa.string()))], ["row", "doc_id", *types, "rest"])
                row += len(places)

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"row long, doc_id {kind}, n int, words int, russian boolean, known int, {', '.join(f'{m} double' for m in MEASURES)}, rest array<string>"
    table = materialize(rows.mapInArrow(each, schema), "measured")
    last = F.lit(float(counts.count() + 1))  # words that only markup makes
    needed = table.where("rest is not null").select("row", F.explode("rest").alias("term")).join(others, "term", "left")
    lists = needed.groupBy("row").agg(F.array_sort(F.collect_list(F.coalesce(F.col("rank").cast("double"), last))).alias("ranks"))
    place = {name: F.ceil(F.lit(s) * F.col("n")).cast("int") - F.col("known") for name, s in zip(RANKS, SHARES, strict=True)}
    whole = [F.when(place[name] > 0, F.get("ranks", place[name] - 1)).otherwise(F.col(name)).alias(name) for name in RANKS]
    return materialize(table.join(lists, "row", "left").select("doc_id", "words", "russian", *whole, *MEASURES[len(RANKS) :]), "measures")


def fit_tree(x: np.ndarray, bands: np.ndarray, depth: int, least: int, rng: np.random.Generator, tried: int):
    """A tree of (measure, threshold, left, right), with the mean share of each band at its leaves."""
    counts = np.bincount(bands, minlength=6)
    if depth and len(bands) >= 2 * least and counts.max() < len(bands):
        best = None
        for j in rng.choice(x.shape[1], tried, replace=False):
            order = np.argsort(x[:, j], kind="stable")
            value, upto = x[order, j], np.cumsum(np.eye(6)[bands[order]], axis=0)
            cut = np.arange(least, len(bands) - least + 1)
            cut = cut[value[cut - 1] < value[np.minimum(cut, len(bands) - 1)]]
            if not len(cut):
                continue
            left = upto[cut - 1]
            purity = (left**2).sum(1) / cut + ((upto[-1] - left) ** 2).sum(1) / (len(bands) - cut)
            k = int(purity.argmax())
            if best is None or purity[k] > best[0]:
                best = purity[k], j, (value[cut[k] - 1] + value[cut[k]]) / 2
        if best:
            below = x[:, best[1]] <= best[2]
            sides = [fit_tree(x[s], bands[s], depth - 1, least, rng, tried) for s in (below, ~below)]
            return int(best[1]), float(best[2]), *sides
    return counts / max(1, len(bands))


def fit_bands(x: np.ndarray, bands: np.ndarray, trees: int = 9, depth: int = 6, least: int = 4, seed: int = 0) -> list:
    rng = np.random.default_rng(seed)
    tried = max(1, x.shape[1] // 2)
    drawn = [rng.integers(0, len(bands), len(bands)) for _ in range(trees)]
    return [fit_tree(x[d], bands[d], depth, least, rng, tried) for d in drawn]


def tree_sql(tree, leaves: list) -> str:
    """The number of a row's leaf as a CASE expression over MEASURES; appends each leaf's shares to leaves."""
    if isinstance(tree, tuple):
        sides = [tree_sql(side, leaves) for side in tree[2:]]
        return f"CASE WHEN {MEASURES[tree[0]]} <= {tree[1]!r}D THEN {sides[0]} ELSE {sides[1]} END"
    leaves.append(tree)
    return str(len(leaves))


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_words: int = 200_000, label_rows: int = 20_000, seed: int = 0) -> DataFrame:
    """(doc_id, words, russian, *MEASURES, band) of each document that has words.

    band is null for documents that are not Russian, and for all where no label is usable. Every document's
    measures are taken from its whole text. The fit sees label_rows labels at most, drawn by a hash of id and
    annotator over all labels; labels outside 1 to 5, null ones and those of unknown documents do not count,
    several annotators of a document each do.
    """
    table = measured(documents, doc_id, text, held_words)
    usable = labels.where("band between 1 and 5").select("doc_id", "band", F.xxhash64(F.lit(seed), "doc_id", "annotator").alias("_order"))
    sample = table.where("russian").join(usable, "doc_id").orderBy("_order", "doc_id", "band").limit(label_rows).select(*MEASURES, "band").toPandas()
    if sample.empty:
        return table.withColumn("band", F.lit(None).cast("int"))
    forest = fit_bands(sample[MEASURES].to_numpy(float), sample["band"].to_numpy(int), seed=seed)
    leaves: list[list] = [[] for _ in forest]
    placed = table.select("*", *[F.expr(tree_sql(tree, own)).alias(f"leaf_{i}") for i, (tree, own) in enumerate(zip(forest, leaves, strict=True))])

    shares = [F.element_at(F.lit([[round(float(x), 6) for x in leaf[1:]] for leaf in own]), F.col(f"leaf_{i}")) for i, own in enumerate(leaves)]
    total = reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a + b), shares)
    scored = placed.withColumn("shares", total)
    band = F.array_position("shares", F.array_max("shares")).cast("int")  # the easier of two equal bands
    return scored.withColumn("band", F.when(F.col("russian"), band)).select(*table.columns, "band")
