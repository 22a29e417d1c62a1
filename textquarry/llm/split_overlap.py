"""Problem 4: records of evaluation splits that also stand, exactly or almost, in the training split.

Pairs: a record's distinct words may match in any order, so no longer passage of it is sure to survive in an alike
text. What is sure is that the parity sketches of two alike sets agree in a cell (`parity_join`), which holds some
words of each; these cells are joined by equality, so the work grows with the rows, where an automaton of all
evaluation records would have to scan every training text. The pairs are then verified exactly.

Coverage: evaluation records are cut into passages of successive words, and spread over shards. Aho-Corasick
automata of the shards scan every normalised training text that holds a passage of theirs; matched intervals are
merged, over all training texts, into the part of each evaluation record that the training split contains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import category
from textquarry.functions.words import words
from textquarry.llm.leakage import hashed
from textquarry.llm.near_duplicates import shingles
from textquarry.llm.parity_join import Bands, candidate_pairs, filled_cells, set_hash, signed, verified_links
from textquarry.operators.skew import lookup_join
from textquarry.session import drop_table, materialize, shared_path

EVALUATION = ("validation", "test")
BAND_FACTOR, CELLS = 2, 1.5  # few cells, so that most hold several words and their contents are rare


def _word_rows(corpus: DataFrame, record_id: str, text: str, split: str, source: str, min_words: int, bands: Bands) -> DataFrame:
    """(id, split, source, set_id, text_id, size, filled, elements, words) of rows with a known split and min_words
    distinct words or more; text_id stands for the words in their order, set_id for them in any."""

    def split_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                found = [(i, w) for i, t in enumerate(batch.column(3)) if len(set(w := words(t.as_py()))) >= min_words]
                sets = [np.unique(hashed(w)) for _, w in found]
                texts = [" ".join(w) for _, w in found]
                columns = [batch.column(k).take(pa.array([i for i, _ in found], pa.int64())) for k in range(3)]
                ids = [signed(np.array([set_hash(s)[0] for s in sets], np.uint64)), signed(np.array([xxhash.xxh3_64_intdigest(t.encode()) for t in texts], np.uint64))]
                sizes = [pa.array([len(s) for s in sets], pa.int32()), pa.array(filled_cells(sets, bands), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *ids, *sizes, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(texts, pa.string())], names)

    names = ["id", "split", "source", "set_id", "text_id", "size", "filled", "elements", "words"]
    plain = corpus.select(F.col(record_id).cast("string").alias("id"), category(F.col(split)).alias("split"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    kept = plain.where(F.col("split").isin("train", *EVALUATION) & F.col("id").isNotNull())
    return kept.mapInArrow(split_words, "id string, split string, source string, set_id long, text_id long, size int, filled int, elements binary, words string")


def split_overlaps(corpus: DataFrame, record_id: str = "id", text: str = "text", split: str = "split", source: str = "source", threshold: float = 0.8, min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (eval_set, train_set, similarity) between sets of distinct words of which at least the
    threshold of their union is common; members (id, split, source, set_id, text_id, words) of all rows that count.
    Copies are one set, however many, so links do not grow with them.

    Rows without id, without a split among train, validation and test (read without surrounding white space
    and case), with null text or fewer than min_words distinct words do not count. Sets and texts are named by 64
    bits. The threshold has to be above a third.
    """
    bands = Bands(threshold, BAND_FACTOR, CELLS)
    rows = materialize(_word_rows(corpus, record_id, text, split, source, min_words, bands), "words")
    side = F.when(F.col("split") == "train", 1).otherwise(2)
    first = [F.first(c).alias(c) for c in ("size", "filled", "elements")]
    sets = materialize(rows.groupBy("set_id").agg(F.bit_or(side).alias("side"), *first), "distinct")
    pairs = materialize(candidate_pairs(sets, bands), "candidates")
    alike = materialize(verified_links(pairs, sets, threshold), "verified")
    drop_table(pairs)
    sides = [sets.select(F.col("set_id").alias(x), F.col("side").alias(f"side_{x}")) for x in "ab"]
    known = alike.join(sides[0], "a").join(sides[1], "b")
    ways = [known.where(f"side_{e} & 2 = 2 and side_{t} & 1 = 1").select(F.col(e).alias("eval_set"), F.col(t).alias("train_set"), "similarity") for e, t in ("ab", "ba")]
    same = sets.where("side = 3").select(F.col("set_id").alias("eval_set"), F.col("set_id").alias("train_set"), F.lit(1.0).alias("similarity"))
    links = materialize(ways[0].unionByName(ways[1]).unionByName(same), "overlaps")
    return links, rows.select("id", "split", "source", "set_id", "text_id", "words")


def overlapping_rows(links: DataFrame, members: DataFrame, block: int = 2048) -> DataFrame:
    """(id_a, id_b) with id_a < id_b for each training and evaluation row whose sets are linked. The copies of a set
    are cut into blocks of about `block` rows, and each pair of blocks is joined apart."""
    train, evaluation = members.where("split = 'train'"), members.where("split <> 'train'")
    pairs = links.select("eval_set", "train_set")
    rows = {}
    for side, key, name in ((evaluation, "eval_set", "e"), (train, "train_set", "t")):
        counts = side.groupBy(F.col("set_id").alias(key)).agg(F.ceil(F.count(F.lit(1)) / block).alias(f"{name}_blocks"))
        pairs = pairs.join(counts, key).withColumn(f"{name}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{name}_blocks") - 1)))
        rows[name] = side.select(F.col("set_id").alias(key), F.col("id").alias(name)).join(counts, key).withColumn(f"{name}_block", F.pmod(F.xxhash64(name), f"{name}_blocks")).drop(f"{name}_blocks")
    met = pairs.join(rows["e"], ["eval_set", "e_block"]).join(rows["t"], ["train_set", "t_block"])
    return met.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"))


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(text_id, key) for each distinct run of `width` words of a text."""
    for whole in batches:
        for batch in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
            keys = [shingles(hashed(t.as_py().split(" ")), width) for t in batch.column(1)]
            owner = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), signed(np.concatenate([*keys, np.empty(0, np.uint64)]))], ["text_id", "key"])


def intervals(places: list[int], width: int) -> list[tuple[int, int]]:
    """The stretches that runs of `width` words from these places cover, merged."""
    out: list[tuple[int, int]] = []
    for at in sorted(places):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], at + width)
        else:
            out.append((at, at + width))
    return out


class Shard:
    """The automaton of the passages of some evaluation texts, and which of these have been met."""

    def __init__(self, texts: list[tuple[int, str]], width: int):
        import ahocorasick

        self.width, self.owners, numbers = width, [], {}
        self.automaton = ahocorasick.Automaton()
        for text_id, text in texts:
            tokens = text.split(" ")
            for i in range(len(tokens) - width + 1):
                passage = f" {' '.join(tokens[i : i + width])} "
                if passage not in numbers:
                    numbers[passage] = len(self.owners)
                    self.owners.append([])
                    self.automaton.add_word(passage, numbers[passage])
                self.owners[numbers[passage]].append((text_id, i))
        self.automaton.make_automaton()
        self.met = np.zeros(len(self.owners), bool)

    def scan(self, text: str) -> None:
        self.met[[n for _, n in self.automaton.iter(f" {text} ")]] = True

    def covered(self) -> list[tuple[int, int, int]]:
        places: dict[int, list[int]] = {}
        for n in np.flatnonzero(self.met):
            for text_id, i in self.owners[n]:
                places.setdefault(text_id, []).append(i)
        return [(text_id, a, b) for text_id, found in places.items() for a, b in intervals(found, self.width)]


def _scan(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """(text_id, start, end) of what the texts of a task cover; rows (shard, words) come by shard."""
    schema = pa.schema([("text_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    system, path = fs.FileSystem.from_uri(folder)
    number = shard = None

    def passed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*shard.covered(), strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != number:
                if shard and shard.met.any():
                    yield passed_on()
                table = ds.dataset(f"{path}/shard={own}", filesystem=system, format="parquet").to_table(["text_id", "words"])
                number, shard = own, Shard(list(zip(table["text_id"].to_pylist(), table["words"].to_pylist(), strict=True)), width)
            shard.scan(text)
    if shard and shard.met.any():
        yield passed_on()


def passage_coverage(members: DataFrame, width: int = 5, shard_texts: int = 4000, scanned_at_once: int = 50_000) -> DataFrame:
    """(text_id, covered): how many words of each evaluation text lie in runs of `width` successive words that some
    training text has too, of whatever length and order; texts without such a run are left out.

    A training text goes to the shards of which it holds a passage, as told by hashes of runs; passages that many
    texts share are spread. A task builds one automaton for a shard and its texts, which are about scanned_at_once
    at most. A text met by two tasks is merged by its positions.
    """
    spark = members.sparkSession
    texts = [members.where(c).select("text_id", "words").dropDuplicates(["text_id"]) for c in ("split <> 'train'", "split = 'train'")]
    evaluation, train = materialize(texts[0], "passages"), materialize(texts[1], "texts")
    shards = max(1, -(-evaluation.count() // shard_texts))
    folder = shared_path(spark, "shards")
    shard = F.pmod("text_id", F.lit(shards))
    evaluation.withColumn("shard", shard).repartition("shard").write.partitionBy("shard").parquet(folder)
    passages, runs = (t.mapInArrow(lambda b: _windows(b, width), "text_id long, key long") for t in (evaluation, train))
    runs = materialize(runs, "runs")
    of_key = passages.groupBy("key").agg(F.collect_set(shard).alias("shards"))
    wanted = of_key.join(runs.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    routed = lookup_join(runs, wanted, "key", "rows", "text_id").select("text_id", F.explode("shards").alias("shard")).distinct()
    routed = materialize(routed, "routed")
    parts = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / scanned_at_once).alias("parts"), F.count(F.lit(1)).alias("rows"))
    spread = lookup_join(routed, parts, "shard", "rows", "text_id").withColumn("salt", F.pmod(F.xxhash64("text_id"), "parts"))
    each = spread.join(train, "text_id").select("shard", "salt", "words").repartition("shard", "salt").sortWithinPartitions("shard")
    met = each.select("shard", "words").mapInArrow(lambda b: _scan(b, folder, width), "text_id long, start int, end int")
    covered = met.select("text_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct()
    return covered.groupBy("text_id").agg(F.count(F.lit(1)).alias("covered"))


def overlap_report(links: DataFrame, members: DataFrame, coverage: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, pairs, words, covered_words) per evaluation split and source: the records
    that count, those of which a training row is alike, all such pairs, and how many of the records' words some
    training text contains in runs. Counted from copies per set and text, without expanding pairs. Null sources are
    a group."""
    of_split = ["split", "source"]
    train = members.where("split = 'train'").groupBy(F.col("set_id").alias("train_set")).agg(F.count(F.lit(1)).alias("m"))
    partners = links.join(train, "train_set").groupBy(F.col("eval_set").alias("set_id")).agg(F.sum("m").alias("m"))
    evaluation = members.where("split <> 'train'").groupBy(*of_split, "set_id", "text_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.size(F.split("words", " "))).alias("w"))
    met = evaluation.join(partners, "set_id", "left").join(coverage, "text_id", "left")
    n = F.col("n")
    return met.groupBy(*of_split).agg(
        F.sum("n").alias("records"), F.sum(F.when(F.col("m").isNotNull(), n).otherwise(0)).alias("overlapping"), F.sum(n * F.coalesce("m", F.lit(0))).alias("pairs"),
        F.sum(n * F.col("w")).alias("words"), F.sum(n * F.coalesce("covered", F.lit(0))).alias("covered_words"),
    )
