"""Pairs of alike sets by parity sketches: a pigeonhole join that loses none, a bit bound, and verification.

The elements of a set, as 64-bit numbers, are spread by hash over the cells of a sketch, each cell holding the
XOR of its elements. An element that only one of two sets has changes one cell, so the number of cells in which
two sketches differ is no greater than the sets' symmetric difference d; a set with f > d filled cells agrees with
the other in f - d of them. It also lacks only e = n - f cells for its n elements; an element in common is in a
cell that differs only if one of the sets has another element there, so of c elements in common c - e - e' are in
cells that agree. Sketches of one band of sizes have equally many cells; a pair is joined in the band of its larger
set, in which the smaller one is a guest.

With the filled cells of all sets in one order, rare contents first, two sets that agree in at least o cells agree
in one of the first f - o + 1 of each, so only these are keys of the join, and the places of the cell in both
orders have to leave room for o. The few sets with too few filled cells to be sure are joined once more, with a
cell for each element. There is no cap on partners: the keys that very many sets hold are cut into pairs of
blocks, so that no task has one alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def set_hash(x: np.ndarray) -> np.ndarray:
    """One number (in an array) for a set of numbers, whatever their order."""
    return np.bitwise_xor.reduce(mixed(x * ODD[4]), keepdims=True) + mixed(x).sum(keepdims=True, dtype=np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All elements of the sets, and of each the number of its set."""
    lengths = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)), np.repeat(np.arange(len(sets)), lengths)


class Bands:
    """Bands of sizes, each `factor` (a power of two) times as wide as the one below, and the cells of their
    sketches: the power of two from `cells` times the number that makes agreement sure, at least `least`. So the
    cells of a band are parts of those of the band below."""

    def __init__(self, threshold: float, factor: int, cells: float, least: int = 8):
        self.threshold = Fraction(str(threshold))
        if self.threshold <= Fraction(1, 3):
            raise ValueError("sketches are sure only for thresholds above a third")
        self.lows = [factor**i for i in range(math.ceil(32 / math.log2(factor)) + 1)]
        most = [int(self.difference(low * factor - 1, low * factor - 1)) + 1 for low in self.lows]
        self.cells = [min(2**31, 2 ** math.ceil(math.log2(max(least, cells * m)))) for m in most]

    def difference(self, n, m):
        """The largest symmetric difference of alike sets of n and m elements."""
        p, q = self.threshold.numerator, self.threshold.denominator
        return (n + m) * (q - p) // (q + p)

    def own(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def guests(self, sizes: np.ndarray, band: int) -> np.ndarray:
        """Whether smaller sets can be alike to one of the band."""
        low = self.lows[band]
        return (sizes < low) & (sizes * self.threshold.denominator >= low * self.threshold.numerator)


def cell_contents(elements: np.ndarray, row: np.ndarray, band: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each filled cell, by row and cell; the key stands for band, cell and content. Without cells
    each element has one of its own."""
    spread = mixed(elements * ODD[2])
    if not cells:
        return row, mixed(spread + np.array([band + 1], np.uint64) * ODD[1])
    place = row.astype(np.uint64) << _32 | (spread >> _32) * np.uint64(cells) >> _32
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])[: len(place)]
    content = np.bitwise_xor.reduceat(spread[order], starts) if len(place) else spread
    place = place[starts]
    return (place >> _32).astype(np.int64), mixed(content + (place & _LOW) * ODD[3] + np.array([band + 1], np.uint64) * ODD[4])


def filled_cells(sets: list[np.ndarray], bands: Bands) -> np.ndarray:
    """The number of filled cells of each set in the sketch of its own band."""
    out = np.zeros(len(sets), np.int64)
    own = bands.own(np.array([max(1, len(s)) for s in sets], np.int64))
    for band in np.unique(own):
        at = np.flatnonzero(own == band)
        row, _ = cell_contents(*joined([sets[i] for i in at]), int(band), bands.cells[band])
        out[at] = np.bincount(row, minlength=len(at))
    return out


SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def bit_sketch(elements: np.ndarray) -> np.ndarray:
    """64 * SKETCH_WORDS bits, each the parity of the elements hashed to it: an element of only one of two sets
    flips one bit, so two sketches differ in at most as many bits as the sets in elements."""
    bits = np.bincount((mixed(elements * ODD[0]) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


BUCKETS = 1 << 21
BLOCK = 1024  # sets of one key that are compared in one place
_PART = 1 << 16


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(43)).astype(np.int64)


def _by_band(sizes: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, places of its own sets and guests, whether each is a guest)."""
    own = bands.own(sizes)
    for band in np.unique(np.r_[own, own + 1, own + 2]):
        if band >= len(bands.lows):
            continue
        guest = bands.guests(sizes, band)
        at = np.flatnonzero(guest | (own == band))
        if len(at):
            yield int(band), at, guest[at]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from (whole.slice(at, rows) for at in range(0, whole.num_rows, rows))


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def bucket_levels(sets: DataFrame, bands: Bands) -> tuple[np.ndarray, float]:
    """How frequent the keys of each of BUCKETS hash buckets are, as 4 * log2(1 + n) in a byte; and the sets that a
    bucket holds by chance, with four standard deviations.

    The keys of all sets are counted. The driver holds BUCKETS bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int32)
        for batch in _slices(batches):
            held = _sets(batch.column(0))
            sizes = np.array([len(s) for s in held], np.int64)
            for band, at, _ in _by_band(sizes, bands):
                _, keys = cell_contents(*joined([held[i] for i in at]), band, bands.cells[band])
                n += np.bincount(_bucket(keys), minlength=BUCKETS).astype(np.int32)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS // _PART), pa.int32()), pa.array([x.tobytes() for x in n.reshape(-1, _PART)], pa.binary())], ["part", "n"])

    def total(table: pa.Table) -> pa.Table:
        n = np.zeros(_PART, np.int64)
        for x in table.column("n"):
            n += np.frombuffer(x.as_py(), np.int32)
        level = np.minimum(255, 4 * np.log2(1 + n)).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "level": pa.array([level.tobytes()], pa.binary()), "keys": pa.array([int(n.sum())], pa.int64())})

    parts = sets.select("elements").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(total, "part int, level binary, keys long").collect()
    out, mean = np.zeros(BUCKETS, np.uint8), sum(p["keys"] for p in parts) / BUCKETS
    for part, level, _ in parts:
        out[part * _PART : (part + 1) * _PART] = np.frombuffer(level, np.uint8)
    return out, mean + 4 * math.sqrt(mean)


def prefix_lengths(sizes: np.ndarray, filled: np.ndarray, guest: np.ndarray, low: int, bands: Bands, slack: np.ndarray) -> np.ndarray:
    """How many of a set's cells, rarest first, are keys in the band from `low` on.

    slack holds for each binary order of size the largest share of elements that a set lacks in filled cells. The
    cells that agree at least are, over the size m of the partner, the higher of two lines and so fewest at
    either end of its range or where two lines meet."""
    t = float(bands.threshold)
    difference = (1 - t) / (1 + t)
    least, most = np.maximum(sizes * t, np.where(guest, low, 1)), np.maximum(sizes / t, low)
    s = np.zeros(len(sizes))
    for order in range(5):  # the largest partner is less than nine times the smallest
        kind = np.floor(np.log2(least)).astype(np.int64) + order
        s = np.maximum(s, np.where(2.0**kind <= most, slack[np.minimum(kind, len(slack) - 1)], 0))
    lacking = sizes - filled
    fewest = filled.astype(float)
    for m in (least, most, filled / np.maximum(1e-9, 1 - s), sizes * t / np.maximum(1e-9, 1 - s * (1 + t)), (sizes - lacking * (1 + t)) / t):
        m = np.clip(m, least, most)
        by_common = t / (1 + t) * (sizes + m) - lacking - s * m
        by_difference = np.maximum(filled, (1 - s) * m) - (sizes + m) * difference
        fewest = np.minimum(fewest, np.maximum(by_common, by_difference))
    return np.clip(np.floor(filled - fewest + 1e-6).astype(np.int64) + 1, 1, filled)


def _keys(batches: Iterator[pa.RecordBatch], levels: np.ndarray, by_chance: float, bands: Bands, slack: np.ndarray, own_cells: bool) -> Iterator[pa.RecordBatch]:
    """(key, set_id, sizes, places): rows for the join. Of a key that about BLOCK sets or more hold, each set belongs
    to one block, and there is a key for each pair of blocks; two sets meet in just one of them.

    sizes packs the set's elements and filled cells; places the filled cells from this one on, the side, whether
    the set is a guest of the band, and its block (0: the sets of one block with each other)."""
    for batch in _slices(batches):
        ids, held, side = batch.column(0).to_numpy(), _sets(batch.column(1)), batch.column(2).to_numpy()
        all_sizes = np.array([len(s) for s in held], np.int64)
        for band, at, guest in _by_band(all_sizes, bands):
            row, key = cell_contents(*joined([held[i] for i in at]), band, 0 if own_cells else bands.cells[band])
            sizes, filled = all_sizes[at], np.bincount(row, minlength=len(at))
            level = levels[_bucket(key)]
            # Equal numbers keep the order of the cells, which is the same in all sets.
            order = np.argsort(row.astype(np.uint64) << np.uint64(40) | level.astype(np.uint64) << _32 | key >> _32, kind="stable")
            row, key, level = row[order], key[order], level[order]
            place = np.arange(len(row)) - (np.cumsum(filled) - filled)[row]
            kept = np.flatnonzero(place < prefix_lengths(sizes, filled, guest, bands.lows[band], bands, slack)[row])
            row, key, level, place = row[kept], key[kept], level[kept], place[kept]
            blocks = np.maximum(1, np.ceil((2 ** (level / 4) - 1 - by_chance) / BLOCK)).astype(np.int64)
            again = np.repeat(np.arange(len(row)), blocks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            spread = mixed(ids[at].view(np.uint64)[row] * ODD[2])
            own = (spread % blocks.astype(np.uint64)).astype(np.int64)[again]
            first, second = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
            split = np.where(blocks[again] > 1, mixed(key[again] * ODD[0] + mixed(first * ODD[1] + second * ODD[4])), key[again])
            row = row[again]
            rest = filled[row] - place[again]
            places = rest << 32 | side[at][row].astype(np.int64) << 30 | guest[row].astype(np.int64) << 29 | np.where(own == other, 0, own + 1)
            yield pa.RecordBatch.from_arrays([signed(split), pa.array(ids[at][row]), pa.array(sizes[row] << 32 | filled[row]), pa.array(places)], ["key", "set_id", "sizes", "places"])


def _meeting(a: DataFrame, b: DataFrame, bands: Bands, ordered: bool) -> DataFrame:
    """(a, b) of the key rows that meet, can be alike by sizes and places, and belong together."""
    p, q = bands.threshold.numerator, bands.threshold.denominator
    sides = [df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("set_id", "sizes", "places")]) for df, x in ((a, "a"), (b, "b"))]

    def upper(c: str) -> Column:
        return F.shiftright(c, 32)

    def lower(c: str, bits: int) -> Column:
        return F.col(c).bitwiseAND(F.lit((1 << bits) - 1))

    def bit(c: str, n: int) -> Column:
        return F.col(c).bitwiseAND(F.lit(1 << n)) != 0

    n, m, f, g = upper("sizes_a"), upper("sizes_b"), lower("sizes_a", 32), lower("sizes_b", 32)
    room = F.least(upper("places_a"), upper("places_b"))
    block_a, block_b = lower("places_a", 29), lower("places_b", 29)
    fits = (F.least(n, m) * q >= F.greatest(n, m) * p) & ((F.greatest(f, g) - room) * (p + q) <= (n + m) * (q - p)) & ((room + n - f + m - g) * (p + q) >= (n + m) * p)
    across = (bit("places_a", 30) & bit("places_b", 31)) | (bit("places_a", 31) & bit("places_b", 30))
    together = ((block_a == 0) | (block_a != block_b)) & ~(bit("places_a", 29) & bit("places_b", 29))
    other = F.col("set_id_a") < F.col("set_id_b") if ordered else F.col("set_id_a") != F.col("set_id_b")
    met = sides[0].join(sides[1].hint("merge"), "key").where(other & across & together & fits)
    return met.select(F.least("set_id_a", "set_id_b").alias("a"), F.greatest("set_id_a", "set_id_b").alias("b"))


def candidate_pairs(sets: DataFrame, bands: Bands) -> DataFrame:
    """(a, b) with a < b, each once: set_ids among which are all alike sets of (set_id, size, filled, side, elements).

    elements are the bytes of distinct 64-bit numbers, filled is their `filled_cells`. Pairs are formed between
    sides 1 and 2 (side is 3 for sets that are on both). Sets without elements meet none.
    """
    sets = sets.where("size > 0")
    p, q = bands.threshold.numerator, bands.threshold.denominator
    sure = F.col("filled") > F.floor(2 * F.col("size").cast("long") * (q - p) / (q + p))
    kinds = sets.groupBy(F.floor(F.log2("size")).cast("int").alias("kind"), sure.alias("sure")).agg(F.max(1 - F.col("filled") / F.col("size")).alias("slack")).collect()
    slack, all_sure = np.zeros(33), all(k["sure"] for k in kinds)
    for k in kinds:
        if k["sure"]:
            slack[k["kind"]] = k["slack"]
    context = sets.sparkSession.sparkContext
    held = context.broadcast((*bucket_levels(sets, bands), slack))
    columns, schema = ["set_id", "elements", "side"], "key long, set_id long, sizes long, places long"
    keys = sets.select(columns).mapInArrow(lambda b: _keys(b, held.value[0], held.value[1], bands, held.value[2], False), schema)
    met = _meeting(keys, keys, bands, True)
    if not all_sure:
        none = (np.zeros(BUCKETS, np.uint8), np.zeros(33))
        own = sets.select(columns).mapInArrow(lambda b: _keys(b, none[0], 0.0, bands, none[1], True), schema)
        unsure = sets.where(~sure).select(columns).mapInArrow(lambda b: _keys(b, none[0], 0.0, bands, none[1], True), schema)
        met = met.unionByName(_meeting(unsure, own, bands, False))
    return met.distinct()


def within_bound(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sizes and bit sketches leave it possible that they are alike; no such pair is lost."""
    sides = [sets.select(F.col("set_id").alias(x), F.col("size").alias(f"n_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in SKETCH]) for x in "ab"]
    differing = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH)
    most = (F.col("n_a") + F.col("n_b")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6
    return pairs.join(sides[0], "a").join(sides[1], "b").where(differing <= most).select("a", "b")


def verified_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, similarity) whose sets have at least the threshold of their union in common."""
    exact = Fraction(str(threshold))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similarity = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)):
                if min(len(x), len(y)) * exact.denominator < max(len(x), len(y)) * exact.numerator:
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                union = len(x) + len(y) - common
                if common * exact.denominator >= union * exact.numerator:
                    similarity[i] = common / union
            kept = pa.array(np.flatnonzero(similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(similarity[similarity > 0])], ["a", "b", "similarity"])

    one = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("elements").alias("x")), "a")
    both = one.join(sets.select(F.col("set_id").alias("b"), F.col("elements").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, similarity double")
