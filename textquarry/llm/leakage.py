"""Problem 6: evaluation texts that stand, wholly or partly, in a large collection.

Every run of `width` successive words of an item is a window of that item's size class, and so is every such
run of a document. Windows are fingerprinted by SimHash over their words, computed bit-sliced for all windows
of a batch at once. An index of the items' fingerprints by radius + 1 blocks of bits finds every window within
the Hamming radius: two fingerprints that differ in at most `radius` bits agree in one block. The weighted
shingles of each candidate then decide, and the longest exactly shared run is measured.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.words import words

HELD_WORDS = 200_000


class WordHashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_hashes = WordHashes()


def hashed(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def simhashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of `width` words: a bit is set where more than half of the words set it.

    The 64 counters of a window are kept as bit planes, so adding a word is a few operations on whole arrays.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    planes = [np.zeros(n, np.uint64) for _ in range(width.bit_length())]
    for shift in range(width):
        carry = hashes[shift : shift + n]
        for i, plane in enumerate(planes):
            planes[i], carry = plane ^ carry, plane & carry
    over, equal = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
    for i in reversed(range(len(planes))):  # compare each counter with width // 2, highest bit first
        if width // 2 >> i & 1:
            equal &= planes[i]
        else:
            over |= equal & planes[i]
            equal &= ~planes[i]
    return over


class BlockIndex:
    """Fingerprints of item windows by blocks of bits; finds all within the radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.radius, self.prints, self.tables = radius, prints, []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            shift, mask = np.uint64(low), np.uint64((1 << int(high - low)) - 1)
            keys = prints >> shift & mask
            order = np.argsort(keys, kind="stable")
            values, starts = np.unique(keys[order], return_index=True)
            present = np.zeros(1 << 16, bool)  # a first look by the block's low bits
            present[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.tables.append((shift, mask, values, np.append(starts, len(keys)), order, present))

    def matches(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of every pair within the radius, each once."""
        found = []
        for shift, mask, values, starts, order, present in self.tables:
            keys = prints >> shift & mask
            near = np.flatnonzero(present[(keys & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(values, keys[near])
            hit = at < len(values)
            hit[hit] = values[at[hit]] == keys[near][hit]
            near, at = near[hit], at[hit]
            sizes = starts[at + 1] - starts[at]
            window = np.repeat(near, sizes)
            offset = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            item = order[np.repeat(starts[at], sizes) + offset]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(np.stack([window[close], item[close]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def shingle_similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard of the multisets of two successive words; a shingle weighs its letters."""
    def weights(ws):
        out = defaultdict(int)
        for pair in zip(ws, ws[1:], strict=False):
            out[pair] += len(pair[0]) + len(pair[1])
        return out

    x, y = weights(a), weights(b)
    total = sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys())
    return sum(min(x[k], y[k]) for k in x.keys() & y.keys()) / total if total else float(a == b)


def _item_windows(items: list[tuple[str, str]], width: int) -> tuple[list[tuple[str, list[str], int]], np.ndarray]:
    windows, prints = [], []
    for item, text in items:
        tokens = words(text)
        p = simhashes(hashed(tokens), width)
        windows += [(item, tokens, i) for i in range(len(p))]
        prints.append(p)
    return windows, np.concatenate(prints) if prints else np.empty(0, np.uint64)


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "query_id", item_text: str = "text",
    width: int = 8, radius: int = 3, min_similarity: float = 0.8, items_at_once: int = 20_000,
) -> DataFrame:
    """(query_id, doc_id, windows, similarity, shared_run): items and documents with a window alike.

    windows counts the document's windows alike to one of the item, similarity is the highest, shared_run the
    longest run of exactly equal successive words (0 if below width). Exactly equal windows are all found; of alike
    but unequal ones only those within the radius, which are few, so windows, similarity and rows with shared_run
    0 are incomplete for them. Items shorter than width have no window;
    null texts have no words; repeated items and documents each count. The items are a stated query set: they
    are taken in blocks of items_at_once, which bounds what the driver reads and broadcasts, and each block
    meets all documents in one narrow pass without a shuffle.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[doc_id]
    schema = f"query_id string, doc_id {kind}, windows long, similarity double, shared_run int"
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    block: list[tuple[str, str]] = []
    found = []

    def against(block: list[tuple[str, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows, prints = _item_windows(held.value, width)
            index = BlockIndex(prints, radius)
            for whole in batches:
                for batch in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                    yield _scan_batch(batch, windows, index, width, min_similarity)

        return rows.mapInArrow(scan, schema)

    for row in items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull()).toLocalIterator():
        block.append(tuple(row))
        if len(block) == items_at_once:
            found.append(against(block))
            block = []
    if block or not found:
        found.append(against(block))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _scan_batch(batch: pa.RecordBatch, windows: list, index: BlockIndex, width: int, min_similarity: float) -> pa.RecordBatch:
    texts = [words(t.as_py()) for t in batch.column(1)]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    tokens = [w for t in texts for w in t]
    prints = simhashes(hashed(tokens), width)
    owner = np.searchsorted(ends, np.arange(len(prints)), side="right")
    inside = np.arange(len(prints)) + width <= ends[owner] if len(prints) else np.empty(0, bool)
    places = np.flatnonzero(inside)
    alike: dict[tuple[int, str], list] = {}
    if len(windows) and len(places):
        at, item = index.matches(prints[places])
        for place, k in zip(places[at].tolist(), item.tolist(), strict=True):
            name, words_, i = windows[k]
            a, b = tokens[place : place + width], words_[i : i + width]
            similarity = 1.0 if a == b else shingle_similarity(a, b)
            if similarity >= min_similarity:
                seen = alike.setdefault((int(owner[place]), name), [set(), 0.0, set()])
                seen[0].add(place)
                seen[1] = max(seen[1], similarity)
                if a == b:
                    seen[2].add((place - i, place))
    keys = list(alike)
    runs = [_longest(alike[k][2], width) for k in keys]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name for _, name in keys], pa.string()), batch.column(0).take(pa.array([d for d, _ in keys], pa.int64())),
            pa.array([len(alike[k][0]) for k in keys], pa.int64()), pa.array([alike[k][1] for k in keys], pa.float64()), pa.array(runs, pa.int32()),
        ],
        ["query_id", "doc_id", "windows", "similarity", "shared_run"],
    )


def _longest(exact: set[tuple[int, int]], width: int) -> int:
    """Words of the longest run of equal windows along one diagonal."""
    best = run = 0
    last = None
    for diagonal, place in sorted(exact):
        run = run + 1 if last == (diagonal, place - 1) else width
        last, best = (diagonal, place), max(best, run)
    return best
