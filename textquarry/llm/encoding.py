"""Problem 8: token ids of a whole corpus by a public byte-level BPE tokenizer.

A text is cut by the tokenizer's own pattern; the ids of each distinct piece are kept in a bounded table of
the worker, as most pieces repeat. What the pattern leaves unsplit over a long stretch is encoded by tree
concatenation: halves apart, then growing windows around each join are encoded again until both sides agree.
Texts beyond long_chars are cut into segments that other tasks encode in parallel.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.words import run_of

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_PIECE = 1024
HELD_PIECES = 100_000
# Fixed values of the public tokenizer: its pattern, and Unicode white space as the pattern reads it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=1)
def piece_pattern() -> re.Pattern:
    """PATTERN in the terms of the standard library's matcher, which is several times as fast."""
    rest = rf"(?:[^\w{WHITE}]|_)+"
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?{run_of('L')}| ?{run_of('N')}| ?{rest}|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@lru_cache(maxsize=1)
def _white() -> re.Pattern:
    return re.compile(f"[{WHITE}]")


def tree_encode(data: bytes, encode: Callable[[bytes], list[int]], token: Callable[[int], bytes], leaf: int = 512) -> list[int]:
    """Ids of one unsplit piece, from its halves."""
    if len(data) <= leaf:
        return encode(data)
    middle = len(data) // 2
    return join_ids(tree_encode(data[:middle], encode, token, leaf), tree_encode(data[middle:], encode, token, leaf), encode, token)


def join_ids(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], token: Callable[[int], bytes]) -> list[int]:
    """Ids of two adjoining parts of a piece.

    A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of
    theirs. Within both sides that holds already, so the window around the join grows until it also holds
    where the window meets what is left of either side.
    """
    def agree(a: int, b: int) -> bool:
        return encode(token(a) + token(b)) == [a, b]

    reach = 1
    while True:
        before, after = left[:-reach], right[reach:]
        window = encode(b"".join(map(token, left[-reach:] + right[:reach])))
        if (not before or agree(before[-1], window[0])) and (not after or agree(window[-1], after[0])):
            return before + window + after
        reach *= 2


class PieceIds(dict):
    """Packed ids of pieces; emptied when full, so its size is bounded whatever the corpus."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.encode, self.token = self.coder._core_bpe.encode_single_piece, self.coder._core_bpe.decode_single_token_bytes

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(piece) > LONG_PIECE:
            return np.array(tree_encode(data, self.encode, self.token), np.int32).tobytes()
        if len(self) >= HELD_PIECES:
            self.clear()
        packed = self[piece] = np.array(self.encode(data), np.int32).tobytes()
        return packed

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, piece_pattern().findall(text))) if text else b""


_held: dict[int, PieceIds] = {}


def piece_ids(ranks: bytes) -> PieceIds:
    key = hash(ranks)
    if key not in _held:
        _held.clear()
        _held[key] = PieceIds(ranks)
    return _held[key]


def segments(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(piece, part) of a long text in order: piece is 0 for whole text to be cut by the pattern, else the
    number of an unsplit piece of which the part is one stretch.

    The pattern looks ahead only past white space, so whole text that ends with another character is cut alone as it
    is in place; white space before a long piece comes out in the pieces found in place."""
    start, number, solid, white = 0, 0, 0, []  # solid: where the last piece ends that is no white space; white: those since
    for m in piece_pattern().finditer(text):
        if m.end() - m.start() > size:
            if start < solid:
                yield 0, text[start:solid]
            for piece in [*white, m]:
                number += 1
                for at in range(piece.start(), piece.end(), size):
                    yield number, text[at : min(at + size, piece.end())]
            start, solid, white = m.end(), m.end(), []
        elif _white().match(text, m.end() - 1):
            white.append(m)
        else:
            solid, white = m.end(), []
            if solid - start >= size:
                yield 0, text[start:solid]
                start = solid
    if start < len(text):
        yield 0, text[start:]


def _list_array(packed: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_file: str = DEFAULT_RANKS, long_chars: int = 20_000, segment_chars: int = 8_000) -> DataFrame:
    """(doc_id, ids): the token ids of each row's text, without special tokens.

    Null and empty texts have an empty list. Every row comes out, repeated ones too; rows with equal or null
    doc_id stay apart unless their texts are beyond long_chars, where equal ids are kept apart by a row
    number. The vocabulary file (fixed, under 2 MB) is read by the driver and broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())
    kind = dict(df.dtypes)[doc_id]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_ids(ranks.value)
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                ids = _list_array([coder.ids(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(2)):
                parts = list(segments(t.as_py(), segment_chars))
                n = len(parts)
                columns = [batch.column(0).take(pa.array([i] * n)), batch.column(1).take(pa.array([i] * n)), pa.array(range(n), pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([p for p, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.string())],
                    ["row", "doc_id", "position", "piece", "part"],
                )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_ids(ranks.value)
        for batch in batches:
            packed = [
                np.array(tree_encode(x.as_py().encode(), coder.encode, coder.token), np.int32).tobytes() if p.as_py() else coder.ids(x.as_py())
                for p, x in zip(batch.column(3), batch.column(4), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _list_array(packed)], ["row", "doc_id", "position", "piece", "ids"])

    def concatenated(group: pd.DataFrame) -> pd.DataFrame:
        coder = piece_ids(ranks.value)
        out = []
        group = group.sort_values("position")
        stretch = (group["piece"].ne(group["piece"].shift()) | group["piece"].eq(0)).cumsum()
        for _, parts in group["ids"].groupby(stretch):
            level = [list(map(int, x)) for x in parts]
            while len(level) > 1:
                pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
                level = [join_ids(*p, coder.encode, coder.token) if len(p) == 2 else p[0] for p in pairs]
            out.append(np.array(level[0], np.int32))
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "ids": [np.concatenate(out)]})

    short = rows.where(~is_long).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    long = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    key = f"row long, doc_id {kind}, position int, piece int"
    pieces = long.mapInArrow(cut, f"{key}, part string").repartition("row", "position").mapInArrow(encoded, f"{key}, ids array<int>")
    return short.unionByName(pieces.groupBy("row").applyInPandas(concatenated, f"doc_id {kind}, ids array<int>"))


def token_counts(df: DataFrame, text: str = "text", ranks_file: str = DEFAULT_RANKS, into: str = "tokens") -> DataFrame:
    """df with the number of tokens of its text in a new column; 0 for null and empty texts."""
    ranks = df.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())

    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = piece_ids(ranks.value)
        for series in texts:
            yield series.map(lambda t: len(coder.ids(t)) // 4 if t else 0).astype("int64")

    counted.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(counted, "long")(F.col(text).cast("string")))
