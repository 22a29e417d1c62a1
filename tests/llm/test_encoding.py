import random
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.encoding import DEFAULT_RANKS, PieceIds, encode_corpus, join_ids, segments, token_counts, tree_encode

CODER = PieceIds(open(DEFAULT_RANKS, "rb").read())


def plain(text):
    return CODER.coder.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("аб ёЁabz'stre019²Ⅻ_!-\n\t  🙂中é\x1f")), st.integers(1, 9))
def test_pieces_and_segments_encode_as_the_tokenizer(text, size):
    assert np.frombuffer(CODER.ids(text), np.int32).tolist() == plain(text)
    parts = list(segments(text, size))
    assert "".join(p for _, p in parts) == text
    got = []
    for n, own in groupby(parts, key=lambda p: p[0]):
        stretches = [p for _, p in own]
        got += CODER.encode("".join(stretches).encode()) if n else [i for p in stretches for i in plain(p)]
    assert got == plain(text)


def test_tree_concatenation_is_exact():
    rng = random.Random(3)
    for alphabet in ("ab", "абвгд", "0123456789", "中文字", "aаб1"):
        data = "".join(rng.choice(alphabet) for _ in range(4000)).encode()
        assert tree_encode(data, CODER.encode, CODER.token, leaf=16) == CODER.encode(data)
    left, right = CODER.encode(b"hel"), CODER.encode(b"lo")
    assert join_ids(left, right, CODER.encode, CODER.token) == CODER.encode(b"hello")


def test_corpus(spark):
    rng = random.Random(1)
    unsplit = "".join(rng.choice("абвxyz") for _ in range(9000))
    texts = [None, "", " ", "Привет, мир! don't", "слово " * 3000, unsplit, f"a b {unsplit} конец  \n c", "<|endoftext|>", "Привет, мир! don't"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode_corpus(df, long_chars=2000, segment_chars=700).collect()}
    assert got == {i: plain(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df).collect()} == {i: len(plain(t)) if t else 0 for i, t in enumerate(texts)}


def test_white_space_around_long_pieces(spark):
    """Every kind of white space before and after unsplit pieces of texts that are cut into segments."""
    rng = random.Random(7)
    white = ["\n", "\n\n", "\t", " ", "  ", " \n", "\n \n", "\r\n", "\u2003", "\u00a0 ", "\x1f", "\x1f\x1f ", "\x85", "\n" * 150, " " * 151]
    texts = ["a\n\n" + "x" * 30000, "w " * 15000 + "\n\n" + "x" * 9000 + " e"]
    for w in white:
        for v in white:
            blob = rng.choice("xыz") * rng.randrange(90, 400)
            texts += [f"ab{w}{blob}{v}cd", f"{w}{blob}{v}", "слово " * 40 + w + blob + v + blob + w + "конец " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cut, size in ((100, 60), (20_000, 8_000)):
        got = {r["doc_id"]: list(r["ids"]) for r in encode_corpus(df, long_chars=cut, segment_chars=size).collect()}
        assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_equal_ids_and_empty_table(spark):
    rows = [(1, "слово " * 500), (1, "другое " * 500), (None, "x " * 900), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), list(r["ids"])) for r in encode_corpus(df, long_chars=1000, segment_chars=300).collect())
    assert got == sorted((repr(i), plain(t) if t else []) for i, t in rows)
    assert encode_corpus(df.where("false")).count() == 0


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        encode_corpus(spark.createDataFrame([], "doc_id long, text string"), ranks_file="/nowhere")
