import random

import numpy as np

from textquarry.functions.words import words
from textquarry.llm.leakage import BlockIndex, hashed, leaked_items, shingle_similarity, simhashes


def test_bit_planes_count_as_sums():
    h = hashed([f"w{i % 37}" for i in range(400)])
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(len(h), 64)
    for width in (1, 3, 8, 13):
        want = np.array([bits[i : i + width].sum(0) > width // 2 for i in range(len(h) - width + 1)])
        got = np.unpackbits(simhashes(h, width).view(np.uint8), bitorder="little").reshape(-1, 64)
        assert (got == want).all()
    assert len(simhashes(h[:5], 8)) == 0


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5)).astype(np.uint64)) if rng.random() > 0.1 else np.uint64(0) for _ in range(2000)], np.uint64)
    prints = items[rng.integers(0, 300, 2000)] ^ flips
    got = set(zip(*(x.tolist() for x in BlockIndex(items, 3).matches(prints)), strict=True))
    near = np.bitwise_count(prints[:, None] ^ items[None, :]) <= 3
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_shared_runs_against_plain_search(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = [(f"q{i}", text(rng.choice([3, 8, 20, 40]))) for i in range(40)] + [("null", None), ("blank", " "), ("again", None)]
    items[-1] = ("again", items[5][1])
    docs = []
    for i in range(300):
        own = text(rng.randrange(0, 120)).split()
        if i % 2:
            w = words(rng.choice(items[:40])[1])
            a = rng.randrange(0, len(w))
            own[len(own) // 2 : len(own) // 2] = w[a : a + rng.choice([5, 7, 8, 9, 30])]
        docs.append((i, " ".join(own).upper() if i % 5 == 0 else ", ".join(own)))
    docs += [(300, None), (301, ""), (302, items[7][1] * 1), (302, items[7][1])]

    def run(a, b):
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, k)
        return best

    want = {(q, d): r for q, t in items for d, x in docs if (r := run(words(t), words(x))) >= 8}
    ddf = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, query_id string")
    qdf = spark.createDataFrame(items, "query_id string, text string")
    for block in (7, 1000):
        got = {(r["query_id"], r["doc_id"]): r["shared_run"] for r in leaked_items(ddf, qdf, items_at_once=block).where("shared_run >= 8").collect()}
        assert len(want) > 30 and got == want
    assert leaked_items(ddf, qdf.where("false")).count() == leaked_items(ddf.where("false"), qdf).count() == 0


def test_similarity_weighs_letters():
    assert shingle_similarity(["a", "b"], ["a", "b"]) == 1 and shingle_similarity(["a", "b"], ["b", "a"]) == 0
    assert shingle_similarity("aa bb cc".split(), "aa bb d".split()) == 4 / (4 + 4 + 3)
