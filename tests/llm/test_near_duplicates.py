import random
from itertools import combinations

import numpy as np
import pytest

from textquarry.functions.words import words
from textquarry.llm.near_duplicates import BAND_FACTOR, CELLS, near_duplicates, pairs_within_classes
from textquarry.llm.parity_join import Bands, bit_sketch, candidate_pairs, filled_cells, set_hash, verified_links
from textquarry.operators.components import connected_components


def family(rng, n, length, vocabulary=3000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    out = [base]
    for _ in range(n - 1):
        own = list(base)
        for _ in range(rng.randrange(1, max(2, length // 9))):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            cut = rng.randrange(1, len(own))
            own = own[cut:] + own[:cut]
        out.append(own)
    return [" ".join(x) for x in out]


def brute(rows, width, threshold, least):
    sets = {}
    for i, title, text in rows:
        if text is not None and len(words(text)) >= least:
            w = words(f"{title or ''}\n{text}")
            k = min(width, len(w))
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            group[y] = x
    return {(a, b) for a, b in combinations(sorted(sets), 2) if root(a) == root(b)}


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.5), (5, 0.8)])
def test_groups_against_all_pairs(spark, width, threshold):
    rng = random.Random(5)
    texts = [t for length in (21, 30, 60, 130, 250, 300, 700) for n in (2, 3, 9) for t in family(rng, n, length)]
    texts += [" ".join(f"s{rng.randrange(10**6)}" for _ in range(40)) for _ in range(40)] + ["слово " * 30, "слово " * 31, None, "", "a b"]
    texts += [texts[0]] * 3 + [texts[0].upper().replace(" ", ", ")]
    rows = [(i, None if i % 3 else f"t{i % 2}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "row_id long, title string, text string, key string, set_id int")
    classes, links = near_duplicates(df, width=width, threshold=threshold, min_words=20)
    got = [tuple(r) for r in pairs_within_classes(classes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, width, threshold, 20)
    assert {r["class_id"] for r in classes.collect()} <= {r["record_id"] for r in classes.collect()}


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (100, rng.integers(0, 60), rng.integers(0, 60)))
        x, y = np.unique(np.r_[common, a]), np.unique(np.r_[common, b])
        differing = int(np.bitwise_count((bit_sketch(x) ^ bit_sketch(y)).view(np.uint64)).sum())
        assert differing <= len(np.setxor1d(x, y))


@pytest.mark.parametrize(("threshold", "factor", "cells", "unsure"), [(0.5, 1024, 1024, False), (0.8, 2, 1.5, False), (0.8, 2, 1.0, True), (0.5, 2, 1.3, True)])
def test_no_pair_is_lost(spark, threshold, factor, cells, unsure):
    rng = np.random.default_rng(4)
    bands = Bands(threshold, factor, cells, 1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 3, 5)]
    for n in (1, 2, 3, 5, 8, 12, 15, 17, 30, 60, 120, 300):
        for _ in range(12):
            common = rng.integers(0, 2**63, n)
            most = int(n / threshold) - n
            extra = [int(rng.integers(0, most + 2)) for _ in range(2)]
            sets += [np.unique(np.r_[common, rng.integers(0, 2**63, k)]).astype(np.uint64) for k in (extra[0], max(0, most - extra[0]))]
    sets = list({s.tobytes(): s for s in sets}.values())
    filled = filled_cells(sets, bands)
    assert unsure == any(f <= bands.difference(len(s), len(s)) for f, s in zip(filled, sets, strict=True) if len(s) > 1)
    side = [1 + i % 3 for i in range(len(sets))]
    df = spark.createDataFrame([(i, len(s), int(f), side[i], s.tobytes()) for i, (s, f) in enumerate(zip(sets, filled, strict=True))], "set_id long, size int, filled int, side int, elements binary")
    got = [tuple(r) for r in candidate_pairs(df, bands).collect()]
    held = [frozenset(s.tolist()) for s in sets]
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(held[i] & held[j]) >= threshold * len(held[i] | held[j]) and (side[i] & 1 and side[j] & 2 or side[i] & 2 and side[j] & 1)}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 20
    assert {(r["a"], r["b"]) for r in verified_links(spark.createDataFrame(got, "a long, b long"), df, threshold).collect()} == want


def test_thresholds_that_are_not_sure():
    with pytest.raises(ValueError):
        Bands(0.3, 2, 2.0)


@pytest.mark.parametrize("more", [2, 10])
def test_boilerplate_shared_by_all(spark, more):
    """3000 sets with 250 shingles in common, just below the threshold, and 300 alike pairs that share `more` others."""
    rng = np.random.default_rng(more)
    bands, shared = Bands(0.5, BAND_FACTOR, CELLS), rng.integers(0, 2**63, 250)
    sets = [np.r_[shared, rng.integers(0, 2**63, 127)] for _ in range(2400)]
    for _ in range(300):
        both = rng.integers(0, 2**63, more)
        sets += [np.r_[shared, both, rng.integers(0, 2**63, 125)] for _ in range(2)]
    sets = [np.unique(s).astype(np.uint64) for s in sets]
    filled = filled_cells(sets, bands)
    rows = [(int(set_hash(s).view(np.int64)[0]), len(s), int(f), 3, s.tobytes()) for s, f in zip(sets, filled, strict=True)]
    want = {tuple(sorted((rows[i][0], rows[i + 1][0]))) for i in range(2400, 3000, 2)}
    found = []
    for seed in (1, 2):
        order = np.random.default_rng(seed).permutation(len(rows))
        df = spark.createDataFrame([rows[i] for i in order], "set_id long, size int, filled int, side int, elements binary").repartition(4)
        found.append({(r["a"], r["b"]) for r in verified_links(candidate_pairs(df, bands), df, 0.5).collect()})
    assert found[0] == found[1] and found[0] == want


def test_hot_copies_and_empty_table(spark):
    rng = random.Random(2)
    hot = family(rng, 40, 50)
    rows = [(i, "t", hot[i % 40]) for i in range(900)] + [(1000 + i, None, family(rng, 1, 50)[0]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, title string, text string")
    classes, _ = near_duplicates(df, width=3, threshold=0.5, min_words=20)
    sizes = {r["record_id"]: r["class_rows"] for r in classes.collect()}
    assert len(sizes) == 930 and sum(n == 900 for n in sizes.values()) == 900
    empty, links = near_duplicates(df.where("false"))
    assert empty.count() == links.count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 100), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_degrees(texts, width, threshold):
    """Of each text, the number of other distinct shingle sets that are alike to its own."""
    sets = []
    for text in texts:
        w = words(text)
        sets.append(frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)))
    distinct = list(dict.fromkeys(sets))
    degree = dict.fromkeys(distinct, 0)
    for x, y in combinations(distinct, 2):
        if len(x & y) >= threshold * len(x | y):
            degree[x] += 1
            degree[y] += 1
    return [degree[s] for s in sets], sum(degree.values()) // 2


def template_rows(rng, n, template=60):
    """A third of the rows share a template: some have little text of their own and are alike, most have more."""
    shared = [f"t{i}" for i in range(template)]
    rows = [shared + [f"o{rng.randrange(10**7)}" for _ in range(rng.randrange(20, 28) if i % 3 else rng.randrange(60, 90))] for i in range(n // 3)]
    return [" ".join(x) for x in rows] + [" ".join(f"r{rng.randrange(10**7)}" for _ in range(rng.randrange(60, 120))) for _ in range(n - n // 3)]


def check_links(spark, texts, width, threshold):
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "row_id long, title string, text string")
    classes, links = near_duplicates(df, width=width, threshold=threshold, min_words=20)
    degrees, pairs = brute_degrees(texts, width, threshold)
    assert {r["record_id"]: r["links"] for r in classes.collect()} == dict(enumerate(degrees))
    assert links.count() == pairs > 100


@pytest.mark.parametrize("block", [1024, 8])
def test_template_of_a_third_of_all_rows(spark, monkeypatch, block):
    from textquarry.llm import parity_join as module

    monkeypatch.setattr(module, "BLOCK", block, raising=False)
    check_links(spark, template_rows(random.Random(7), 240), 3, 0.5)


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.5), (5, 0.8)])
def test_links_of_large_families(spark, width, threshold):
    rng = random.Random(8)
    texts = family(rng, 40, 250) + family(rng, 60, 70)
    check_links(spark, texts + texts[:5], width, threshold)


def check_levels(monkeypatch, run):
    """run joins sets by way of candidate_pairs: the keys of all sets are counted, however many elements there are."""
    from textquarry.llm import parity_join as module

    original, seen = module.bucket_levels, []

    def watched(sets, bands, *more):
        out = original(sets, bands, *more)
        seen.append(([np.frombuffer(r["elements"], np.uint64) for r in sets.select("elements").collect()], bands, out))
        return out

    monkeypatch.setattr(module, "COUNTED", 500, raising=False)
    monkeypatch.setattr(module, "bucket_levels", watched)
    run()
    for sets, bands, (levels, by_chance) in seen:
        n, sizes = np.zeros(module.BUCKETS, np.int64), np.array([len(s) for s in sets])
        for band, at, _ in module._by_band(sizes, bands):
            _, keys = module.cell_contents(*module.joined([sets[i] for i in at]), band, bands.cells[band])
            n += np.bincount(module._bucket(keys), minlength=module.BUCKETS)
        assert sizes.sum() > 2000 and (levels == (4 * np.log2(1 + n)).astype(np.uint8)).all()
        mean = n.sum() / module.BUCKETS
        assert by_chance == pytest.approx(mean + 4 * mean**0.5)
    assert seen


def test_all_shingles_are_counted(spark, monkeypatch):
    texts = template_rows(random.Random(9), 90)
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "row_id long, title string, text string")
    check_levels(monkeypatch, lambda: near_duplicates(df, width=3, threshold=0.5, min_words=20))
