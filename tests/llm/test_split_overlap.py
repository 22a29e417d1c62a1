import random

import numpy as np

from textquarry.functions.words import words
from textquarry.llm.split_overlap import intervals, overlap_report, overlapping_rows, passage_coverage, split_overlaps


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        n = rng.choice([6, 8, 9, 12, 25, 60])
        own = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(n)]
        if rows and rng.random() < 0.6:
            own = [x for x in rng.choice(rows)[1].split() if rng.random() > 0.08] + [f"n{rng.randrange(10**5)}" for _ in range(rng.randrange(3))]
            rng.shuffle(own)
        rows.append((f"r{i}", " ".join(own), rng.choice(["train", "Train ", "TEST", "validation", "\ttest", None, "other"]), rng.choice(["a", "b", None])))
    rows += [("x1", rows[0][1], "train", "a"), ("x2", rows[0][1].upper(), "test", "a"), ("n", None, "test", "a"), ("e", "", "train", "a"), (None, rows[0][1], "test", "a")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "id string, text string, split string, source string, set_id int, words string")
    usable = [(i, set(words(t)), s.strip().lower(), src) for i, t, s, src in rows if i and t and s and s.strip().lower() in ("train", "test", "validation") and len(set(words(t))) >= 8]
    want = {tuple(sorted((a, b))) for a, x, s, _ in usable if s == "train" for b, y, t, _ in usable if t != "train" and 5 * len(x & y) >= 4 * len(x | y)}
    links, members = split_overlaps(df)
    for block in (2, 2048):
        got = [tuple(r) for r in overlapping_rows(links, members, block).collect()]
        assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    report = overlap_report(links, members, passage_coverage(members)).collect()
    assert sum(r["pairs"] for r in report) == len(want)
    assert sum(r["records"] for r in report) == sum(s != "train" for _, _, s, _ in usable)
    assert sum(r["overlapping"] for r in report) == len({i for pair in want for i in pair} - {i for i, _, s, _ in usable if s == "train"})


def test_coverage_over_all_training_texts(spark):
    """An evaluation record whole in a longer text, another in pieces of two, two with the same words in other order."""
    rng = random.Random(6)
    tokens = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    whole, pieces, turned = tokens[:20], tokens[20:50], tokens[60:75]
    rows = [("e1", whole, "test"), ("e2", pieces, "test"), ("e3", turned, "validation"), ("e4", turned[::-1], "test"), ("e5", tokens[80:95], "test"), ("e6", whole, "test")]
    rows += [("t1", tokens[100:160] + whole + tokens[200:300], "train"), ("t2", ["x"] * 9 + pieces[:8] + tokens[300:310], "train"), ("t3", tokens[310:330] + pieces[6:14] + pieces[20:24], "train"), ("t4", turned, "train")]
    rows += [(f"o{i}", [f"v{chr(97 + rng.randrange(26))}" for _ in range(30)], rng.choice(["train", "test"])) for i in range(120)]
    df = spark.createDataFrame([(i, " ".join(w), s, "s") for i, w, s in rows], "id string, text string, split string, source string")
    train = [w for _, w, s in rows if s == "train"]
    known = {tuple(w[i : i + 5]) for w in train for i in range(len(w) - 4)}
    want = {}
    for i, w, s in rows:
        if s != "train" and len(set(w)) >= 8:
            want[i] = len({i + k for i in range(len(w) - 4) if tuple(w[i : i + 5]) in known for k in range(5)})
    assert (want["e1"], want["e2"], want["e3"], want["e4"], want["e5"]) == (20, 14, 15, 0, 0)
    _, members = split_overlaps(df)
    for shard_texts, at_once in ((4000, 50_000), (7, 10)):
        covered = {r["text_id"]: r["covered"] for r in passage_coverage(members, 5, shard_texts, at_once).collect()}
        got = {r["id"]: covered.get(r["text_id"], 0) for r in members.where("split <> 'train'").collect()}
        assert got == want


def test_intervals_merge():
    assert intervals([0, 2, 9, 4], 3) == [(0, 7), (9, 12)] and intervals([], 3) == []


def test_one_sided_and_empty(spark):
    schema = "id string, text string, split string, source string"
    text = "один два три четыре пять шесть семь восемь"
    for rows in ([], [("a", text, "train", "s")], [("a", text, "test", "s")]):
        links, members = split_overlaps(spark.createDataFrame(rows, schema))
        assert overlapping_rows(links, members).count() == 0
        report = overlap_report(links, members, passage_coverage(members)).collect()
        assert [(r["records"], r["overlapping"], r["pairs"], r["covered_words"]) for r in report] == [(1, 0, 0, 0)] * sum(r[2] == "test" for r in rows)


def test_all_words_are_counted(spark, monkeypatch):
    """With a bound of 500 elements a count of a sample would differ from that of all sets."""
    from textquarry.llm import parity_join as module

    original, seen = module.bucket_levels, []

    def watched(sets, bands, *more):
        out = original(sets, bands, *more)
        seen.append(([np.frombuffer(r["elements"], np.uint64) for r in sets.select("elements").collect()], bands, out[0]))
        return out

    monkeypatch.setattr(module, "COUNTED", 500, raising=False)
    monkeypatch.setattr(module, "bucket_levels", watched)
    rows = [(f"r{i}", " ".join(f"w{(i * 7 + j * j) % 900}" for j in range(60)), ("train", "test")[i % 2], "s") for i in range(60)]
    split_overlaps(spark.createDataFrame(rows, "id string, text string, split string, source string"))
    sets, bands, levels = seen[0]
    n, sizes = np.zeros(module.BUCKETS, np.int64), np.array([len(s) for s in sets])
    for band, at, _ in module._by_band(sizes, bands):
        _, keys = module.cell_contents(*module.joined([sets[i] for i in at]), band, bands.cells[band])
        n += np.bincount(module._bucket(keys), minlength=module.BUCKETS)
    assert sizes.sum() > 2000 and (levels == (4 * np.log2(1 + n)).astype(np.uint8)).all()
