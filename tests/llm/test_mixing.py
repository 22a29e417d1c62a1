import random

from textquarry.llm.encoding import DEFAULT_RANKS, PieceIds
from textquarry.llm.mixing import mix_sources, sainte_lague


def plain(weights, capacities, seats):
    given = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [k for k in weights if weights[k] > 0 and given[k] < capacities.get(k, 0)]
        if not open_:
            break
        given[min(open_, key=lambda k: (-weights[k] / (2 * given[k] + 1), str(k)))] += 1
    return given


def test_seats_go_to_highest_quotients():
    rng = random.Random(0)
    for _ in range(300):
        names = "abcdef"[: rng.randrange(1, 7)]
        weights = {k: rng.choice([0.0, rng.random(), 0.25]) for k in names}
        capacities = {k: rng.choice([0, rng.randrange(30), 10**6]) for k in names}
        seats = rng.randrange(200)
        assert sainte_lague(weights, capacities, seats) == plain(weights, capacities, seats)
    assert sum(sainte_lague({"a": 0.3, "b": 0.7}, {"a": 10**9, "b": 10**9}, 10**8).values()) == 10**8


def test_mix(spark):
    rng = random.Random(3)
    sizes = {"big": 600, "mid": 200, "small": 15, "untargeted": 60, None: 20}
    rows = [(f"{s}{i}", s, " ".join(rng.choice(["слово", "дом", "text", "7"]) for _ in range(rng.randrange(1, 80)))) for s, n in sizes.items() for i in range(n)]
    rows += [("n1", "big", None), ("n2", "big", "")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("gone", 0.05, 4)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, source string, text string, tokens int, shard int")
    mix, report = mix_sources(df, targets, shard_tokens=2000)
    coder = PieceIds(open(DEFAULT_RANKS, "rb").read())
    tokens = {i: len(coder.ids(t)) // 4 if t else 0 for i, _, t in rows}
    picked = mix.collect()
    limits = {"big": 1, "mid": 2, "small": 3}
    assert all(r["tokens"] == tokens[r["doc_id"]] and 1 <= r["copies"] <= limits[r["source"]] for r in picked) and len({r["doc_id"] for r in picked}) == len(picked)
    by = {r["source"]: r for r in report.collect()}
    total, held = sum(tokens.values()), sum(r["tokens"] * r["copies"] for r in picked)
    assert abs(held - total / 2) < 0.03 * total
    assert by["gone"]["mixed_tokens"] == 0 and not by["gone"]["met"]
    own = sum(tokens[i] for i, s, _ in rows if s == "small")
    assert by["small"]["mixed_tokens"] == 3 * own  # all it may give
    assert abs(by["big"]["actual_share"] / by["mid"]["actual_share"] - 5 / 3) < 0.2
    assert sum(r["mixed_tokens"] for r in by.values()) == held
    again = {(r["doc_id"], r["copies"]) for r in mix_sources(df.repartition(7), targets, shard_tokens=2000)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in picked}


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    for rows in ([], [("d", "a", None)], [("d", "b", "слово")]):
        mix, report = mix_sources(spark.createDataFrame(rows, "doc_id string, source string, text string"), targets)
        assert mix.count() == 0 and report.first()["mixed_tokens"] == 0
