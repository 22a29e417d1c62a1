import itertools
import math
import random
from fractions import Fraction

from textquarry.llm.target_sample import Flow, cell_quotas, draw_sample, plan_sample


def test_flow_is_cheapest():
    rng = random.Random(0)
    for _ in range(30):
        caps = {(a, b): (rng.randrange(4), rng.randrange(5)) for a in "xy" for b in "uv"}
        flow = Flow()
        arcs = {k: flow.arc(*k, c, w) for k, (c, w) in caps.items()}
        for a in "xy":
            flow.arc("s", a, 3, 0)
        for b in "uv":
            flow.arc(b, "t", 3, 0)
        total = flow.solve("s", "t")
        cost = sum(flow.carried(k) * caps[e][1] for e, k in arcs.items())
        best = None
        for f in itertools.product(*[range(c + 1) for c, _ in caps.values()]):
            x = dict(zip(caps, f, strict=True))
            if all(sum(x[a, b] for b in "uv") <= 3 for a in "xy") and all(sum(x[a, b] for a in "xy") <= 3 for b in "uv"):
                key = (-sum(f), sum(n * caps[e][1] for e, n in x.items()))
                best = key if best is None else min(best, key)
        assert best == (-total, cost)


def test_quotas_meet_demand_or_show_shortfall():
    rng = random.Random(1)
    for seed in range(50):
        cells = {(c, s): rng.randrange(60) for c in "abc" for s in "123"}
        targets = [(c, Fraction(rng.randrange(1, 90), 100), rng.randrange(0, 40), Fraction(rng.randrange(1, 10), 10)) for c in "abcz"]
        quota, demand, short = cell_quotas(cells, targets, seed)
        for c, share, floor, fraction in targets:
            assert demand[c] == max(floor, math.ceil(share * fraction * sum(cells.values())))
            available = sum(n for (x, _), n in cells.items() if x == c)
            assert short[c] == max(0, demand[c] - available)
            assert sum(n for (x, _), n in quota.items() if x == c) == min(demand[c], available)
        assert all(0 <= n <= cells[k] for k, n in quota.items())
    assert cell_quotas({}, [("a", Fraction(1, 2), 3, Fraction(1))])[2] == {"a": 3}


def test_sample(spark):
    rows = [("d", c, str(y), i, 1) for i, (c, y) in enumerate(([("a", 1)] * 50 + [("a", 2)] * 30 + [("b", 1)] * 10 + [("c", None)] * 4 + [("other", 1)] * 20 + [(None, 1)] * 5) * 5)]
    df = spark.createDataFrame(rows, "dataset string, category string, stratum string, row_id long, _u int")
    targets = spark.createDataFrame([("d", "a", 0.5, 5, 0.4), ("d", "b", 0.45, 5, 0.4), ("d", "c", 0.05, 10, 0.4), ("d", "none", 0.0, 1, 0.4), ("e", "a", 0.5, 2, 0.4)], "dataset string, category string, target_share double, min_rows int, sample_fraction double")
    quotas, report = plan_sample(df, targets)
    by = {(r["dataset"], r["category"]): r for r in report.collect()}
    assert {k: (r["available"], r["demanded"], r["drawn"], r["shortfall"]) for k, r in by.items()} == {
        ("d", "a"): (400, 94, 94, 0), ("d", "b"): (50, 85, 50, 35), ("d", "c"): (20, 10, 10, 0), ("d", "none"): (0, 1, 0, 1), ("e", "a"): (0, 2, 0, 2),
    }
    for buckets in (1, 3, 4096):
        sample = draw_sample(df.drop("_u"), quotas, buckets=buckets).collect()
        assert len({r["row_id"] for r in sample}) == len(sample) == 154
        assert sum(r["category"] == "a" for r in sample) == 94
    assert draw_sample(df.drop("_u").where("false"), quotas).count() == 0
