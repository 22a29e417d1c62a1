"""Problem 7: a sample whose categories have target shares, by minimum-cost flow over cell counts."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Hashable
from fractions import Fraction

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from textquarry.session import materialize


class Flow:
    """Minimum-cost flow by successive shortest paths; costs of arcs are not negative."""

    def __init__(self):
        self.arcs: list[list] = []  # to, left, cost
        self.out: dict[Hashable, list[int]] = {}

    def arc(self, a: Hashable, b: Hashable, capacity: int, cost: int) -> int:
        for x, y, left, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, left, c])
        return len(self.arcs) - 2

    def carried(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def solve(self, source: Hashable, sink: Hashable) -> int:
        potential = dict.fromkeys(self.out, 0)
        total = 0
        while True:
            distance, by, heap, tie = {source: 0}, {}, [(0, 0, source)], 0
            while heap:
                d, _, at = heapq.heappop(heap)
                if d > distance[at]:
                    continue
                for k in self.out[at]:
                    to, left, cost = self.arcs[k]
                    new = d + cost + potential[at] - potential[to]
                    if left and new < distance.get(to, math.inf):
                        distance[to], by[to], tie = new, k, tie + 1
                        heapq.heappush(heap, (new, tie, to))
            if sink not in distance:
                return total
            far = max(distance.values())
            for node in potential:
                potential[node] += distance.get(node, far)
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.arcs[by[at] ^ 1][0]
            amount = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= amount
                self.arcs[k ^ 1][1] += amount
            total += amount


def cell_quotas(cells: dict[tuple[str, str], int], targets: list[tuple[str, Fraction, int, Fraction]], seed: int = 0) -> tuple[dict, dict, dict]:
    """(quota by cell, demand by category, shortfall by category) for one dataset.

    cells: available rows by (category, stratum); targets: (category, share, floor, sample fraction). A category demands the larger of its floor and its share of
    the sample, rounded up. Source arcs carry the floors and margins, cell arcs the availability; a stratum
    may take its proportional margin of what can be drawn free of cost and more at a cost, and what no cell can give
    runs over a dear slack arc, which is the shortfall. Units left over by rounding a stratum's margin go to
    randomly chosen strata, by the seed.
    """
    usable = sum(cells.values())
    demand = {c: max(floor, math.ceil(share * fraction * usable)) for c, share, floor, fraction in targets}
    asked = sum(min(n, sum(m for (x, _), m in cells.items() if x == c)) for c, n in demand.items())
    strata = sorted({s for _, s in cells})
    by_stratum = {s: sum(n for (_, t), n in cells.items() if t == s) for s in strata}
    exact = {s: Fraction(asked * by_stratum[s], usable) if usable else Fraction(0) for s in strata}
    margin = {s: math.floor(x) for s, x in exact.items()}
    spare = [s for s in strata if exact[s] > margin[s]]
    for s in random.Random(seed).sample(spare, min(len(spare), asked - sum(margin.values()))):
        margin[s] += 1
    flow, slack, arcs = Flow(), {}, {}
    for c, _, floor, _ in targets:
        slack[c] = flow.arc(("category", c), "sink", demand[c], 1000)
        flow.arc("source", ("category", c), min(floor, demand[c]), 0)
        flow.arc("source", ("category", c), demand[c] - min(floor, demand[c]), 1)
    for (c, s), n in sorted(cells.items()):
        arcs[c, s] = flow.arc(("category", c), ("stratum", s), n, 0)
    for s in strata:
        flow.arc(("stratum", s), "sink", margin[s], 0)
        flow.arc(("stratum", s), "sink", by_stratum[s], 10)
    flow.solve("source", "sink")
    return {k: flow.carried(a) for k, a in arcs.items()}, demand, {c: flow.carried(a) for c, a in slack.items()}


def _exact(x: float) -> Fraction:
    """The decimal that a target was written as."""
    return Fraction(str(x))


def plan_sample(rows: DataFrame, targets: DataFrame, max_cells: int = 100_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(quotas, report) for rows (dataset, category, stratum, ...) and targets (dataset, category,
    target_share, min_rows, sample_fraction).

    Rows whose category has no target, and null categories, are not usable. report has each target with its
    available, demanded and drawn rows and the shortfall. Only cell counts reach the driver; more than
    max_cells of them is an error, as strata must be few. Repeated targets are an error.
    """
    wanted: dict[str, list[Row]] = {}
    given = targets.where("dataset is not null and category is not null").limit(max_cells + 1).collect()
    if len(given) > max_cells:
        raise ValueError(f"more than {max_cells} targets")
    for t in sorted(given, key=lambda t: (t["dataset"], t["category"])):
        wanted.setdefault(t["dataset"], []).append(t)
    if any(len({t["category"] for t in ts}) < len(ts) for ts in wanted.values()):
        raise ValueError("a target is given twice")
    known = F.broadcast(targets.select("dataset", "category"))
    counts = rows.join(known, ["dataset", "category"]).groupBy("dataset", "category", F.coalesce("stratum", F.lit("")).alias("stratum")).count()
    cells: dict[str, dict[tuple[str, str], int]] = {}
    for i, r in enumerate(counts.toLocalIterator()):
        if i >= max_cells:
            raise ValueError(f"more than {max_cells} cells")
        cells.setdefault(r["dataset"], {})[r["category"], r["stratum"]] = r["count"]
    quotas, report = [], []
    for dataset, ts in wanted.items():
        own = cells.get(dataset, {})
        plain = [(t["category"], _exact(t["target_share"]), t["min_rows"] or 0, _exact(t["sample_fraction"])) for t in ts]
        quota, demand, short = cell_quotas(own, plain, seed)
        quotas += [(dataset, c, s, n, own[c, s]) for (c, s), n in quota.items()]
        for t in ts:
            c = t["category"]
            available, drawn = sum(n for (x, _), n in own.items() if x == c), sum(n for (x, _), n in quota.items() if x == c)
            report.append((dataset, c, t["target_share"], available, demand[c], drawn, short[c], drawn / max(1, sum(quota.values()))))
    spark = rows.sparkSession
    return (
        spark.createDataFrame(quotas, "dataset string, category string, stratum string, quota long, available long"),
        spark.createDataFrame(report, "dataset string, category string, target_share double, available long, demanded long, drawn long, shortfall long, actual_share double"),
    )


def draw_sample(rows: DataFrame, quotas: DataFrame, row_id: str = "row_id", seed: int = 0, buckets: int = 4096) -> DataFrame:
    """The rows of the sample: of each cell its quota, those with the smallest seeded hashes of row_id.

    A cell is cut into buckets by hash; whole buckets below the quota are taken as they are and only the one
    that crosses it is ordered, so no cell is gathered or sorted as a whole. Which of rows with the same id is
    taken, where only some are, is not defined. Buckets beyond the quota are dropped before rows are moved: the
    plan, of at most `buckets` rows for each of the plan's bounded cells, is sent to the tasks.
    """
    hashed = rows.withColumn("stratum", F.coalesce("stratum", F.lit(""))).withColumn("_u", F.xxhash64(F.lit(seed), F.col(row_id)))
    hashed = hashed.withColumn("_bucket", F.pmod("_u", F.lit(buckets)))
    cell = ["dataset", "category", "stratum"]
    sizes = hashed.join(F.broadcast(quotas.select(*cell)), cell).groupBy(*cell, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(_window(cell, "_bucket"))
    plan = sizes.withColumn("_upto", upto).join(F.broadcast(quotas), cell).select(*cell, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_take"), "_n").where("_take > 0")
    plan = materialize(plan, "plan")
    small = plan.count() <= 1_000_000
    chosen = hashed.join(F.broadcast(plan) if small else plan, [*cell, "_bucket"])
    whole = chosen.where("_take >= _n")
    cut = chosen.where("_take < _n").withColumn("_rank", F.row_number().over(_window([*cell, "_bucket"], "_u", row_id))).where("_rank <= _take")
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))


def _window(partition: list[str], *order: str):
    return Window.partitionBy(*partition).orderBy(*order)
