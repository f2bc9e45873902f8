"""Sample matching target category proportions (problem 7).

The population is counted in cells (category x stratum), a table of bounded size.  A
min-cost flow turns the targets into integer cell quotas: source -> category arcs carry the
floor (taken first) and the rest of the target, category -> cell arcs the availability,
stratum -> sink arcs the stratum's proportional margin at no cost and more at a cost, and a
slack arc from each category to the sink exposes what cannot be met.  Then each cell draws
its quota: the records with the smallest seeded hashes.  A histogram of the hashes finds
the bucket in which the quota ends, so only that bucket is ranked and no cell, however
large, is ever one task's.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import collect_bounded, cut

TOLERANCE = 1e-6


class Flow:
    """Min-cost flow by successive shortest paths (queue-based Bellman-Ford; costs may be negative)."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[object, list[int]] = defaultdict(list)
        self.ends: list[object] = []

    def arc(self, a: object, b: object, cap: int, cost: int = 0) -> int:
        for x, y, c, k in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.cap))
            self.ends.append(y)
            self.cap.append(c)
            self.cost.append(k)
        return len(self.cap) - 2

    def flow(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def run(self, source: object, sink: object) -> None:
        while True:
            dist, via, queue, queued = {source: 0}, {}, [source], {source}
            while queue:
                x = queue.pop(0)
                queued.discard(x)
                for e in self.out[x]:
                    y, d = self.ends[e], dist[x] + self.cost[e]
                    if self.cap[e] > 0 and d < dist.get(y, math.inf):
                        dist[y], via[y] = d, e
                        if y not in queued:
                            queue.append(y)
                            queued.add(y)
            if sink not in dist:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.ends[via[at] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push


def cell_quotas(
    targets: dict[int, tuple[int, int]], cells: dict[tuple[int, int], int]
) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """(quota of each cell, shortfall of each category) for targets {category: (floor, total)}."""
    net, strata = Flow(), defaultdict(int)
    for (y, s), n in cells.items():
        if y in targets:
            strata[s] += n
    everything, wanted = sum(strata.values()), sum(t for _, t in targets.values())
    arcs, slack = {}, {}
    for y, (floor, total) in targets.items():
        floor = min(floor, total)
        net.arc("source", ("y", y), floor, -1)
        net.arc("source", ("y", y), total - floor)
        slack[y] = net.arc(("y", y), "sink", total, 1_000)
    for (y, s), n in sorted(cells.items()):
        if y in targets:
            arcs[y, s] = net.arc(("y", y), ("s", s), n)
    for s, n in strata.items():
        net.arc(("s", s), "sink", round(wanted * n / everything))
        net.arc(("s", s), "sink", n, 1)
    net.run("source", "sink")
    return {k: net.flow(a) for k, a in arcs.items()}, {y: net.flow(a) for y, a in slack.items()}


def sample_quotas(
    nodes: DataFrame,
    targets: DataFrame,
    id_col: str = "id",
    y_col: str = "y",
    train_col: str = "train_idx",
    stratum_col: str = "graph_id",
    seed: int = 29,
    strata: int = 32,
    bucket_rows: int = 50_000,
    max_targets: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for `targets` (table sample_targets).

    Population: distinct ids with train_col true and y >= 0, n of them; null y or train_col
    are no part of it.  A target asks for D = greatest(min_count, target_share * sample_frac * n)
    ids, rounded up.  sample: (target_set, y, id), exactly min(D, available) ids each, without
    repeats in a set.  report: (target_set, y, wanted, available, drawn, shortfall, met), one row
    a target; met is false iff available < D - 1e-6.  Strata (hash classes of `stratum_col`,
    null is one) are kept proportional where that costs no target.  Empty population: nothing
    drawn, every target with D > 0 unmet.  A null floor, share or fraction counts as 0; a null
    y is a category without ids.  Other columns are ignored.

    `bucket_rows`: records that are ranked by one task for a quota.
    """
    rows = collect_bounded(targets.select("target_set", "y", "target_share", "min_count", "sample_frac").distinct(), max_targets, "sample_targets")
    spark = nodes.sparkSession
    people = (
        nodes.filter(F.col(train_col) & (F.col(y_col) >= 0) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("id"), F.col(y_col).cast("bigint").alias("y"),
                F.pmod(F.xxhash64(F.col(stratum_col)), F.lit(strata)).cast("int").alias("s"))
        .groupBy("id", "y").agg(F.min("s").alias("s")).withColumn("h", F.xxhash64("id", F.lit(seed)))
    )
    people = cut(people)
    n = people.select("id").distinct().count()
    listed = sorted({r["y"] for r in rows if r["y"] is not None})
    mine = people.filter(F.col("y").isin(listed))
    cells = {
        (r["y"], r["s"]): r["n"]
        for r in collect_bounded(mine.groupBy("y", "s").agg(F.count(F.lit(1)).alias("n")), len(listed) * strata, "cells")
    }
    available = defaultdict(int)
    for (y, _), k in cells.items():
        available[y] += k
    quotas, report = [], []
    for name in sorted({r["target_set"] for r in rows}):
        asked = {}
        for r in rows:
            if r["target_set"] == name:
                floor = r["min_count"] or 0
                want = float(max(floor, (r["target_share"] or 0.0) * (r["sample_frac"] or 0.0) * n))
                asked[r["y"]] = (max(0, math.ceil(floor - TOLERANCE)), max(0, math.ceil(want - TOLERANCE)), want)
        got, short = cell_quotas({y: a[:2] for y, a in asked.items()}, cells)
        quotas += [(name, y, s, q) for (y, s), q in got.items() if q > 0]
        report += [(name, y, a[2], available[y], a[1] - short[y], short[y], short[y] == 0) for y, a in asked.items()]
    report = spark.createDataFrame(
        report, "target_set string, y bigint, wanted double, available bigint, drawn bigint, shortfall bigint, met boolean"
    )
    quota = spark.createDataFrame(quotas, "target_set string, y bigint, s int, q bigint")
    buckets = max(1, math.ceil(max(cells.values(), default=0) / bucket_rows))
    mine = mine.withColumn("b", F.pmod(F.shiftrightunsigned("h", 8), F.lit(buckets)))
    upto = Window.partitionBy("y", "s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    histogram = mine.groupBy("y", "s", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    take = histogram.join(quota, ["y", "s"]).withColumn("r", F.col("q") - (F.col("upto") - F.col("n"))).filter("r > 0")
    drawn = mine.join(take.select("target_set", "y", "s", "b", "r", "n"), ["y", "s", "b"])
    whole = drawn.filter("r >= n")
    rank = F.row_number().over(Window.partitionBy("target_set", "y", "s", "b").orderBy("h", "id"))
    part = drawn.filter("r < n").withColumn("k", rank).filter("k <= r")
    keep = ["target_set", "y", "id"]
    return whole.select(*keep).unionByName(part.select(*keep)), report
