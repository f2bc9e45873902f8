"""Mixing sources to target weights (problem 9).

A source's target in tokens becomes so many whole copies of all its documents and one
inclusion probability for the rest.  Which documents fill the rest is drawn by the cube
method: a block of documents starts at its probabilities and moves, three documents at a
time, along the null space of the two balancing equations (number of documents, number of
tokens) until at most two of them are undecided, so both totals of a block are exact up
to those.  The undecided of all blocks are balanced again together, level by level, until
one block per source is left; its last two units are the landing problem, decided by the
smaller error in tokens.

Blocks are cut by a hash of the document, with a size bound, so a source with a third of
all documents is many groups.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import collect_bounded, cut

EPS = 1e-9


def flight(p: list[float], t: list[float], rng: np.random.Generator) -> list[float]:
    """Move probabilities `p` to 0 or 1, keeping sum(p) and sum(p * t); at most two stay between."""
    p, n = list(p), len(p)
    held: list[int] = []
    draws, d = rng.random(4096), 0
    at = 0
    while True:
        held = [i for i in held if EPS < p[i] < 1 - EPS]
        while len(held) < 3 and at < n:
            if EPS < p[at] < 1 - EPS:
                held.append(at)
            else:
                p[at] = float(round(p[at]))
            at += 1
        if len(held) < 2:
            return p
        if len(held) == 3:
            a, b, c = held
            u = [t[b] - t[c], t[c] - t[a], t[a] - t[b]]
            if u[0] == 0 and u[1] == 0:
                u = [1.0, -1.0, 0.0]
        else:
            a, b = held
            if t[a] != t[b]:
                return p  # two units, two equations: only zero is in the null space
            u = [1.0, -1.0]
        up = down = math.inf
        for i, x in zip(held, u):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        if d == len(draws):
            draws, d = rng.random(4096), 0
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        for i, x in zip(held, u):
            v = p[i] + step * x
            p[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v


def land(p: list[float], t: list[float]) -> list[float]:
    """Decide the (at most two) units that are left by the smaller error in tokens."""
    left = [i for i, v in enumerate(p) if EPS < v < 1 - EPS]
    want = sum(p[i] * t[i] for i in left)
    best = min(range(2 ** len(left)), key=lambda m: abs(sum(t[i] for k, i in enumerate(left) if m >> k & 1) - want))
    for k, i in enumerate(left):
        p[i] = float(best >> k & 1)
    return p


def _fly(seed: int, landing: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([seed, zlib.crc32("\0".join(map(str, key)).encode())])
        order = rng.permutation(len(pdf))
        pdf = pdf.iloc[order]
        t = pdf["n_tokens"].astype(float).tolist()
        p = flight(pdf["p"].tolist(), t, rng)
        return pdf.drop(columns="b").assign(p=land(p, t) if landing else p)

    return run


_SCHEMA = "mix_name string, source string, doc_id bigint, n_tokens bigint, whole bigint, p double, hash bigint"


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each row of `targets`: tokens wanted and there, whether it can be met, copies and probability.

    sizes: (source, size, n_docs).  A target cannot be met if
    target_share * size_factor * n > max_repeats * size, n being the size of all sources
    listed in the mix; it then gets all that max_repeats allows.
    """
    t = targets.select("mix_name", "source", "target_share", "size_factor", "max_repeats").distinct()
    t = t.join(sizes, "source", "left").fillna(0, ["size", "n_docs"])
    listed = t.select("mix_name", "source", "size").distinct().groupBy("mix_name").agg(F.sum("size").alias("n"))
    t = t.join(listed, "mix_name")
    want = F.col("target_share") * F.col("size_factor") * F.col("n")
    most = F.col("max_repeats") * F.col("size")
    times = F.when(F.col("size") > 0, F.least(want, most.cast("double")) / F.col("size")).otherwise(0.0)
    return (
        t.withColumn("want", want).withColumn("met", ~(want > most)).withColumn("times", times)
        .withColumn("whole", F.floor("times").cast("bigint")).withColumn("p", F.col("times") - F.col("whole"))
        .drop("times")
    )


def mix_sources(
    docs: DataFrame, targets: DataFrame, seed: int = 17, block: int = 20_000, max_targets: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for docs (doc_id, source, n_tokens) and `targets` (table mix_targets).

    selection: (mix_name, source, doc_id, n_tokens, copies), copies >= 1 and at most max_repeats.
    report: a row for each row of targets with (met, target_share, actual_share, target_tokens,
    actual_tokens, n_docs); actual_share is of all tokens selected for the mix (null if none).
    Documents without tokens or source are never selected; a repeated doc_id counts once
    (its smallest source and size); one that is null is left out.
    A source without documents cannot be met unless its target is 0.  Empty targets or
    documents give empty results or targets that are not met.

    `block`: documents that one task balances at once.
    """
    own = docs.select("doc_id", F.struct("source", F.col("n_tokens").cast("bigint").alias("n_tokens")).alias("one"))
    docs = own.filter("doc_id is not null and one.source is not null and one.n_tokens > 0").groupBy("doc_id").agg(F.min("one").alias("one")).select("doc_id", "one.*")
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    planned = plan_mix(sizes, targets)
    rows = collect_bounded(planned, max_targets, "mix_targets")
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, planned.schema)
    # The plan has as many rows as the (fixed) targets, checked above, hence the broadcast.
    units = docs.join(F.broadcast(plan.filter("whole > 0 or p > 0").select("mix_name", "source", "whole", "p", F.col("n_docs").alias("n_own"))), "source")
    units = units.withColumn("hash", F.xxhash64("doc_id", F.lit(seed)))
    keep = ["mix_name", "source", "doc_id", "n_tokens", "whole", "p", "hash"]
    blocks = max([1, *(math.ceil(r["n_docs"] / block) for r in rows)])
    level = F.pmod("hash", F.greatest(F.lit(1), F.ceil(F.col("n_own") / block)))
    moved = cut(
        units.select(*keep, level.alias("b")).groupBy("mix_name", "source", "b").applyInPandas(_fly(seed, blocks == 1), _SCHEMA)
    )
    undecided = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    decided = moved.filter(~undecided)
    while blocks > 1:
        blocks = math.ceil(blocks / (block // 2))  # two units a block are left
        seed += 1
        moved = cut(
            moved.filter(undecided).withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)))
            .groupBy("mix_name", "source", "b").applyInPandas(_fly(seed, blocks == 1), _SCHEMA)
        )
        decided = decided.unionByName(moved.filter(~undecided))
    selection = decided.select(
        "mix_name", "source", "doc_id", "n_tokens", (F.col("whole") + F.round("p").cast("bigint")).alias("copies")
    ).filter("copies > 0")
    got = selection.groupBy("mix_name", "source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.count(F.lit(1)).alias("n_used")
    )
    total = got.groupBy("mix_name").agg(F.sum("actual_tokens").alias("mix_tokens"))
    report = plan.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left").select(
        "mix_name", "source", "met", "target_share",
        (F.coalesce("actual_tokens", F.lit(0)) / F.col("mix_tokens")).alias("actual_share"),
        F.col("want").alias("target_tokens"), F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
        F.coalesce("n_used", F.lit(0)).alias("n_docs"), "max_repeats",
    )
    return selection, report
