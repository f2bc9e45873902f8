"""Consolidating pairwise matches into groups (problem 1).

Connected components by rake and compress.  A round removes, at once, every
vertex of degree one and an independent set of the vertices of degree two:

* a degree-one vertex hangs itself under its only neighbour;
* a degree-two vertex hangs itself under one neighbour and leaves a bridge
  between both.  Which of two adjacent candidates goes is decided by a hash that
  changes per round (the independent-set form of list ranking), so a chain of n
  vertices is gone after O(log n) rounds, not n.

What is left when that stalls - the core, of minimum degree three - is solved by
contraction: every vertex follows its lowest-hash neighbour, the pointers are
doubled until they rest on a root, the edges are rewritten to roots.  Then the
next rounds go on with the contracted graph until no edge is left.

Every removed vertex leaves one row (v, parent) in a forest whose depth is at
most the number of rounds.  Pointer doubling over that forest restores labels.

Scale: all state is in DataFrames; the driver sees two counts a round.  Degrees
and neighbour extremes are mergeable aggregates, so a hub that holds a third of
all rows is pre-aggregated on the map side; edge removal is keyed by the *pair*,
which no hub can skew.  Joins that do carry hub keys are inner or left joins,
which the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import cut


def _incidence(edges: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.col("a").alias("v"), F.col("b").alias("nb")),
        F.struct(F.col("b").alias("v"), F.col("a").alias("nb")),
    )
    return edges.select(F.explode(both).alias("e")).select("e.v", "e.nb")


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rake_and_compress(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One round: the removed vertices (v, parent, other, deg) and the remaining edges."""
    light = (
        _incidence(edges)
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("deg"), F.min("nb").alias("lo"), F.max("nb").alias("hi"))
        .filter("deg <= 2")
        .withColumn("rank", F.struct("deg", F.xxhash64("v", F.lit(seed)).alias("h"), "v"))
    )
    # What the candidates around a vertex hold, sent as messages: keyed by the
    # receiver and combined before the shuffle, so a hub's leaves cost one row a task.
    heard = (
        light.select("rank", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("v"))
        .groupBy("v")
        .agg(F.min("rank").alias("rival"))
    )
    removed = cut(
        light.join(heard, "v", "left")
        .filter(F.col("rival").isNull() | (F.col("rank") < F.col("rival")))
        .select("v", F.col("lo").alias("parent"), F.col("hi").alias("other"), "deg")
    )
    chain = removed.filter("deg = 2")
    gone = removed.select(*_pair(F.col("v"), F.col("parent"))).unionByName(
        chain.select(*_pair(F.col("v"), F.col("other")))
    )
    bridges = chain.select(*_pair(F.col("parent"), F.col("other")))
    rest = (
        edges.withColumn("f", F.lit(0))
        .unionByName(bridges.withColumn("f", F.lit(0)))
        .unionByName(gone.withColumn("f", F.lit(1)))
        .groupBy("a", "b")
        .agg(F.max("f").alias("f"))
        .filter("f = 0")
        .select("a", "b")
    )
    return removed, cut(rest)


def _resolve(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every `parent` of (v, parent) is a root, i.e. no `v` itself."""
    while True:
        up = parents.select(F.col("v").alias("parent"), F.col("parent").alias("grand"))
        step = cut(
            parents.join(up, "parent", "left").select(
                "v", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")
            )
        )
        parents = step.select("v", "parent")
        if step.filter("moved").limit(1).count() == 0:
            return parents


def _contract(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Contract the core: (v, parent) for every non-root vertex, and the edges between roots."""
    best = (
        _incidence(edges)
        .groupBy("v")
        .agg(F.min(F.struct(F.xxhash64("nb", F.lit(seed)).alias("h"), F.col("nb").alias("nb"))).alias("m"))
        .filter(F.col("m") < F.struct(F.xxhash64("v", F.lit(seed)).alias("h"), F.col("v").alias("nb")))
        .select("v", F.col("m.nb").alias("parent"))
    )
    hung = _resolve(cut(best))
    for end in ("a", "b"):
        root = hung.select(F.col("v").alias(end), F.col("parent").alias("root"))
        edges = edges.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    rest = edges.filter("a <> b").select(*_pair(F.col("a"), F.col("b"))).distinct()
    return hung, cut(rest)


def group_matches(
    nodes: DataFrame,
    pairs: DataFrame,
    id_col: str = "id",
    src_col: str = "src",
    dst_col: str = "dst",
    stall: float = 0.35,
    max_rounds: int = 200,
) -> DataFrame:
    """(id, group_id): one row for each distinct non-null id of `nodes`.

    group_id is the smallest id of all that are linked directly or through others
    by `pairs`.  Rows of `pairs` with a null end and self-pairs link nothing, but
    cost nothing either; repeated rows and either order count once.  An end that is
    not in `nodes` still links, and counts for the smallest id.  Empty `pairs`: every
    node is its own group.  Empty `nodes`: no rows.  Other columns are ignored.

    `stall`: share of the edges that a round must remove to go on before the core is
    contracted.
    """
    src, dst = F.col(src_col).cast("bigint"), F.col(dst_col).cast("bigint")
    edges = cut(pairs.filter(src.isNotNull() & dst.isNotNull() & (src != dst)).select(*_pair(src, dst)).distinct())
    left, layers = edges.count(), []
    for turn in range(max_rounds):
        if left == 0:
            break
        removed, rest = _rake_and_compress(edges, turn)
        layers.append(removed.select("v", "parent"))
        before, left, edges = left, rest.count(), rest
        if left and before - left < stall * before:
            hung, edges = _contract(edges, turn + 7919)
            layers.append(hung)
            left = edges.count()
    if left:
        raise RuntimeError("components not resolved in max_rounds")
    ids = nodes.select(F.col(id_col).cast("bigint").alias("id")).filter("id is not null").distinct()
    if not layers:
        return ids.select("id", F.col("id").alias("group_id"))
    forest = layers[0]
    for layer in layers[1:]:
        forest = forest.unionByName(layer)
    roots = _resolve(cut(forest))
    least = roots.groupBy("parent").agg(F.min("v").alias("low")).select("parent", F.least("low", "parent").alias("group_id"))
    labels = roots.join(least, "parent").select(F.col("v").alias("id"), "group_id").unionByName(
        least.select(F.col("parent").alias("id"), "group_id")
    )
    return ids.join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
