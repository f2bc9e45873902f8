"""Traversal, sub-graphs and paths: frontier joins with anti-joined visited sets.

A step joins the frontier, not the visited set, with the edges; lineage is cut once a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import cut
from weftgraph.operators.segment import with_dense_ids


def k_hop_nodes(edges: DataFrame, seeds: DataFrame, hops: int, reverse: bool = False, keys: list[str] | None = None) -> DataFrame:
    """(keys..., id, hop): nodes within `hops` steps of the seeds, with their distance.

    By default steps follow in-edges (from dst to src), `reverse` follows out-edges.  With
    `keys`, columns of `seeds`, each key combination is its own search.
    """
    keys = keys or []
    here, there = ("src", "dst") if reverse else ("dst", "src")
    step = edges.select(F.col(here).alias("id"), F.col(there).alias("to"))  # the reached are made distinct
    seen = cut(seeds.select(*keys, "id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(step, "id").select(*keys, F.col("to").alias("id")).distinct()
        frontier = cut(reached.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges with both ends in `nodes` (id), per key combination if `keys` are given.

    With keys an edge is handed to the key combinations that hold its end of fewer of them, and
    looked for there by the other end: a hub that all hold costs its edges nothing.
    """
    if not keys:
        ids = nodes.select("id")
        e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    s = nodes.select(*keys, F.col("id").alias("src"))
    d = nodes.select(*keys, F.col("id").alias("dst"))
    held = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.join(held.select(F.col("id").alias("src"), F.col("n").alias("__s")), "src").join(held.select(F.col("id").alias("dst"), F.col("n").alias("__d")), "dst")
    ends = cut(ends.select(*edges.columns, (F.col("__s") <= F.col("__d")).alias("__by_src")))
    by_src = ends.filter("__by_src").drop("__by_src").join(s, "src").join(d, [*keys, "dst"])
    by_dst = ends.filter("not __by_src").drop("__by_src").join(d, "dst").join(s, [*keys, "src"])
    return by_src.select(*keys, *edges.columns).unionByName(by_dst.select(*keys, *edges.columns))


def relabel(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, new), edges with new ids): 0-based in the order of ids."""
    m = cut(with_dense_ids(nodes.select("id").distinct(), "id", "new"))
    s, d = m.select(F.col("id").alias("src"), F.col("new").alias("__s")), m.select(F.col("id").alias("dst"), F.col("new").alias("__d"))
    e = edges.join(s, "src").join(d, "dst").withColumns({"src": F.col("__s"), "dst": F.col("__d")}).drop("__s", "__d")
    return m, e


def k_hop_subgraph(edges: DataFrame, seeds: DataFrame, hops: int, reverse: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with hop and new id, relabelled edges, original edges with `mask`)."""
    nodes = k_hop_nodes(edges, seeds, hops, reverse)
    inside = induced(edges, nodes)
    m, e = relabel(inside, nodes)
    s, d = nodes.select(F.col("id").alias("src"), F.lit(True).alias("__a")), nodes.select(F.col("id").alias("dst"), F.lit(True).alias("__b"))
    masked = edges.join(s, "src", "left").join(d, "dst", "left").withColumn("mask", F.col("__a").isNotNull() & F.col("__b").isNotNull()).drop("__a", "__b")
    return nodes.join(m, "id"), e, masked


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., source, id, dist, parent): breadth-first along out-edges, `parent` the smallest predecessor.

    `sources` is (keys..., source); edges carry the keys too if given (graph by graph).  The
    source itself has dist 0 and a null parent.
    """
    keys = keys or []
    step = edges.select(*keys, F.col("src").alias("id"), F.col("dst").alias("to"))  # the reached are grouped
    seen = cut(sources.select(*keys, "source", F.col("source").alias("id"), F.lit(0).alias("dist"), F.lit(None).cast("bigint").alias("parent")).distinct())
    frontier = seen
    for dist in range(1, cutoff + 1):
        reached = (
            frontier.join(step, [*keys, "id"]).groupBy(*keys, "source", F.col("to").alias("id")).agg(F.min("id").alias("parent"))
        )
        frontier = cut(reached.join(seen, [*keys, "source", "id"], "left_anti").withColumn("dist", F.lit(dist)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier.select(seen.columns))
    return seen


def with_paths(tree: DataFrame, cutoff: int) -> DataFrame:
    """Adds `path`, the node ids from source to id, to the rows of `shortest_paths` (bounded by the cutoff)."""
    done = tree.filter("dist = 0").withColumn("path", F.array("source"))
    out = done
    for dist in range(1, cutoff + 1):
        up = done.select("source", F.col("id").alias("parent"), F.col("path").alias("__p"))
        done = tree.filter(F.col("dist") == dist).join(up, ["source", "parent"]).withColumn("path", F.concat("__p", F.array("id"))).drop("__p")
        out = out.unionByName(done.select(out.columns))
    return out


def _grown(pairs: DataFrame, step: DataFrame, start: str, end: str, steps: int) -> DataFrame:
    """(src, dst, at, path, n): paths without a repeated node of n <= `steps` edges (at, to) from `start` of each pair, never at `end`.

    Paths read in the direction of the pair, those grown from dst from `at` on.
    """
    state = cut(pairs.select("src", "dst", F.col(start).alias("at"), F.array(start).alias("path"), F.lit(0).alias("n")))
    out = state
    for n in range(1, steps + 1):
        new = F.array("to")
        path = F.concat("path", new) if start == "src" else F.concat(new, "path")
        free = state.join(step, "at").filter(~F.array_contains("path", F.col("to")) & (F.col("to") != F.col(end)))
        state = cut(free.select("src", "dst", F.col("to").alias("at"), path.alias("path"), F.lit(n).alias("n")))
        out = out.unionByName(state)
    return out


def simple_paths(edges: DataFrame, pairs: DataFrame, max_length: int) -> DataFrame:
    """(src, dst, path): all paths without a repeated node of at most `max_length` nodes; stops at dst.

    `pairs` is (src, dst).  A pair with src = dst has the path of one node.  Other paths are
    grown from both ends and meet over their middle edge, which is looked for from its end of
    fewer edges: a hub on the way is not expanded.
    """
    pairs = pairs.select("src", "dst").distinct()
    done = pairs.filter("src = dst").select("src", "dst", F.array("src").alias("path"))
    if max_length < 2:
        return done
    step, pairs = cut(edges.select("src", "dst").distinct()), pairs.filter("src <> dst")
    ahead, behind = (max_length - 1) // 2, (max_length - 2) // 2
    heads = _grown(pairs, step.select(F.col("src").alias("at"), F.col("dst").alias("to")), "src", "dst", ahead)
    tails = _grown(pairs, step.select(F.col("dst").alias("at"), F.col("src").alias("to")), "dst", "src", behind)
    middle = step.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    middle = cut(middle.join(heads.select(F.col("at").alias("a")).distinct(), "a", "left_semi").join(tails.select(F.col("at").alias("b")).distinct(), "b", "left_semi"))
    count = lambda c, n: middle.groupBy(c).agg(F.count(F.lit(1)).alias(n))
    middle = cut(middle.join(count("a", "na"), "a").join(count("b", "nb"), "b").select("a", "b", (F.col("na") <= F.col("nb")).alias("from_a")))
    heads = heads.select("src", "dst", F.col("at").alias("a"), F.col("path").alias("head"), F.col("n").alias("f"))
    tails = tails.select("src", "dst", F.col("at").alias("b"), F.col("path").alias("tail"), F.col("n").alias("g"))
    met = heads.join(middle.filter("from_a"), "a").join(tails, ["src", "dst", "b"]).select("src", "dst", "head", "tail", "f", "g").unionByName(
        tails.join(middle.filter("not from_a"), "b").join(heads, ["src", "dst", "a"]).select("src", "dst", "head", "tail", "f", "g")
    )
    once = F.expr(f"f - g in (0, 1) and f + g <= {max_length - 2}") & ~F.arrays_overlap("head", "tail")  # a length has one middle edge
    return done.unionByName(met.filter(once).select("src", "dst", F.concat("head", "tail").alias("path")))


def drnl(d1: Column, d2: Column) -> Column:
    """Double-radius label of a node at distances d1 and d2 of a pair: 1 + min + (d/2)(d/2 + d%2 - 1), d = d1 + d2.

    0 where a distance is null; 1 for both ends of the pair (a distance of 0).
    """
    d = d1 + d2
    half = F.floor(d / 2).cast("bigint")
    z = 1 + F.least(d1, d2) + half * (half + F.pmod(d, F.lit(2)) - 1)
    return F.when((d1 == 0) | (d2 == 0), F.lit(1)).otherwise(F.coalesce(z, F.lit(0))).cast("bigint")


def enclosing_subgraphs(edges: DataFrame, pairs: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(nodes (pair_id, id, z), edges (pair_id, src, dst)) around each pair (pair_id, a, b), the pair's own edges left out.

    z is the double-radius label by distances inside the undirected k-hop neighbourhood.
    """
    ends = pairs.select("pair_id", F.explode(F.array("a", "b")).alias("id"))
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    und = edges.select(F.explode(both).alias("e")).select("e.src", "e.dst").filter("src <> dst").distinct()
    nodes = cut(k_hop_nodes(und, ends, hops, keys=["pair_id"]).select("pair_id", "id"))
    inside = induced(und, nodes, ["pair_id"]).select("pair_id", "src", "dst").join(pairs, "pair_id")
    own = ((F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))) | ((F.col("src") == F.col("b")) & (F.col("dst") == F.col("a")))
    inside = cut(inside.filter(~own))
    dist = []
    for end, other in (("a", "b"), ("b", "a")):
        # Distances to one end are taken with the other end removed.
        open_ = inside.filter((F.col("src") != F.col(other)) & (F.col("dst") != F.col(other))).select("pair_id", "src", "dst")
        start = pairs.select("pair_id", F.col(end).alias("source"))
        dist.append(shortest_paths(open_, start, 2 * hops + 1, ["pair_id"]).select("pair_id", "id", F.col("dist").alias(f"d_{end}")))
    labelled = nodes.join(dist[0], ["pair_id", "id"], "left").join(dist[1], ["pair_id", "id"], "left").join(pairs, "pair_id")
    is_end = (F.col("id") == F.col("a")) | (F.col("id") == F.col("b"))
    z = F.when(is_end, F.lit(1)).otherwise(drnl(F.col("d_a"), F.col("d_b"))).cast("bigint")
    return labelled.select("pair_id", "id", z.alias("z")), inside.select("pair_id", "src", "dst")


def undirected_simple(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b: the simple undirected graph."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _ranked(edges: DataFrame) -> DataFrame:
    """Simple edges (u, v, du, dv) from the end of lower degree to that of higher (ids break ties)."""
    e = undirected_simple(edges)
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    ends = ("a", "b"), ("b", "a"), ("da", "db"), ("db", "da")
    return e.select(*[F.when(up, F.col(x)).otherwise(F.col(y)).alias(n) for n, (x, y) in zip(("u", "v", "du", "dv"), ends)])


def _oriented(edges: DataFrame) -> DataFrame:
    """The pairs (u, v) of `_ranked`.

    A node has at most sqrt(2 m) out-edges then, so wedges stay within m^1.5 even at hubs.
    """
    return _ranked(edges).select("u", "v")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: each triangle of the simple undirected graph once."""
    e = cut(_oriented(edges))
    e1, e2 = e.select("u", F.col("v").alias("v1")), e.select("u", F.col("v").alias("v2"))
    wedges = e1.join(e2, "u").filter("v1 < v2").select("u", "v1", "v2")
    closed = undirected_simple(e.select(F.col("u").alias("src"), F.col("v").alias("dst"))).select(F.col("a").alias("v1"), F.col("b").alias("v2"))
    t = F.sort_array(F.array("u", "v1", "v2"))
    return wedges.join(closed, ["v1", "v2"]).select(t.alias("t")).select(F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b"), F.get("t", F.lit(2)).alias("c"))


def cycle_counts(edges: DataFrame) -> DataFrame:
    """One row (c3, c4): triangles and squares of the simple undirected graph.

    A square is counted once, from its node of highest degree (ids break ties): of the wedges
    v - u - w with v above u and w, each pair with the same ends closes one.  An edge w - v
    closes a triangle with each such u below w.  A wedge has an out-edge of `_oriented`, so
    their number stays within m^1.5 even at hubs; both counts come from one aggregation.
    """
    e = cut(_ranked(edges))
    to = e.select("u", "v", "dv")
    of = e.select("u", F.col("v").alias("w"), F.col("dv").alias("dw"), F.lit(1).alias("up")).unionByName(
        e.select(F.col("v").alias("u"), F.col("u").alias("w"), F.col("du").alias("dw"), F.lit(0).alias("up"))
    )
    below = (F.col("dw") < F.col("dv")) | ((F.col("dw") == F.col("dv")) & (F.col("w") < F.col("v")))
    wedges = to.join(of, "u").filter(below).select("v", "w", F.lit(1).alias("n"), "up", F.lit(0).alias("edge"))
    closing = e.select("v", F.col("u").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("up"), F.lit(1).alias("edge"))
    pairs = wedges.unionByName(closing).groupBy("v", "w").agg(*[F.sum(c).alias(c) for c in ("n", "up", "edge")])
    total = lambda c: F.coalesce(F.sum(F.expr(c)), F.lit(0)).cast("bigint")
    return pairs.agg(total("up * edge").alias("c3"), total("n * (n - 1) div 2").alias("c4"))


def bfs_order(tree: DataFrame) -> DataFrame:
    """Adds `pos`, the place of a node in its source's breadth-first order (distance, then id).

    Dense ids over all sources (a range partition of source, distance and id) less the source's
    first: a source that reaches all nodes is no task of its own.
    """
    t = cut(with_dense_ids(tree.withColumn("__k", F.struct("source", "dist", "id")), "__k", "pos").drop("__k"))
    first = t.groupBy("source").agg(F.min("pos").alias("__f"))
    return t.join(first, "source").withColumn("pos", F.col("pos") - F.col("__f")).drop("__f")
