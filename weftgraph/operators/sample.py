"""Seeded sampling: neighbours, walks, negatives, sub-graphs.

All draws are functions of (seed, key), so a rerun task draws the same and another engine
can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import cut, store
from weftgraph.functions.rand import order_key, pick, uniform
from weftgraph.operators import edges as E
from weftgraph.operators.draws import block_pairs, smallest
from weftgraph.operators.segment import with_dense_ids
from weftgraph.operators.traverse import induced

#: Transitions of a node of `node2vec_probabilities` in one part, at least.
TRANSITIONS = 4_000_000


def with_edge_ids(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `eid`, the dense rank of distinct rows by `keys` (all columns that tell edges apart)."""
    return with_dense_ids(edges.withColumn("__k", F.struct(*keys)), "__k", "eid").drop("__k")


def sample_neighbours(edges: DataFrame, frontier: DataFrame, fanout: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """In-edges of the frontier (keys..., id), at most `fanout` of each node without replacement; -1 takes all.

    edges: (src, dst, eid[, rel]); a `rel` column makes the fan-out per relation.  The draw is
    the smallest digests of (seed, keys, eid): a top-k aggregate, which keeps at most `fanout`
    rows of a node in each task before the shuffle (WindowGroupLimit).  With `keys` (batches) a
    hub is drawn from once for each, by `draws.smallest`; rows of the frontier are distinct then.
    """
    keys = keys or []
    if keys and fanout >= 0 and set(edges.columns) == {"src", "dst", "eid"}:
        return smallest(edges, frontier, fanout, seed, keys)
    near = edges.join(frontier.select(*keys, F.col("id").alias("dst")), "dst")
    if fanout < 0:
        return near
    group = [*keys, "dst"] + (["rel"] if "rel" in edges.columns else [])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order_key(seed, *[F.col(k) for k in keys], F.col("eid")), "eid"))
    return near.withColumn("__r", rank).filter(F.col("__r") <= fanout).drop("__r")


def neighbour_batches(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes (batch_id, id, hop), sampled edges (batch_id, src, dst, eid, hop)) for all mini-batches in one job.

    seeds: (batch_id, id).  A node is expanded once, at the hop it is first reached.  With
    directed=False the edges are those induced by the sampled nodes.
    """
    nodes = cut(seeds.select("batch_id", "id").distinct().withColumn("hop", F.lit(0)))
    frontier, parts = nodes, []
    for hop, fanout in enumerate(fanouts, 1):
        got = cut(sample_neighbours(edges, frontier, fanout, seed + hop, ["batch_id"]).withColumn("hop", F.lit(hop)))
        parts.append(got.select("batch_id", "src", "dst", "eid", "hop"))
        reached = got.select("batch_id", F.col("src").alias("id")).distinct()
        frontier = cut(reached.join(nodes.select("batch_id", "id"), ["batch_id", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        nodes = nodes.unionByName(frontier)
    if not directed:
        return nodes, induced(edges, nodes, ["batch_id"])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return nodes, out


def batches(ids: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """(batch_id, id): ids in order, or shuffled by `seed`, in batches of `size`."""
    if seed is None:
        d = with_dense_ids(ids.select("id"), "id", "pos")
    else:
        d = with_dense_ids(ids.select("id", F.struct(order_key(seed, F.col("id")).alias("h"), F.col("id").alias("i")).alias("k")), "k", "pos")
    return d.select(F.floor(F.col("pos") / size).cast("bigint").alias("batch_id"), "id")


def _out_degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, deg) and (id, pos, to): the distinct out-neighbours of a node, numbered by id."""
    return _numbered(edges.select(F.col("src").alias("id"), F.col("dst").alias("to")), ["id"])


def _numbered(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """((keys, deg), (keys, to, pos)): distinct `to` of each key, numbered from 0.

    Places in one distributed order of (keys, to): a hub's neighbourhood lies in as many range
    partitions as it needs, and a row counts from the first of its key there.  The sorted rows
    are stored as Parquet, in a fraction of a checkpoint's size.
    """
    order = [*keys, "to"]
    d = pairs.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    d = store(d.withColumn("__m", F.monotonically_increasing_id()))[0].withColumn("__pid", F.shiftright("__m", 33))
    runs = cut(d.groupBy(*keys, "__pid").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("__first")))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = runs.select(*keys, "__pid", (F.col("__first") - F.coalesce(before, F.lit(0))).alias("__start"))
    e = store(d.join(starts, [*keys, "__pid"]).select(*order, (F.col("__m") - F.col("__start")).alias("pos")))[0]
    return runs.groupBy(*keys).agg(F.sum("n").alias("deg")), e


def random_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int, restart: float = 0.0) -> DataFrame:
    """(walk_id, step, id): uniform walks of `length` steps from starts (walk_id, id).

    A sink stays where it is.  With probability `restart` a step goes to a neighbour of the
    start instead.  Step s of a walk picks the neighbour number floor(u * degree) with u a
    function of (seed, walk_id, s).
    """
    deg, nbr = _out_degrees(edges)
    cur = starts.select("walk_id", "id", F.col("id").alias("start"))
    out = cur.select("walk_id", F.lit(0).alias("step"), "id")
    for s in range(1, length + 1):
        again = uniform(seed + 7919, F.col("walk_id"), F.lit(s)) < F.lit(restart)
        at = cur.withColumn("id", F.when(again, F.col("start")).otherwise(F.col("id"))) if restart else cur
        at = at.join(deg, "id", "left").withColumn("pos", pick(F.col("deg"), seed, F.col("walk_id"), F.lit(s)))
        cur = cut(at.join(nbr, ["id", "pos"], "left").select("walk_id", F.coalesce("to", "id").alias("id"), "start"))
        out = out.unionByName(cur.select("walk_id", F.lit(s).alias("step"), "id"))
    return out


def walk_windows(walks: DataFrame, size: int) -> DataFrame:
    """(walk_id, pos, window): each run of `size` consecutive nodes of a walk (a walk is bounded by its length)."""
    path = walks.groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("step", "id"))).alias("p")).select("walk_id", F.col("p.id").alias("path"))
    some = path.filter(F.size("path") >= size)
    return some.select("walk_id", "path", F.explode(F.sequence(F.lit(1), F.size("path") - size + 1)).alias("pos")).select(
        "walk_id", (F.col("pos") - 1).alias("pos"), F.slice("path", F.col("pos"), F.lit(size)).alias("window")
    )


def node2vec_probabilities(edges: DataFrame, p: float, q: float, states: DataFrame | None = None) -> DataFrame:
    """(prev, cur, nxt, prob): second-order transition probabilities of the states (prev, cur) asked for.

    Weights (summed over equal pairs) count 1/p for the way back, 1 for a common neighbour of
    prev and 1/q otherwise.  States that are no edges have no rows.  Without `states` all edges
    are: a node then costs its in-degree times its out-degree, which hubs make very many.
    """
    e = store(E.coalesce(edges.select("src", "dst", "w")))[0]
    a = e.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    if states is not None:
        a = a.join(states.select("prev", "cur").distinct(), ["prev", "cur"], "left_semi")
    out = cut(e.groupBy(F.col("src").alias("cur")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sum")))
    a = a.join(out, "cur").join(out.select(F.col("cur").alias("prev"), F.col("n").alias("m")), "prev")
    a = cut(a.select("prev", "cur", "n", "sum", (F.col("m") <= F.col("n")).alias("by_prev")))
    b = e.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w")
    known = e.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"))
    # Next nodes near prev, looked for from the end of fewer edges, and the way back: all others have one weight a node.
    s = a.select("prev", "cur", "by_prev")
    ahead = s.filter("by_prev").join(known, "prev").filter("nxt <> prev").select("prev", "cur", "nxt").unionByName(s.select("prev", "cur", F.col("prev").alias("nxt")))
    special = ahead.join(b, ["cur", "nxt"]).select("prev", "cur", "nxt", "w").unionByName(
        s.filter("not by_prev").join(b, "cur").filter("nxt <> prev").join(known, ["prev", "nxt"]).select("prev", "cur", "nxt", "w")
    )
    rest, own = F.lit(1.0 / q), F.when(F.col("nxt") == F.col("prev"), F.lit(1.0 / p)).otherwise(F.lit(1.0))
    special = special.groupBy("prev", "cur").agg(
        F.sum(F.col("w") * (own - rest)).alias("more"), F.collect_list(F.when(F.col("nxt") != F.col("prev"), F.col("nxt"))).alias("near")
    )
    total = F.col("sum") * rest + F.coalesce("more", F.lit(0.0))
    # The transitions are formed last and travel nowhere; a node of very many is parted by prev.
    spark = edges.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = cut(a.groupBy("cur").agg((F.count(F.lit(1)) * F.first("n")).alias("work")))
    share = max(TRANSITIONS, (work.agg(F.sum("work")).first()[0] or 0) // tasks)  # else a hub's edges would be sent to parts of a few states each
    parts = work.select("cur", (F.floor(F.col("work") / share) + 1).cast("int").alias("parts"))
    a = a.join(special, ["prev", "cur"], "left").join(parts, "cur")
    a = a.select("prev", "cur", total.alias("s"), F.coalesce("near", F.array().cast("array<bigint>")).alias("near"), F.pmod(F.xxhash64("prev"), F.col("parts")).cast("int").alias("part"))
    b = b.join(parts, "cur").select("cur", "nxt", "w", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    t = a.repartition(tasks, "cur", "part").join(b.repartition(tasks, "cur", "part").hint("merge"), ["cur", "part"])
    bias = F.when(F.col("nxt") == F.col("prev"), F.lit(1.0 / p)).when(F.array_contains("near", F.col("nxt")), F.lit(1.0)).otherwise(rest)
    return t.select("prev", "cur", "nxt", (F.col("w") * bias / F.col("s")).alias("prob"))


def node2vec_walks(edges: DataFrame, starts: DataFrame, length: int, p: float, q: float, seed: int) -> DataFrame:
    """(walk_id, step, id): the first step uniform, later ones by `node2vec_probabilities` of the walk's own states.

    Only the transitions of the states that walks are in are formed, step by step.
    """
    e = cut(E.coalesce(edges.select("src", "dst", "w")))
    first = random_walks(e, starts, 1, seed)
    state = first.filter("step = 0").select("walk_id", F.col("id").alias("prev")).join(
        first.filter("step = 1").select("walk_id", F.col("id").alias("cur")), "walk_id"
    )
    state = cut(state)
    out = first
    nxt = e.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w")
    known = e.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"), F.lit(True).alias("near"))
    for s in range(2, length + 1):
        t = state.join(nxt, "cur").join(known, ["prev", "nxt"], "left")
        bias = F.when(F.col("nxt") == F.col("prev"), F.lit(1.0 / p)).when(F.col("near"), F.lit(1.0)).otherwise(F.lit(1.0 / q))
        t = t.withColumn("m", F.col("w") * bias)
        # Exponential race: the smallest -ln(u) / m is a draw in proportion to m, as one min_by.
        race = -F.log(uniform(seed + s, F.col("walk_id"), F.col("nxt")) + F.lit(2.0**-53)) / F.col("m")
        drawn = t.groupBy("walk_id").agg(F.min_by("nxt", F.struct(race.alias("r"), F.col("nxt"))).alias("nxt"))
        state = cut(state.join(drawn, "walk_id", "left").select("walk_id", F.col("cur").alias("prev"), F.coalesce("nxt", "cur").alias("cur")))
        out = out.unionByName(state.select("walk_id", F.lit(s).alias("step"), F.col("cur").alias("id")))
    return out


def metapath_walks(edges: DataFrame, starts: DataFrame, relations: list[str], length: int, seed: int) -> DataFrame:
    """(walk_id, step, id): step s follows relation s mod len(relations); edges are (src, dst, rel).  A walk ends at a sink."""
    deg, e = _numbered(edges.select("rel", F.col("src").alias("id"), F.col("dst").alias("to")), ["rel", "id"])
    cur = starts.select("walk_id", "id")
    out = cur.select("walk_id", F.lit(0).alias("step"), "id")
    for s in range(1, length + 1):
        rel = relations[(s - 1) % len(relations)]
        at = cur.join(deg.filter(F.col("rel") == rel).drop("rel"), "id").withColumn("pos", pick(F.col("deg"), seed, F.col("walk_id"), F.lit(s)))
        cur = cut(at.join(e.filter(F.col("rel") == rel).drop("rel"), ["id", "pos"]).select("walk_id", F.col("to").alias("id")))
        out = out.unionByName(cur.select("walk_id", F.lit(s).alias("step"), "id"))
    return out


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The `n` rows of smallest `key` (unique values): dense ids over a range partition, no single task."""
    return with_dense_ids(df, key, "__p").filter(F.col("__p") < n).drop("__p")


def negative_edges(edges: DataFrame, n: int, n_src: int, n_dst: int, seed: int, loops: bool = False, rounds: int = 3) -> DataFrame:
    """(src, dst): `n` distinct pairs that are no edges, drawn by seed; fewer only if there are no more.

    Candidate j is the pair (u_j n_src, v_j n_dst) with u, v functions of (seed, j): generated,
    not crossed, first n * rounds and then, as long as some are lacking, twice as many.  From
    n_src * n_dst candidates on, what draws have left out is filled with the free pairs of smallest
    number (a graph that dense has few).  Ids are 0 .. n_src - 1 and 0 .. n_dst - 1.
    """
    spark = edges.sparkSession
    known = cut(edges.select("src", "dst").distinct())

    def free(c: DataFrame) -> DataFrame:
        c = c if loops else c.filter("src <> dst")
        return c.groupBy("src", "dst").agg(F.min("j").alias("j")).join(known, ["src", "dst"], "left_anti")

    count = max(1, n * rounds)
    while True:
        j = spark.range(0, count).withColumnRenamed("id", "j")
        drawn = cut(free(j.select("j", pick(F.lit(n_src), seed, F.lit("s"), F.col("j")).alias("src"), pick(F.lit(n_dst), seed, F.lit("d"), F.col("j")).alias("dst"))))
        if drawn.count() >= n:
            break
        if count >= n_src * n_dst:
            number = spark.range(0, n_src * n_dst).select((F.col("id") + count).alias("j"), F.floor(F.col("id") / n_dst).alias("src"), (F.col("id") % n_dst).alias("dst"))
            drawn = drawn.unionByName(free(number).join(drawn.select("src", "dst"), ["src", "dst"], "left_anti"))
            break
        count *= 2
    return first_rows(drawn, "j", n).select("src", "dst")


def keep_edges(edges: DataFrame, drop: float, seed: int, keys: list[str]) -> DataFrame:
    """Each edge stays with probability 1 - drop, independently, by (seed, keys)."""
    return edges.filter(uniform(seed, *[F.col(k) for k in keys]) >= F.lit(drop))


def drop_features(nodes: DataFrame, width: int, drop: float, seed: int, x: str = "x") -> DataFrame:
    """Whole components are zeroed with probability `drop`, the same for all rows."""
    kept = F.array(*[F.when(uniform(seed, F.lit(i)) >= F.lit(drop), 1.0).otherwise(0.0) for i in range(width)])
    return nodes.withColumn(x, F.zip_with(F.col(x), kept, lambda a, b: a * b))


def saint_node_sample(edges: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, induced edges): the sources of `n` edges drawn by digest of `eid`."""
    drawn = first_rows(edges.withColumn("__k", F.struct(order_key(seed, F.col("eid")).alias("h"), "eid")), "__k", n)
    nodes = cut(drawn.select(F.col("src").alias("id")).distinct())
    return nodes, induced(edges, nodes)


def saint_walk_sample(edges: DataFrame, roots: DataFrame, length: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, induced edges): all nodes on walks from `roots` (walk_id, id)."""
    nodes = cut(random_walks(edges, roots, length, seed).select("id").distinct())
    return nodes, induced(edges, nodes)


def weighted_sample(df: DataFrame, group: list[str], key: str, weight: str, k: int, seed: int) -> DataFrame:
    """k rows of each group without replacement, in proportion to weight: the smallest -ln(u) / w."""
    race = -F.log(uniform(seed, *[F.col(g) for g in group], F.col(key)) + F.lit(2.0**-53)) / F.col(weight)
    r = F.row_number().over(Window.partitionBy(*group).orderBy(race, key))
    return df.filter(F.col(weight) > 0).withColumn("__r", r).filter(F.col("__r") <= k).drop("__r")


def block_model(spark, sizes: list[int], probs: list[list[float]], seed: int) -> DataFrame:
    """(src, dst), src < dst: edges between blocks i, j drawn with probability probs[i][j].

    For each pair of blocks as many pairs as are expected are drawn by number, never enumerated;
    those drawn twice are one edge (`draws.block_pairs`).
    """
    blocks, starts = [], [sum(sizes[:i]) for i in range(len(sizes))]
    for i, a in enumerate(sizes):
        for j in range(i, len(sizes)):
            pairs = a * (a - 1) // 2 if i == j else a * sizes[j]
            n = round(pairs * probs[i][j])
            if n:
                blocks.append((i, j, pairs, n, sizes[j], starts[i], starts[j]))
    return block_pairs(spark, blocks, seed)


def link_batches(pairs: DataFrame, size: int, seed: int, negatives: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((batch_id, src, dst, label), seeds (batch_id, id)) of seed edges (src, dst) in shuffled batches.

    Without `negatives` labels are 1; with them (src, dst) they join with label 0 - each a pair of its
    own - and are shuffled in.
    """
    rows = pairs.select("src", "dst", F.lit(1).alias("label"))
    if negatives is not None:
        rows = rows.unionByName(negatives.select("src", "dst", F.lit(0).alias("label")))
    k = F.struct(order_key(seed, F.col("src"), F.col("dst")).alias("h"), "src", "dst", "label")
    rows = with_dense_ids(rows.distinct().withColumn("__k", k), "__k", "pos")
    rows = cut(rows.select(F.floor(F.col("pos") / size).cast("bigint").alias("batch_id"), "src", "dst", "label"))
    ends = rows.select("batch_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return rows, ends


def drop_walked(edges: DataFrame, roots: DataFrame, length: int, seed: int) -> DataFrame:
    """Edges that no walk from `roots` (walk_id, id) went along."""
    w = random_walks(edges, roots, length, seed)
    a, b = w.select("walk_id", "step", F.col("id").alias("src")), w.select("walk_id", (F.col("step") - 1).alias("step"), F.col("id").alias("dst"))
    return edges.join(a.join(b, ["walk_id", "step"]).select("src", "dst").distinct(), ["src", "dst"], "left_anti")
