"""Per-key results when a few keys hold most records (problem 5).

Value-frequency compression: rows are first grouped by (key, value), which spreads a
hot key over as many groups as it has values and shrinks it to its distinct values on
the map side already; the second grouping, by key, sees weighted values only and is
again combined before its shuffle.  Distinct counts and modes follow from the weighted
values exactly.  Exact percentiles need the weighted values of a key in order: they are
range-partitioned by (key, value), so that even one key's values spread over tasks, and
each (partition, key) piece gets the weight that lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import cut


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., value, n): how often each value occurs with each key; null values are kept."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def _profile(weighted: DataFrame, keys: list[str], value: str) -> DataFrame:
    v, n = F.col(value), F.col("n")
    known = v.isNotNull()
    return weighted.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(known, n).otherwise(0)).alias("n_values"),
        F.sum(F.when(known, 1).otherwise(0)).cast("bigint").alias("n_distinct"),
        F.sum(v * n).alias("total"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        # The most frequent value, the smallest of equals.
        F.max(F.when(known, F.struct(n.alias("n"), (-v).alias("neg")))).alias("top"),
    ).withColumn("mode", -F.col("top.neg")).withColumn("mode_count", F.col("top.n")).drop("top")


def percentiles(weighted: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys..., one column per point): the smallest value whose cumulative weight reaches the point.

    `weighted` is the output of `compress`; null values are left out.  No task holds more
    of a key than its share of the range partitions.
    """
    known = weighted.filter(F.col(value).isNotNull())
    spread = cut(known.repartitionByRange(*keys, value).withColumn("pid", F.spark_partition_id()))
    pieces = spread.groupBy(*keys, "pid").agg(F.sum("n").alias("piece"))
    by_key = Window.partitionBy(*keys).orderBy("pid")
    # At most one row a partition for any key: bounded however hot the key.
    pieces = pieces.withColumn("before", F.sum("piece").over(by_key) - F.col("piece")).withColumn(
        "n_all", F.sum("piece").over(Window.partitionBy(*keys))
    )
    placed = spread.join(pieces, [*keys, "pid"])
    reach = F.col("before") + F.sum("n").over(
        Window.partitionBy(*keys, "pid").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = placed.withColumn("reach", reach)

    def at(p: float) -> Column:
        return F.min(F.when(F.col("reach") >= F.col("n_all") * F.lit(p), F.col(value)))

    return placed.groupBy(*keys).agg(*[at(p).alias(name) for name, p in points.items()])


def profile_by_key(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float] | None = None
) -> DataFrame:
    """Per key: n_rows, n_values, n_distinct, total, low, high, mode, mode_count, and percentiles.

    Defined results: rows with a null in `keys` form no key and are left out; a null or NaN
    value counts in n_rows only; a key without values has nulls in all value columns and 0
    in n_values and n_distinct; of equally frequent values the smallest is the mode; empty
    input gives no rows.  `value` must be numeric.  `points` maps column names to
    fractions in (0, 1].  Other columns are ignored.
    """
    v = F.col(value).cast("double")
    own = [f"__k{i}" for i in range(len(keys))]  # keys may have any name
    have = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.when(~F.isnan(v), v).alias("__v"))
    weighted = compress(have.na.drop(subset=own), own, "__v")
    if points:
        weighted = cut(weighted)
    out = _profile(weighted, own, "__v")
    if points:
        out = out.join(percentiles(weighted, own, "__v", points), own, "left")
    return out.withColumnsRenamed(dict(zip(own, keys)))


def both_sides(edges: DataFrame, src: str, dst: str, value: Column | None = None) -> DataFrame:
    """(side, node_id, value): each edge once for either end, in one pass over the table.

    Without `value` it is the other end (exact as a double up to 2^53).
    """
    s, d = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    end = lambda side, own, other: F.struct(F.lit(side).alias("side"), own.alias("node_id"), (other if value is None else value).cast("double").alias("value"))
    return edges.select(F.explode(F.array(end("src", s, d), end("dst", d, s))).alias("e")).select("e.side", "e.node_id", "e.value")


def hot_keys(profile: DataFrame, n_rows: int, share: float = 0.02) -> DataFrame:
    """Keys of `profile` that hold at least `share` of all `n_rows` rows of their table."""
    return profile.filter(F.col("n_rows") >= F.lit(share * n_rows))
