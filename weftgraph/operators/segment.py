"""Grouped (segment) reductions: the aggregates of this engine.

All reductions are mergeable, so Spark combines them before the shuffle and a hot segment
costs one row a task.  Segments without rows come out as 0 where a universe is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import vec

REDUCERS = {
    "sum": F.sum,
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "mul": F.product,
    "count": lambda c: F.count(c),
}


def zero_fill(reduced: DataFrame, universe: DataFrame, seg: str, columns: list[str]) -> DataFrame:
    """A row for each id of `universe` (column `seg`); what is missing is 0."""
    return universe.select(seg).join(reduced, seg, "left").fillna(0, columns)


def segment_reduce(df: DataFrame, seg: str, value: str | Column, how: str, universe: DataFrame | None = None, out: str = "value") -> DataFrame:
    """(seg, out).  Rows with a null segment are left out, null values are ignored.

    An empty segment of `universe` gives 0, for every reduction.
    """
    value = F.col(value) if isinstance(value, str) else value
    r = df.filter(F.col(seg).isNotNull()).groupBy(seg).agg(REDUCERS[how](value).alias(out))
    return r if universe is None else zero_fill(r, universe, seg, [out])


def segment_div(df: DataFrame, seg: str, value: str, order: str, out: str = "value") -> DataFrame:
    """Ordered left fold of divisions: first value over all later ones.

    Dividing by each in turn equals dividing by their product, so only the first value needs
    the order and no list of a segment is ever built.  A later 0 gives null.
    """
    first = F.min_by(F.col(value), F.col(order))
    product = F.product(value)
    return df.groupBy(seg).agg((first / F.nullif(product / F.nullif(first, F.lit(0.0)), F.lit(0.0))).alias(out))


def segment_arg(df: DataFrame, seg: str, value: str, arg: str, how: str = "max") -> DataFrame:
    """(seg, value, arg): the extreme and the row that has it (the smallest `arg` of equals)."""
    if how == "max":
        best = F.max(F.struct(F.col(value).alias("v"), (-F.col(arg)).alias("a")))
        return df.groupBy(seg).agg(best.alias("m")).select(seg, F.col("m.v").alias("value"), (-F.col("m.a")).alias("arg"))
    best = F.min(F.struct(F.col(value).alias("v"), F.col(arg).alias("a")))
    return df.groupBy(seg).agg(best.alias("m")).select(seg, F.col("m.v").alias("value"), F.col("m.a").alias("arg"))


def segment_vectors(df: DataFrame, seg: str, x: str, width: int, how: str, universe: DataFrame | None = None, out: str = "x") -> DataFrame:
    """Vectors reduced component by component; empty segments give zeros."""
    r = df.filter(F.col(seg).isNotNull()).groupBy(seg).agg(vec.reduce_vectors(x, width, how).alias(out))
    if universe is None:
        return r
    return universe.select(seg).join(r, seg, "left").withColumn(out, F.coalesce(out, vec.zeros(width)))


def segment_softmax(df: DataFrame, seg: str | list[str], value: str, out: str = "alpha", eps: float = 1e-16) -> DataFrame:
    """exp(x - max of the segment) over (their sum + eps): one row out for each row in.

    Two aggregates and a join, not a window: a window would put a hot segment into one
    task, while the join's hot keys are split by the adaptive skew join.
    """
    keys = [seg] if isinstance(seg, str) else seg
    top = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    e = df.join(top, keys).withColumn("__e", F.exp(F.col(value) - F.col("__top"))).drop("__top")
    sums = e.groupBy(*keys).agg(F.sum("__e").alias("__s"))
    return e.join(sums, keys).withColumn(out, F.col("__e") / (F.col("__s") + F.lit(eps))).drop("__e", "__s")


def restricted_softmax(df: DataFrame, seg: str, value: str, margin: float = 0.0, out: str = "alpha") -> DataFrame:
    """Softmax with exp(margin - max) added to the denominator and the max clipped at 0 from below."""
    top = df.groupBy(seg).agg(F.greatest(F.max(value), F.lit(0.0)).alias("__top"))
    e = df.join(top, seg).withColumn("__e", F.exp(F.col(value) - F.col("__top")))
    sums = e.groupBy(seg).agg((F.sum("__e") + F.exp(F.lit(margin) - F.max("__top"))).alias("__s"))
    return e.join(sums, seg).withColumn(out, F.col("__e") / F.col("__s")).drop("__e", "__s", "__top")


def masked_softmax(df: DataFrame, seg: str, value: str, mask: str, out: str = "alpha") -> DataFrame:
    """Softmax over the rows whose mask holds; masked rows get 0, a fully masked segment its input."""
    some = df.groupBy(seg).agg(F.max(F.col(mask).cast("int")).alias("__any"), F.max(F.when(F.col(mask), F.col(value))).alias("__top"))
    e = df.join(some, seg).withColumn("__e", F.when(F.col(mask), F.exp(F.col(value) - F.col("__top"))).otherwise(0.0))
    sums = e.groupBy(seg).agg(F.sum("__e").alias("__s"))
    share = F.when(F.col("__any") == 0, F.col(value)).otherwise(F.col("__e") / F.col("__s"))
    return e.join(sums, seg).withColumn(out, share).drop("__e", "__s", "__top", "__any")


def degree(edges: DataFrame, side: str, universe: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(id, deg) by `side` (src or dst): rows, or the sum of `weight`; 0 for ids without edges."""
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    d = edges.filter(F.col(side).isNotNull()).groupBy(F.col(side).alias("id")).agg(agg.alias("deg"))
    return d if universe is None else universe.select("id").join(d, "id", "left").fillna(0, ["deg"])


def unique(df: DataFrame, value: str) -> DataFrame:
    """(value, inverse, count): distinct values, their 0-based rank and how often they occur."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("count"))
    return with_dense_ids(counts, value, "inverse")


def with_dense_ids(distinct: DataFrame, key: str, out: str) -> DataFrame:
    """0-based dense ranks of a table of distinct keys, without gathering them into one task.

    Rows are range-partitioned by key; each partition numbers its own rows and starts where
    the counts of the partitions before it end (one row a partition).
    """
    from weftgraph.core.session import cut

    spread = cut(distinct.repartitionByRange(key).withColumn("__pid", F.spark_partition_id()))
    sizes = spread.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__pid", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__pid").orderBy(key)) - 1
    return (
        spread.withColumn("__own", own).join(F.broadcast(starts), "__pid")  # one row a partition
        .withColumn(out, (F.col("__own") + F.col("__start")).cast("bigint")).drop("__pid", "__own", "__start")
    )


def running_total(df: DataFrame, key: str, value: str, out: str = "ptr") -> DataFrame:
    """Exclusive prefix sums in the order of `key`, by partition totals as in `with_dense_ids`."""
    from weftgraph.core.session import cut

    spread = cut(df.repartitionByRange(key).withColumn("__pid", F.spark_partition_id()))
    sizes = spread.groupBy("__pid").agg(F.sum(value).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__pid", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.sum(value).over(Window.partitionBy("__pid").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return spread.withColumn("__own", own).join(F.broadcast(starts), "__pid").withColumn(out, (F.col("__own") + F.col("__start")).cast("bigint")).drop(
        "__pid", "__own", "__start"
    )


def ind2ptr(edges: DataFrame, side: str, universe: DataFrame) -> DataFrame:
    """(id, ptr, n): CSR pointers - where the edges of each id start in the order of ids."""
    counts = degree(edges, side, universe).withColumnRenamed("deg", "n")
    return running_total(counts, "id", "n")


BLOCK = 65_536


def _repeated(df: DataFrame, count: str) -> DataFrame:
    """Each row `count` times, with column `__i` from 0: by blocks, so no array is longer than BLOCK."""
    n = F.col(count).cast("bigint")
    d = df.filter(n > 0).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / BLOCK))))
    last = F.least(n - F.col("__b") * BLOCK, F.lit(BLOCK).cast("bigint")) - 1
    return d.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("__i", F.col("__b") * BLOCK + F.col("__o")).drop("__b", "__o")


def ptr2ind(pointers: DataFrame) -> DataFrame:
    """(id, pos): one row for each position that a pointer table (id, ptr, n) covers."""
    return _repeated(pointers.select("id", "ptr", "n"), "n").select("id", (F.col("ptr") + F.col("__i")).alias("pos"))


def repeat_interleave(df: DataFrame, value: str, count: str) -> DataFrame:
    """Each row's value `count` times."""
    return _repeated(df.select(value, F.col(count).alias("__n")), "__n").select(value)


def bincount(df: DataFrame, batch: str, code: str) -> DataFrame:
    return df.groupBy(batch, code).agg(F.count(F.lit(1)).alias("n"))
