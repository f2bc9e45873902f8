"""Items that appear together (problem 6): pair counts and association scores.

Three exact prunings come before any pair is formed; `min_count` and `min_lift`
are part of the question, so no answer is lost:

* an item in fewer than `min_count` baskets is in no answer;
* n_ab <= min(n_a, n_b) and n_ab * n >= lift * n_a * n_b give n >= lift * max(n_a, n_b);
  an item in more than n / lift baskets is in no answer;
* a basket with one remaining item forms no pair.

Baskets of at most `block` items form their pairs in place; partial aggregation
combines them before the shuffle.  Larger baskets are never expanded.  Their
contribution comes from chunk-pair products: the incidence matrix of (item x large
basket) is cut into chunks of items, each pair of chunks is one unit of work, and
its product gives the number of shared large baskets for all pairs of the two
chunks.  Only pairs that can still reach `min_count` leave a unit:

* a pair that also meets in ordinary baskets is a *candidate*; its large-basket
  count is looked up by a join on membership, without any product;
* a pair that meets in large baskets only must reach `min_count` and the lift there,
  which the product decides inside the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import cut


def _products(min_count: int, min_lift: float, wide: int = 2048):
    """For applyInPandas: one pair of chunks -> pairs that pass on large baskets alone.

    The product is summed over blocks of `wide` baskets, so memory is bounded by the chunks and the
    rows of their items, not by the number of baskets.  Counts are kept in double precision.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = float(pdf["n"].iloc[0])
        same = bool(pdf["ci"].iloc[0] == pdf["cj"].iloc[0])
        _, basket = np.unique(pdf["basket"].to_numpy(), return_inverse=True)
        sides = []
        for side in (0, 1):
            rows = np.flatnonzero(pdf["side"].to_numpy() == side)
            rows = rows[np.argsort(basket[rows], kind="stable")]
            items, i = np.unique(pdf["item"].to_numpy()[rows], return_inverse=True)
            support = np.zeros(len(items))
            support[i] = pdf["n_item"].to_numpy()[rows]
            sides.append((items, i, basket[rows], support))
        if same:
            sides[1] = sides[0]
        (ia, xa, ba, na), (ib, xb, bb, nb) = sides
        out = []
        step = max(1, 4_000_000 // max(1, len(ib)))
        for at in range(0, len(ia), step):
            high = min(at + step, len(ia))
            shared = np.zeros((high - at, len(ib)))
            for low in range(0, int(basket.max()) + 1, wide):
                a, b = (slice(*np.searchsorted(x, [low, low + wide])) for x in (ba, bb))
                own = (xa[a] >= at) & (xa[a] < high)
                left, right = np.zeros((high - at, wide), np.float32), np.zeros((len(ib), wide), np.float32)
                left[xa[a][own] - at, ba[a][own] - low] = 1
                right[xb[b], bb[b] - low] = 1
                shared += left @ right.T
            hit = (shared >= min_count) & (shared * n >= min_lift * na[at:high, None] * nb[None, :])
            x, y = np.nonzero(hit)
            a, c, k = ia[at + x], ib[y], shared[x, y]
            keep = a < c if same else a != c
            out.append(pd.DataFrame({"item_a": np.minimum(a, c)[keep], "item_b": np.maximum(a, c)[keep], "n_ab": k[keep].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"item_a": [], "item_b": [], "n_ab": []}).astype("int64")

    return run


def cooccurrence(
    rows: DataFrame,
    basket_col: str,
    item_col: str,
    min_count: int = 5,
    min_lift: float = 3.0,
    block: int = 64,
    chunk: int = 4096,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi) with item_a < item_b.

    Rows with a null basket or item are left out; an item counts once in a basket
    however often it is repeated.  n: baskets, n_a / n_b: baskets with the item, n_ab:
    with both; lift = n_ab * n / (n_a * n_b); pmi = ln(lift).  Only pairs with
    n_ab >= min_count and lift >= min_lift come out, all of them.  Empty input: no rows.
    Other columns, whatever their names, are ignored.

    `block`: items above which a basket goes to chunk-pair products (below, its at most 2,016 pairs
    are formed in place); `chunk`, `chunk_rows`: items in a chunk, and rows of large baskets with
    them, on average (a product is summed in slices of 32 MB).
    """
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    member = cut(
        rows.select(F.col(basket_col).cast("bigint").alias("basket"), F.col(item_col).cast("bigint").alias("item"))
        .filter("basket is not null and item is not null")
        .distinct()
    )
    n = member.select("basket").distinct().count()
    support = member.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    usable = support.filter((F.col("n_item") >= min_count) & (F.col("n_item") * min_lift <= n))
    # Counts stay in a table: a frequent item's rows are split by the adaptive skew join.
    kept = member.join(usable.select("item", "n_item"), "item")
    sizes = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    kept = cut(kept.join(sizes, "basket"))

    small = kept.filter(F.col("size") <= block).select("basket", "item")
    # At most `block` items a group, so the list is bounded.
    pairs = (
        small.groupBy("basket")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select(F.posexplode("items").alias("p", "item_a"), "items")
        .select("item_a", F.explode(F.expr("slice(items, p + 2, size(items))")).alias("item_b"))
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("n_ab"))
    )
    large = kept.filter(F.col("size") > block)
    n_large = large.select("basket").distinct().count()
    if n_large:
        pairs = cut(pairs.filter(F.col("n_ab") + n_large >= min_count))
        # Candidates: add the large baskets that hold both, looked up from the item in fewer of them.
        held = large.groupBy("item").agg(F.count(F.lit(1)).alias("k"))
        of = lambda s: held.select(F.col("item").alias(f"item_{s}"), F.col("k").alias(f"k_{s}"))
        rarer = F.col("k_a") <= F.col("k_b")
        asked = pairs.select("item_a", "item_b").join(of("a"), "item_a").join(of("b"), "item_b").select(
            "item_a", "item_b", F.when(rarer, F.col("item_a")).otherwise(F.col("item_b")).alias("item"), F.when(rarer, F.col("item_b")).otherwise(F.col("item_a")).alias("other")
        )
        extra = (
            asked.join(large.select("item", "basket"), "item").join(large.select(F.col("item").alias("other"), "basket"), ["other", "basket"])
            .groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("more"))
        )
        pairs = pairs.join(extra, ["item_a", "item_b"], "left").select(
            "item_a", "item_b", (F.col("n_ab") + F.coalesce("more", F.lit(0))).alias("n_ab")
        )
        if n_large >= min_count:
            often = large.groupBy("item").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_count).select("item")
            often = cut(large.join(often, "item").select("basket", "item", "n_item"))
            n_items, n_rows = often.agg(F.count_distinct("item"), F.count(F.lit(1))).first()
            n_chunks = max(1, -(-n_items // chunk), -(-n_rows // chunk_rows))
            numbered = often.withColumn("c", F.pmod(F.xxhash64("item"), F.lit(n_chunks)).cast("int"))
            every = F.sequence(F.lit(0), F.lit(n_chunks - 1))
            left = numbered.select("*", F.explode(every).alias("o")).filter("c <= o").select(
                F.col("c").alias("ci"), F.col("o").alias("cj"), F.lit(0).alias("side"), "basket", "item", "n_item")
            right = numbered.select("*", F.explode(every).alias("o")).filter("o <= c").select(
                F.col("o").alias("ci"), F.col("c").alias("cj"), F.lit(1).alias("side"), "basket", "item", "n_item")
            products = (
                left.unionByName(right).withColumn("n", F.lit(n).cast("bigint"))
                .groupBy("ci", "cj")
                .applyInPandas(_products(min_count, min_lift), "item_a bigint, item_b bigint, n_ab bigint")
            )
            # A candidate's count is complete, a product's lacks ordinary baskets: the larger is right.
            pairs = pairs.unionByName(products).groupBy("item_a", "item_b").agg(F.max("n_ab").alias("n_ab"))
    side = lambda s: usable.select(F.col("item").alias(f"item_{s}"), F.col("n_item").alias(f"n_{s}"))
    scored = pairs.filter(F.col("n_ab") >= min_count).join(side("a"), "item_a").join(side("b"), "item_b")
    scored = scored.filter(F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab").cast("double") * n / (F.col("n_a").cast("double") * F.col("n_b"))
    return scored.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), lift.alias("lift"), F.log(lift).alias("pmi"))
