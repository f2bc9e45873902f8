"""Seeded randomness that any engine can repeat: md5 of a seed and the row's own key.

Never `rand()`: its values depend on partitions and change when a lost task is rerun.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *keys: Column) -> Column:
    """A hexadecimal digest to order by; ties are to be broken by the key itself."""
    text = [F.lit(f"{seed}")] + [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *text))


def uniform(seed: int, *keys: Column) -> Column:
    """A DOUBLE in [0, 1) from the first 52 bits of the digest."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def pick(n: Column, seed: int, *keys: Column) -> Column:
    """An integer in [0, n)."""
    return F.floor(uniform(seed, *keys) * n).cast("bigint")
