"""Column functions on ARRAY<DOUBLE> vectors, and aggregates of whole vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a norm is 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, s: Column | float) -> Column:
    s = F.lit(float(s)) if not isinstance(s, Column) else s
    return F.transform(a, lambda x: x * s)


def apply(a: Column, f) -> Column:
    return F.transform(a, f)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * F.lit(slope))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - F.lit(1.0))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def linear(x: Column, weight: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """x @ weight + bias for a literal weight (in x out): one dot product an output, in the JVM."""
    columns = list(zip(*weight))
    outs = [dot(x, vector(c)) for c in columns]
    if bias is not None:
        outs = [o + F.lit(float(b)) for o, b in zip(outs, bias)]
    return F.array(*outs)


def reduce_vectors(x: str | Column, width: int, how: str) -> Column:
    """Aggregate of vectors, component by component: one mergeable aggregate a component,
    so partial sums are made before the shuffle.  how: sum, mean, max or min."""
    x = F.col(x) if isinstance(x, str) else x
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return F.array(*[f(F.get(x, F.lit(i))) for i in range(width)])


def zeros(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width)


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("double"))
