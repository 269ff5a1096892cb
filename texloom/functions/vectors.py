"""Column functions on vectors. Everything is computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(v: Column, length: Column) -> Column:
    """The vector over ``length``; put ``norm`` into a column of its own first, or it is computed anew for each number. A zero vector stays."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def rounded(v: Column, digits: int) -> Column:
    """The numbers of a vector rounded, halves away from 0. What is rounded to 0 keeps its sign, as in SQL on doubles; ``round`` alone drops it."""

    def one(x: Column) -> Column:
        r = F.round(x.cast("double"), digits)
        return F.when(r == 0, x.cast("double") * F.lit(0.0)).otherwise(r)

    return F.transform(v, one)


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm_a * norm_b)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def tanh(c: Column) -> Column:
    return F.tanh(c)


def softmax(v: Column) -> Column:
    """The softmax of an array of numbers."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where that isn't defined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)
