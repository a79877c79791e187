"""Column functions on vectors (arrays of doubles)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_active(v: Column) -> Column:
    """Strictly positive; NaN, which Spark orders above all numbers, is not."""
    return (v > 0) & ~F.isnan(v)


def binarise(x: Column | str) -> Column:
    """1 where a component is active, else 0."""
    return F.transform(_col(x), lambda v: F.when(is_active(v), 1.0).otherwise(0.0))


def bipolar(x: Column | str) -> Column:
    """2v - 1: bits become -1 and 1, and the half that stands for an absent feature becomes 0."""
    return F.transform(_col(x), lambda v: 2.0 * v - 1.0)


def over(x: Column | str, threshold: float) -> Column:
    """1 where a component is strictly above the threshold, else 0."""
    return F.transform(_col(x), lambda v: F.when(v > threshold, 1.0).otherwise(0.0))


def total(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: a * b))


def squared_distance(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: (a - b) * (a - b)))


def minkowski(x: Column | str, y: Column | str, k: float = 2.0) -> Column:
    """Sum of |difference| ** k; its k-th root only if k is at least 1. Euclidean for k = 2."""
    if k == 2:
        return F.sqrt(squared_distance(x, y))
    power = total(F.zip_with(_col(x), _col(y), lambda a, b: F.pow(F.abs(a - b), F.lit(float(k)))))
    return F.pow(power, F.lit(1.0 / k)) if k > 1 else power


def mismatches(x: Column | str, y: Column | str) -> Column:
    """Number of components that differ."""
    return F.size(F.filter(F.zip_with(_col(x), _col(y), lambda a, b: a != b), lambda d: d))


def hamming(x: Column | str, y: Column | str) -> Column:
    """Share of components that differ; null for empty vectors."""
    return F.try_divide(mismatches(x, y).cast("double"), F.size(_col(x)))


def half_added(x: Column | str, y: Column | str) -> Column:
    """x + y / 2."""
    return F.zip_with(_col(x), _col(y), lambda a, b: a + b / 2.0)


def pick(x: Column | str, positions: Sequence[int]) -> Column:
    """The components at 0-based positions, in the order given; one that is out of range is null."""
    return F.array(*(F.get(_col(x), F.lit(int(p))) for p in positions))


def element(x: Column | str, place: int | str) -> Column:
    """The component at a 1-based place; 'SECOND' is the second one or null; place 0 is the last."""
    if isinstance(place, str):
        if place.upper() != "SECOND":
            raise ValueError(f"no such place: {place}")
        return F.get(_col(x), F.lit(1))
    return F.element_at(_col(x), -1) if place == 0 else F.get(_col(x), F.lit(place - 1))


def argsort(x: Column | str, descending: bool = False) -> Column:
    """0-based positions in the order of the components. Descending is the reverse of ascending, ties included."""
    pairs = F.array_sort(F.transform(_col(x), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    order = F.transform(pairs, lambda p: p["i"])
    return F.reverse(order) if descending else order


def softmax(scores: Column | str, beta: float = 1.0) -> Column:
    """Softmax of beta * scores, with the largest score taken off first so that no exponential overflows."""
    s = _col(scores)
    raised = F.transform(s, lambda v: F.exp(F.lit(float(beta)) * (v - F.array_max(s))))
    return F.transform(raised, lambda v: v / total(raised))
