"""Statistics of an array column, from built-in functions. Arrays are small (a capture); rows are many."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def draw(seed: int, name: str, key: Column) -> Column:
    """An integer from 0 to 2^32 - 1, fixed by seed, name and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{name}|"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation in an ascending array; null if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.get(ordered, low) + (F.get(ordered, high) - F.get(ordered, low)) * (at - low)


def std(x: Column) -> Column:
    """Population standard deviation."""
    return let(mean(x), lambda m: F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(x))))


def steps(x: Column) -> Column:
    """Absolute differences of neighbours."""
    return F.when(F.size(x) < 2, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.abs(F.get(x, i) - F.get(x, i - 1))))


def matching(x: Column, test) -> Column:
    return F.size(F.filter(x, test))
