"""Column builders over array columns: native higher-order functions, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body of the values, each computed once a row, also where body uses them inside lambdas."""
    named = F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(named), lambda s: body(*[s.getField(f"_{i}") for i in range(len(values))])), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def number(x: float) -> str:
    x = float(x)
    return f"{x!r}D" if np.isfinite(x) else f"double('{'NaN' if np.isnan(x) else 'Infinity' if x > 0 else '-Infinity'}')"


def literal(values) -> Column:
    """A constant array of doubles, or array of arrays."""
    a = np.asarray(values, float)
    if a.ndim == 2:
        return F.expr("array(" + ",".join(f"array({','.join(map(number, row))})" for row in a) + ")")
    return F.expr(f"array({','.join(map(number, a))})")


def places(values) -> Column:
    """A constant array of ints."""
    return F.expr(f"array({','.join(str(int(x)) for x in values)})") if len(values) else F.expr("cast(array() as array<int>)")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return safe_div(total(v), F.size(v).cast("double"))


def square_sum(v: Column, around: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - around) * (x - around))


def std(v: Column) -> Column:
    """Population standard deviation."""
    return let(lambda v, m: F.sqrt(square_sum(v, m) / F.size(v)), v, mean(v))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division of doubles, which ANSI mode would refuse by zero."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def gather(v: Column, at: Column) -> Column:
    """v's elements at places that start from 0."""
    return let(lambda v: F.transform(at, lambda p: F.get(v, p)), v)


def smallest(v: Column) -> Column:
    """numpy's min: NaN if there is any."""
    return let(lambda v: F.when(F.exists(v, F.isnan), F.lit(float("nan"))).otherwise(F.array_min(v)), v)


def quantile(s: Column, n: Column, q: float) -> Column:
    """Linear interpolation in a sorted array of n elements."""
    h = (n - 1).cast("double") * q
    low = F.floor(h).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, n - 1))
    return a + (h - low) * (b - a)


def percentile(v: Column, q: float) -> Column:
    return let(lambda s: quantile(s, F.size(s), q), F.array_sort(v))


def rank_baseline(v: Column, window: int, percent: float) -> Column:
    """For each place the element of a fixed rank in the window around it, whose ends repeat the first and last."""
    rank = window - 1 if percent == 100 else int(window * percent / 100)

    def body(v):
        n = F.size(v)
        around = lambda i: F.transform(F.sequence(i - window // 2, i - window // 2 + window - 1), lambda j: F.get(v, F.least(F.greatest(j, F.lit(0)), n - 1)))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.array_sort(around(i)), F.lit(rank)))

    return let(body, v)


def exact_baseline(v: Column, window: int, percent: float) -> Column:
    """For each place the interpolated percentile of those up to window // 2 away on either side."""
    half = window // 2

    def body(v):
        n = F.size(v)

        def at(i):
            low = F.greatest(i - half, F.lit(0))
            return percentile(F.slice(v, low + 1, F.least(i + half + 1, n) - low), percent / 100)

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return let(body, v)


def correlation(v: Column, signal: np.ndarray) -> Column:
    s = np.asarray(signal, float) - np.mean(signal)
    norm = float(np.sqrt((s**2).sum()))
    return let(lambda v, m: safe_div(dot(v, literal(s)), F.sqrt(square_sum(v, m)) * norm), v, mean(v))


def convolution(v: Column, n: int, signal: np.ndarray, mode: str) -> Column:
    s = np.asarray(signal, float)
    m = len(s)
    low, high = {"full": (0, n + m - 1), "same": ((min(n, m) - 1) // 2, (min(n, m) - 1) // 2 + max(n, m)), "valid": (min(n, m) - 1, max(n, m))}[mode]

    def body(v, s):
        def at(t):
            k = F.sequence(F.greatest(F.lit(0), t - (n - 1)), F.least(t, F.lit(m - 1)))
            return F.aggregate(k, F.lit(0.0), lambda a, k: a + F.get(s, k) * F.get(v, t - k))

        return F.transform(F.sequence(F.lit(low), F.lit(high - 1)), at)

    return let(body, v, literal(s))


def coordinates(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    """Row-major coordinates of a flat place."""
    out, step = [], int(np.prod(shape))
    for n in shape:
        step //= n
        out.append(F.pmod(F.floor(flat / step), F.lit(n)).cast("int"))
    return out


def gather_nd(v: Column, shape: tuple[int, ...], at: list) -> Column:
    """Elements of a row-major value at the product of places along each axis."""
    out = tuple(len(a) for a in at)
    steps = [int(np.prod(shape[i + 1 :])) for i in range(len(shape))]

    def body(v, *axes):
        def place(o):
            c = coordinates(o, out)
            flat = F.lit(0)
            for k, step in enumerate(steps):
                flat = flat + F.get(axes[k], c[k]) * step
            return F.get(v, flat)

        return F.transform(F.sequence(F.lit(0), F.lit(int(np.prod(out)) - 1)), place)

    return let(body, v, *[places(a) for a in at])


def along(v: Column, shape: tuple[int, ...], axis: int, fn: Callable[[Column], Column]) -> Column:
    """fn of the elements along an axis, for every place of the others."""
    n, step = shape[axis], int(np.prod(shape[axis + 1 :]))
    size = int(np.prod(shape)) // n

    def at(v, o):
        first = F.floor(o / step).cast("int") * (step * n) + F.pmod(o, F.lit(step))
        return fn(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.get(v, first + t * step)))

    return let(lambda v: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda o: at(v, o)), v)
