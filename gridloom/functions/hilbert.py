"""Hilbert curve indices of 2-D and 3-D points, as unrolled column expressions, and their inverse.

The index is an integer of ``dims`` bits a level; divided by 2**(dims * depth) it lies in [0, 1). Points are scaled by
a bounding box first; an axis of no extent scales to 0."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The curve's orientation. Key: which half (0 low, 1 high) of each axis the point is in; value: the digit,
# then each new axis as (old axis, factor, offset).
PLANE = {
    (0, 0): (0, ((1, 2, 0), (0, 2, 0))),
    (0, 1): (1, ((0, 2, 0), (1, 2, -1))),
    (1, 1): (2, ((0, 2, -1), (1, 2, -1))),
    (1, 0): (3, ((1, -2, 1), (0, -2, 2))),
}
SPACE = {
    (0, 0, 0): (0, ((2, 2, 0), (0, 2, 0), (1, 2, 0))),
    (0, 1, 0): (1, ((1, 2, -1), (2, 2, 0), (0, 2, 0))),
    (1, 1, 0): (2, ((1, 2, -1), (2, 2, 0), (0, 2, -1))),
    (1, 0, 0): (3, ((0, -2, 2), (1, -2, 1), (2, 2, 0))),
    (1, 0, 1): (4, ((0, -2, 2), (1, -2, 1), (2, 2, -1))),
    (1, 1, 1): (5, ((1, 2, -1), (2, -2, 2), (0, -2, 2))),
    (0, 1, 1): (6, ((1, 2, -1), (2, -2, 2), (0, -2, 1))),
    (0, 0, 1): (7, ((2, -2, 2), (0, 2, 0), (1, -2, 1))),
}


def cells(dims: int) -> dict:
    if dims not in (2, 3):
        raise ValueError("the curve is defined for 2 and 3 dimensions")
    return PLANE if dims == 2 else SPACE


def deepest(dims: int) -> int:
    """Levels that a signed 64-bit index holds."""
    return 63 // dims


def bounds(points: DataFrame, axes: Sequence[str]) -> tuple[list[float], list[float]]:
    """Least and greatest coordinate of each axis."""
    row = points.agg(*[F.min(a).cast("double") for a in axes], *[F.max(a).cast("double") for a in axes]).first()
    n = len(axes)
    return [x if x is not None else 0.0 for x in row[:n]], [x if x is not None else 0.0 for x in row[n:]]


def scaled(axis: Column, low: float, high: float) -> Column:
    return (axis.cast("double") - F.lit(float(low))) / F.lit(float(high - low)) if high > low else F.lit(0.0)


def with_hilbert(points: DataFrame, axes: Sequence[str], depth: int, box: tuple[Sequence[float], Sequence[float]] | None = None, out: str = "h") -> DataFrame:
    """points with the long column ``out``. Without a box, one aggregate finds it; a point outside the box raises."""
    dims, table = len(axes), cells(len(axes))
    depth = min(depth, deepest(dims))
    low, high = box or bounds(points, axes)
    names = [f"__{out}_{i}" for i in range(dims)]
    inside = [F.col(n).between(0.0, 1.0) for n in names]
    ok = inside[0]
    for x in inside[1:]:
        ok = ok & x
    now = points.select("*", F.lit(0).cast("long").alias(out), *[scaled(F.col(a), lo, hi).alias(n) for a, n, lo, hi in zip(axes, names, low, high, strict=True)])
    if box is not None:
        now = now.withColumn(out, F.when(ok, F.col(out)).otherwise(F.raise_error(F.lit("a point lies outside the box")).cast("long")))
    keep = [c for c in points.columns]
    for _ in range(depth):
        digit, axis = None, [None] * dims
        for half, (d, moves) in list(table.items()):
            here = None
            for n, h in zip(names, half, strict=True):
                c = (F.col(n) >= 0.5) if h else (F.col(n) < 0.5)
                here = c if here is None else here & c
            digit = F.when(here, F.lit(d)) if digit is None else digit.when(here, F.lit(d))
            for i, (a, f, o) in enumerate(moves):
                e = F.col(names[a]) * float(f) + float(o)
                axis[i] = F.when(here, e) if axis[i] is None else axis[i].when(here, e)
        now = now.select(*keep, (F.shiftleft(F.col(out), dims) + digit).alias(out), *[a.alias(n) for a, n in zip(axis, names, strict=True)])
    return now.drop(*names)


def fraction(index: Column, dims: int, depth: int) -> Column:
    """The index in [0, 1)."""
    return index.cast("double") / F.lit(float(1 << (dims * min(depth, deepest(dims)))))


def inverse(fractions: np.ndarray, dims: int, depth: int, box: tuple[Sequence[float], Sequence[float]] | None = None) -> np.ndarray:
    """Points (n x dims) of indices in [0, 1], for the few centres a driver holds; depth 0 gives the origin."""
    f = np.asarray(fractions, dtype=float)
    if ((f < 0) | (f > 1)).any():
        raise ValueError("curve indices lie between 0 and 1")
    base = 1 << dims
    digits = []
    for _ in range(depth):
        q = np.minimum(np.floor(f * base), base - 1)
        digits.append(q.astype(int))
        f = f * base - q
    back = {d: (half, moves) for half, (d, moves) in cells(dims).items()}
    p = np.zeros((len(np.atleast_1d(fractions)), dims))
    for q in reversed(digits):
        new = np.zeros_like(p)
        for d, (_, moves) in back.items():
            rows = q == d
            for i, (a, factor, offset) in enumerate(moves):
                new[rows, a] = (p[rows, i] - offset) / factor
        p = new
    if box is not None:
        low, high = (np.asarray(b, dtype=float) for b in box)
        p = low + p * (high - low)
    return p


def inverse_column(fraction_column: Column, dims: int, depth: int) -> list[Column]:
    """The point of an index column, as one double column for each axis, by folding its digits from last to first."""
    base = float(1 << dims)
    whole = F.least(F.floor(fraction_column * F.lit(base**depth)), F.lit(int(base**depth) - 1)).cast("long")
    p: list[Column] = [F.lit(0.0)] * dims
    back = {d: moves for d, moves in cells(dims).values()}
    state = F.struct(*[F.lit(0.0).alias(f"p{i}") for i in range(dims)])

    def step(s: Column, level: Column) -> Column:
        q = F.pmod(F.call_function("shiftright", whole, level * dims), F.lit(1 << dims))
        new = [None] * dims
        for d, moves in back.items():
            for i, (a, factor, offset) in enumerate(moves):
                e = (s[f"p{i}"] - float(offset)) / float(factor)
                new[a] = F.when(q == d, e) if new[a] is None else new[a].when(q == d, e)
        return F.struct(*[n.alias(f"p{i}") for i, n in enumerate(new)])

    folded = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), state, step) if depth else state
    return [folded[f"p{i}"] for i in range(dims)] if depth else p
