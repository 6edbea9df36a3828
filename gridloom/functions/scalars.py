"""Column functions on points and grid indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Sum of squared differences of two points given by their coordinates."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared_distance(a, b).cast("double"))


def array_distance(a: Column, b: Column) -> Column:
    """L2 distance of two coordinate arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def grid_position(index: Column, sides: Sequence[int]) -> list[Column]:
    """Row-major index -> position on each axis (last axis fastest)."""
    out, step = [], 1
    for side in reversed(sides):
        out.append((F.floor(index / F.lit(step)) % F.lit(side)).cast("long"))
        step *= side
    return out[::-1]


def grid_index(position: Sequence[Column], sides: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for p, side in zip(position, sides, strict=True):
        out = out * side + p
    return out.cast("long")


def cell_l1(a: Column, b: Column, side: int) -> Column:
    """L1 distance of two cells of a side x side grid."""
    p, q = grid_position(a, (side, side)), grid_position(b, (side, side))
    return F.abs(p[0] - q[0]) + F.abs(p[1] - q[1])


def cell_l2(a: Column, b: Column, side: int) -> Column:
    return distance(grid_position(a, (side, side)), grid_position(b, (side, side)))


def inside(point: Sequence[Column], low: Sequence, high: Sequence) -> Column:
    """Containment in a closed box."""
    out = F.lit(True)
    for x, lo, hi in zip(point, low, high, strict=True):
        out = out & (x >= lo) & (x <= hi)
    return out


def text_parts(s: Column, by: str = " ") -> Column:
    """Parts of a trimmed string between runs of a delimiter."""
    return F.split(F.trim(s), f"{by}+" if by == " " else by)


def box_distances(point: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> tuple[Column, Column]:
    """Least and greatest distance of a point to a box."""
    near, far = F.lit(0.0), F.lit(0.0)
    for x, lo, hi in zip(point, low, high, strict=True):
        d = F.greatest(lo - x, F.lit(0.0), x - hi)
        e = F.greatest(F.abs(x - lo), F.abs(x - hi))
        near, far = near + d * d, far + e * e
    return F.sqrt(near), F.sqrt(far)


def polar_distance(phi1: Column, r1: Column, phi2: Column, r2: Column) -> Column:
    """Distance of two points in polar coordinates, by the law of cosines."""
    return F.sqrt(F.greatest(F.lit(0.0), r1 * r1 + r2 * r2 - 2 * r1 * r2 * F.cos(phi1 - phi2)))


def polar_box_distances(phi: Column, r: Column, low: Sequence[Column], high: Sequence[Column]) -> tuple[Column, Column]:
    """Least and greatest distance of a polar point to the cell [low, high] of (angle, radius): extremes lie at a corner,
    at the query's own angle or its opposite, or where the cell's edge is perpendicular to the way to the point."""
    candidates = [polar_distance(phi, r, a, b) for a in (low[0], high[0]) for b in (low[1], high[1])]
    within = lambda x: (x >= low[0]) & (x <= high[0])
    for edge in (low[0], high[0]):
        foot = r * F.cos(phi - edge)
        candidates.append(F.when((foot >= low[1]) & (foot <= high[1]), polar_distance(phi, r, edge, foot)))
    turn = F.pmod(phi + F.lit(3.141592653589793), F.lit(2 * 3.141592653589793))
    for b in (low[1], high[1]):
        candidates.append(F.when(within(phi), polar_distance(phi, r, phi, b)))
        candidates.append(F.when(within(turn), polar_distance(phi, r, turn, b)))
    far = F.greatest(*candidates)
    own = within(phi) & (r >= low[1]) & (r <= high[1])
    return F.when(own, F.lit(0.0)).otherwise(F.least(*candidates)), far
