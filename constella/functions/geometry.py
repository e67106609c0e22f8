"""Column functions of points, boxes and scores. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from constella import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance(r1, c1, r2, c2) -> Column:
    """Euclidean distance; whole-number coordinates give the same bits in every engine."""
    dr, dc = (_c(r1) - _c(r2)).cast("long"), (_c(c1) - _c(c2)).cast("long")
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def box_size(min_row, min_col, max_row, max_col) -> Column:
    """Product of the extents, without one added; the sum where an extent is 0."""
    dr, dc = F.abs(_c(max_row) - _c(min_row)), F.abs(_c(max_col) - _c(min_col))
    return F.when((dr == 0) | (dc == 0), dr + dc).otherwise(dr * dc)


def centre(low, high) -> Column:
    return F.floor((_c(low) + _c(high)) / F.lit(2.0)).cast("int")


def search_distance(d) -> Column:
    """Three quarters of the distance, rounded half to even, 50 at most."""
    return F.least(F.rint(F.lit(K.SEARCH_FACTOR) * _c(d)).cast("int"), F.lit(K.MAX_SEARCH_DISTANCE))


def neighbour_radius(median) -> Column:
    return F.greatest(F.lit(1), F.rint(_c(median) * K.RADIUS_FACTOR).cast("int"))


def deviation_score(d) -> Column:
    """100 for an exact hit, decaying with the distance; 0 for no match."""
    return F.coalesce(100 * F.exp(-_c(d) / K.DEVIATION_SCALE), F.lit(0.0))


def selectivity(best, second) -> Column:
    """Multiplier that falls as the chosen candidate loses its lead; 1 without a rival."""
    ratio = F.try_divide(_c(best), _c(second))
    return F.when(_c(second).isNull() | (_c(second) < K.TINY), F.lit(1.0)).otherwise(F.exp(-ratio / K.SELECTIVITY_SCALE))


def stretch_score(source, target) -> Column:
    """Agreement of a pair's distance in template and field; null for coincident template points."""
    return F.when(_c(source) >= K.TINY, F.exp(-F.abs(F.try_divide(_c(target), _c(source)) - 1) / K.GEOMETRY_SCALE))


def identifier(row, col, width) -> Column:
    """A pixel's number in row-major order; 0 where the image is empty."""
    return F.coalesce(_c(row) * _c(width) + _c(col), F.lit(0))


def is_red(r, g, b) -> Column:
    return (_c(r) >= K.RED[0]) & (_c(g) <= K.RED[1]) & (_c(b) <= K.RED[2])


def is_green(r, g, b) -> Column:
    return (_c(r) <= K.GREEN[0]) & (_c(g) >= K.GREEN[1]) & (_c(b) <= K.GREEN[2])


def is_black(*channels) -> Column:
    out = F.lit(True)
    for c in channels:
        out = out & (_c(c) < K.BLACK_BELOW)
    return out


def in_bounds(row, col, height, width) -> Column:
    return (_c(row) >= 0) & (_c(row) < _c(height)) & (_c(col) >= 0) & (_c(col) < _c(width))


def running_colour(pixels, seed) -> Column:
    """Order-dependent running average of whole channel values: each step is rint((so far + next) / 2)."""
    return F.aggregate(_c(pixels), _c(seed).cast("int"), lambda a, x: F.rint((a + x) / F.lit(2.0)).cast("int"))


def random_colour(seed: int) -> Column:
    """Three whole values from 100 to 255."""
    return F.array(*[(F.floor(F.rand(seed + k) * 156) + 100).cast("int") for k in range(3)])
