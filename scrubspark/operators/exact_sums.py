"""Means and deviations that are bit-equal whatever order partial sums meet in.

A sum of doubles depends on the order of its additions, and so on the tasks of a run.  Here every value is cut into
integer slices on one grid, set by the largest magnitude of the column, and the slices are summed as ``bigint``: integer
sums are exact, so any partitioning gives the same ones.  The driver puts the few sums of a column together with
fractions and rounds once.

The width of a slice comes from the row count, so that no sum can overflow.  The grid ends ``GRID_BITS`` below the largest
magnitude (below its square, for squares): what a value has beneath that is rounded, the same in every run.  A mean is
therefore the correctly rounded one while magnitudes span less than 2^75.  A square is kept as its rounded product
and that product's error (Dekker's split), so ``sum(x^2) - sum(x)^2 / n`` loses nothing to cancellation.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_BITS = 128
# A double's product error lies at least this many bits below the product's bound.
ERROR_BITS = 52
# 2^27 + 1 halves a 53-bit double.
SPLIT = 134217729.0


def slice_width(n: int) -> int:
    """Bits of a slice: ``n`` slices of that many bits, sign and rounding included, add up below 2^62."""
    return max(8, min(48, 62 - n.bit_length()))


def _slices(x: Column, width: int, first: int = 0) -> list[tuple[int, Column]]:
    """(bits below one, sum of the slice ending there) for ``x``, |x| <= 2^-first.

    Rounding to a grid of k slices, less what k - 1 slices held, is an integer that a double holds exactly.
    """
    out, before = [], None
    for end in range(first + width, GRID_BITS + width, width):
        here = F.rint(x * F.lit(math.ldexp(1.0, end)))
        part = here if before is None else here - before * F.lit(math.ldexp(1.0, width))
        out.append((end, F.sum(part.cast("bigint"))))
        before = here
    return out


def exact_totals(df: DataFrame, values: dict, extents: dict) -> dict:
    """{key: (sum, sum of squares)} as fractions of the double columns ``values``, NULLs left out, in one job.

    ``extents`` has (count, least, greatest) of each.  Sums of disjoint sets of rows add up to the sum of their union.
    A key without values or with an infinity has no entry.
    """
    out, grids = {}, {}
    for k, (n, lo, hi) in extents.items():
        if not n or math.isinf(lo) or math.isinf(hi):
            continue
        if lo == hi:
            out[k] = (n * Fraction(lo), n * Fraction(lo) ** 2)
        else:
            grids[k] = (n, math.frexp(max(abs(lo), abs(hi)))[1], slice_width(n))
    if not grids:
        return out
    # Each step is a projection of its own: an expression used many times is computed once.  A power of two
    # scales exactly; twice half of it stays inside a double's range.
    scaled, split, products, sums = [], [], [], []
    places: dict = {}
    for i, (k, (n, e, width)) in enumerate(grids.items()):
        half = e // 2
        scaled.append((values[k] * F.lit(math.ldexp(1.0, -half)) * F.lit(math.ldexp(1.0, half - e))).alias(f"u{i}"))
        u, h, p = F.col(f"u{i}"), F.col(f"h{i}"), F.col(f"p{i}")
        split += [u, (u * SPLIT - (u * SPLIT - u)).alias(f"h{i}")]
        low = u - h
        products += [u, (u * u).alias(f"p{i}"), (((h * h - u * u) + h * low * 2.0) + low * low).alias(f"e{i}")]
        for part, column, first in (("u", u, 0), ("p", p, 0), ("e", F.col(f"e{i}"), ERROR_BITS)):
            for end, total in _slices(column, width, first):
                name = f"{part}{i}_{end}"
                sums.append(total.alias(name))
                places.setdefault((k, part), []).append((end, name))
    row = df.select(*scaled).select(*split).select(*products).agg(*sums).first()

    def total(k, part):
        return sum((Fraction(row[name], 1 << end) for end, name in places[k, part]), Fraction(0))

    for k, (_, e, _) in grids.items():
        unit = Fraction(2) ** e
        out[k] = (total(k, "u") * unit, (total(k, "p") + total(k, "e")) * unit * unit)
    return out


def fitted(n: int, lo, hi, totals: tuple | None) -> tuple:
    """(mean, sample deviation) of ``n`` values between ``lo`` and ``hi`` from their ``exact_totals``.

    No values give (None, None), one value a deviation of 0.0.  With infinities the mean is their sum and the deviation NaN.
    """
    if not n:
        return None, None
    if math.isinf(lo) or math.isinf(hi):
        return lo + hi, 0.0 if n == 1 else math.nan
    if lo == hi:
        return float(lo) + 0.0, 0.0
    s, squares = totals
    # The spread is scaled by a power of two, so that its square root lies within a double's range.
    e = math.frexp(max(abs(lo), abs(hi)))[1]
    spread = max((squares - s * s / n) / (n - 1), Fraction(0)) / Fraction(2) ** (2 * e)
    return _times_power(float(s / n / Fraction(2) ** e), e), _times_power(math.sqrt(spread), e)


def mean_and_std(df: DataFrame, values: dict, extents: dict) -> dict:
    """{key: (mean, sample deviation)} of the double columns ``values`` (see ``exact_totals`` and ``fitted``), in one job."""
    totals = exact_totals(df, values, extents)
    return {k: fitted(*e, totals.get(k)) for k, e in extents.items()}


def _times_power(x: float, e: int) -> float:
    try:
        return math.ldexp(x, e)
    except OverflowError:
        return math.inf
