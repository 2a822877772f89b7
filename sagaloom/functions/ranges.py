"""Ranges on the progress axis: overlap tests and sizes with their null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ends(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Both ends in order; one missing end copies the other."""
    a, b = F.coalesce(lo, hi), F.coalesce(hi, lo)
    return F.least(a, b), F.greatest(a, b)


def overlaps(lo: Column, hi: Column, want: tuple[int, int] | None) -> Column:
    """Whether a span meets the wanted range; no wanted range meets all, a span without ends meets none."""
    if want is None:
        return F.lit(True)
    a, b = ends(lo, hi)
    w0, w1 = min(want), max(want)
    return F.coalesce((a <= w1) & (b >= w0), F.lit(False))


def overlap_size(lo: Column, hi: Column, want: tuple[int, int]) -> Column:
    """How many whole steps a span and the wanted range share."""
    a, b = ends(lo, hi)
    return F.when(a.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(b, F.lit(max(want))) - F.greatest(a, F.lit(min(want))) + 1))


def sql_overlaps(lo: str, hi: str, want: tuple[int, int]) -> str:
    return f"coalesce(least(coalesce({lo}, {hi}), coalesce({hi}, {lo})) <= {max(want)} AND greatest(coalesce({lo}, {hi}), coalesce({hi}, {lo})) >= {min(want)}, false)"


def sql_overlap_size(lo: str, hi: str, want: tuple[int, int]) -> str:
    a, b = f"least(coalesce({lo}, {hi}), coalesce({hi}, {lo}))", f"greatest(coalesce({lo}, {hi}), coalesce({hi}, {lo}))"
    return f"CASE WHEN {a} IS NULL THEN 0 ELSE greatest(0, least({b}, {max(want)}) - greatest({a}, {min(want)}) + 1) END"
