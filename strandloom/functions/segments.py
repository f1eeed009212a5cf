"""Half-open segments [left, right) on a contig or edge, as integer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rc(left: Column, right: Column, size: Column) -> tuple[Column, Column]:
    """The segment on the reverse complement of an object of ``size``."""
    return size - right, size - left


def distance(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Gap between two segments of one object; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), l2 - r1, l1 - r2)


def intersects(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return (l1 < r2) & (l2 < r1)


def intersection_size(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(r1, r2) - F.greatest(l1, l2))


def unite(l1: Column, r1: Column, l2: Column, r2: Column) -> tuple[Column, Column]:
    return F.least(l1, l2), F.greatest(r1, r2)


def shrink_left(left: Column, right: Column, n: int | Column) -> tuple[Column, Column]:
    return F.least(left + n, right), right


def shrink_right(left: Column, right: Column, n: int | Column) -> tuple[Column, Column]:
    return left, F.greatest(right - n, left)
