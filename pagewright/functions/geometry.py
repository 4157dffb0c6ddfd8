"""Boxes as four columns: left, top, right, bottom, with y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of the bands into which pages are cut for joins by place.
BAND = 64


def side(alias: str, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def shared_area(a: str, b: str) -> Column:
    w = F.least(side(a, "right"), side(b, "right")) - F.greatest(side(a, "left"), side(b, "left"))
    h = F.least(side(a, "bottom"), side(b, "bottom")) - F.greatest(side(a, "top"), side(b, "top"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def area(a: str) -> Column:
    return (side(a, "right") - side(a, "left")) * (side(a, "bottom") - side(a, "top"))


def overlap(a: str, b: str) -> Column:
    """The part of a that b covers; null if a has no area."""
    return F.when(area(a) != 0, shared_area(a, b) / area(a))


def overlap_of_smaller(a: str, b: str) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller != 0, shared_area(a, b) / smaller)


def horizontal_overlap(a: str, b: str) -> Column:
    """The part of a's width that b shares; null if a has none."""
    shared = F.least(side(a, "right"), side(b, "right")) - F.greatest(side(a, "left"), side(b, "left"))
    width = side(a, "right") - side(a, "left")
    return F.when(width != 0, F.greatest(F.lit(0), shared) / width)


def rounded(x: Column, places: int) -> Column:
    """A number rounded half up to so many places."""
    return F.floor(x * 10**places + 0.5) / 10**places


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def touching(a: str, b: str) -> Column:
    """Whether two boxes meet, edges included."""
    return (side(a, "left") <= side(b, "right")) & (side(b, "left") <= side(a, "right")) & (side(a, "top") <= side(b, "bottom")) & (side(b, "top") <= side(a, "bottom"))


def shrunk(df: DataFrame, share: float) -> DataFrame:
    """The boxes without the given share of their height at top and bottom, in whole pixels."""
    off = half_up((F.col("bottom") - F.col("top")) * share)
    return df.withColumns({"top": F.col("top") + off, "bottom": F.col("bottom") - off})


def meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows (aliases a and b) with equal keys whose boxes meet.

    Pages are cut into bands, so a crowded page's rows only meet those nearby; a pair that shares several bands
    is made in the first one only. The rows carry a column _band.
    """
    banded = lambda x, alias: x.withColumn("_band", F.explode(F.sequence(F.floor(F.col("top") / BAND), F.floor(F.greatest("top", "bottom") / BAND)))).alias(alias)
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_band"]]
    once = F.col("a._band") == F.greatest(F.floor(F.col("a.top") / BAND), F.floor(F.col("b.top") / BAND))
    on = same[0]
    for x in [*same[1:], once, touching("a", "b")]:
        on = on & x
    return banded(a, "a").join(banded(b, "b"), on)


def rotated(x: Column, y: Column, degrees: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """A point turned about a centre; angles of up to 0.05 degrees turn nothing."""
    r = F.radians(degrees)
    turn = F.abs(degrees) > 0.05
    return (
        F.when(turn, F.cos(r) * (x - cx) - F.sin(r) * (y - cy) + cx).otherwise(x),
        F.when(turn, F.sin(r) * (x - cx) + F.cos(r) * (y - cy) + cy).otherwise(y),
    )


def to_page(orientation: Column, left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box of a line that is turned by quarters, in the page's own frame."""
    box = lambda *v: F.struct(*(x.alias(n) for x, n in zip(v, ("left", "top", "right", "bottom"))))
    return (
        F.when(orientation == 1, box(width - bottom, left, width - top, right))
        .when(orientation == 2, box(width - right, height - bottom, width - left, height - top))
        .when(orientation == 3, box(top, height - right, bottom, height - left))
        .otherwise(box(left, top, right, bottom))
    )
