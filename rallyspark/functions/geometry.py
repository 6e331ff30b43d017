"""Court geometry as column expressions (feet; origin at the near-left corner, 20 x 44, net at 22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COURT_W, COURT_L, NET, KITCHEN, BASELINE = 20.0, 44.0, 22.0, 9.0, 17.0


def project(px: Column, py: Column, h: str = "h") -> tuple[Column, Column]:
    """Image point to court point by the homography columns ``h00``..``h22``; null where the divisor vanishes."""
    row = lambda i: F.col(f"{h}{i}0") * px + F.col(f"{h}{i}1") * py + F.col(f"{h}{i}2")
    w = F.when(F.abs(row(2)) >= 1e-9, row(2))
    return row(0) / w, row(1) / w


def image_of(x: Column, y: Column, h: str = "h") -> tuple[Column, Column]:
    """Court point to image point: ``project`` backwards, by the adjugate of the same homography columns."""
    c = lambda i, j: F.col(f"{h}{i % 3}{j % 3}")
    cofactor = lambda i, j: c(j + 1, i + 1) * c(j + 2, i + 2) - c(j + 1, i + 2) * c(j + 2, i + 1)
    row = lambda i: cofactor(i, 0) * x + cofactor(i, 1) * y + cofactor(i, 2)
    w = F.when(F.abs(row(2)) >= 1e-9, row(2))
    return row(0) / w, row(1) / w


def local_px_per_ft(px: Column, py: Column, h: str = "h") -> Column:
    """Image length of a foot at the ground point of a pixel: geometric mean of a foot along x and one along y."""
    x, y = project(px, py, h)
    at, right, ahead = image_of(x, y, h), image_of(x + 1, y, h), image_of(x, y + 1, h)
    return F.sqrt(F.hypot(right[0] - at[0], right[1] - at[1]) * F.hypot(ahead[0] - at[0], ahead[1] - at[1]))


def in_rect(x: Column, y: Column, side: float = 0.0, end: float = 0.0) -> Column:
    """Inside the court grown by ``side`` and ``end`` feet; false where unknown."""
    return F.coalesce(x.between(-side, COURT_W + side) & y.between(-end, COURT_L + end), F.lit(False))


def in_court_call(x: Column, y: Column, tolerance: float = 0.25) -> tuple[Column, Column]:
    """(in court, side of the largest violation or null); ties go to left, right, near, far in turn."""
    over = [-x, x - COURT_W, -y, y - COURT_L]
    worst = F.greatest(*over)
    side = F.when(worst <= tolerance, None)
    for name, v in zip(("left", "right", "near", "far"), over):
        side = side.when(v == worst, name)
    return worst <= tolerance, side


def zone(y: Column) -> Column:
    d = F.abs(y - NET)
    return F.when(d <= KITCHEN, "kitchen").when(d >= BASELINE, "baseline").when(y.isNotNull(), "transition")


def lateral(x: Column) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(COURT_W))
    return F.when(x < COURT_W / 3, "left").when(x < 2 * COURT_W / 3, "centre").when(x.isNotNull(), "right")


def side_of_net(y: Column) -> Column:
    return F.when(y < NET, "near").when(y >= NET, "far")


def in_receivers_kitchen(y: Column, server_side: Column) -> Column:
    return F.when(server_side == "near", y.between(NET, NET + 7)).when(server_side == "far", y.between(NET - 7, NET))


def px_per_ft(y: Column, near: Column, far: Column) -> Column:
    """Pixels of a foot at depth ``y``: linear from the near to the far baseline, clamped."""
    t = F.least(F.greatest(y / COURT_L, F.lit(0.0)), F.lit(1.0))
    return near + (far - near) * t


def bbox_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the edge of a box; 0 inside, null without a point or a box (``greatest`` would skip the nulls)."""
    known = px.isNotNull() & py.isNotNull() & x1.isNotNull() & x2.isNotNull() & y1.isNotNull() & y2.isNotNull()
    return F.when(known, F.hypot(F.greatest(x1 - px, F.lit(0.0), px - x2), F.greatest(y1 - py, F.lit(0.0), py - y2)))


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two vectors; null for a zero vector."""
    cosine = F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def speed_change(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Difference of two speeds over the larger; null if both are zero."""
    a, b = F.hypot(ax, ay), F.hypot(bx, by)
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def clamped_linear(v: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Linear from (x0, y0) to (x1, y1), flat beyond; null stays null."""
    t = F.least(F.greatest((v - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))
    return F.when(v.isNotNull(), y0 + (y1 - y0) * t)
