"""Court calibration from four clicked corners: homographies in closed form and how well they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import COURT_L, COURT_W

NET_Y, KITCHEN = COURT_L / 2, 7.0
CELLS = [f"{i}{j}" for i in range(3) for j in range(3)]


def square_to_quad(corners: list[tuple[Column, Column]]) -> dict[str, Column]:
    """The projective map of the unit square's corners (0,0), (1,0), (1,1), (0,1) onto four points, its last cell 1; null if three
    of the points lie on a line."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    proper = F.array_min(F.array(*[F.coalesce(F.abs(cross(*[corners[(k + i) % 4] for i in range(3)])), F.lit(0.0)) for k in range(4)])) > 1e-9
    den = F.when(proper, dx1 * dy2 - dx2 * dy1)
    g, h = F.try_divide(sx * dy2 - dx2 * sy, den), F.try_divide(dx1 * sy - sx * dy1, den)
    return {"00": x1 - x0 + g * x1, "01": x3 - x0 + h * x3, "02": F.when(proper, x0), "10": y1 - y0 + g * y1, "11": y3 - y0 + h * y3, "12": F.when(proper, y0), "20": g, "21": h, "22": F.when(proper, F.lit(1.0))}


def inverse(m: dict[str, Column]) -> dict[str, Column]:
    """The inverse map by the adjugate, scaled so that its last cell is 1."""
    minor = lambda a, b, c, d: m[a] * m[b] - m[c] * m[d]
    adj = {"00": minor("11", "22", "12", "21"), "01": minor("02", "21", "01", "22"), "02": minor("01", "12", "02", "11"), "10": minor("12", "20", "10", "22"), "11": minor("00", "22", "02", "20"),
           "12": minor("02", "10", "00", "12"), "20": minor("10", "21", "11", "20"), "21": minor("01", "20", "00", "21"), "22": minor("00", "11", "01", "10")}
    return {k: F.try_divide(v, adj["22"]) for k, v in adj.items()}


def mapped(prefix: str, x, y) -> tuple[Column, Column]:
    """A point through the map whose cells are the columns ``prefix``00 to ``prefix``22."""
    c = lambda k: F.col(prefix + k)
    w = c("20") * x + c("21") * y + c("22")
    return F.try_divide(c("00") * x + c("01") * y + c("02"), w), F.try_divide(c("10") * x + c("11") * y + c("12"), w)


def calibration_qa(clicks: DataFrame) -> DataFrame:
    """One row per clip: both homographies, the corners' round-trip error, the kitchen lines' errors, pixels of a foot at both
    baselines, and the outlines of halves and kitchens in the image.

    ``clicks`` has corner (array of four points (x, y): bottom left, bottom right, top right, top left), user_baseline (near or
    far), and own_kitchen and other_kitchen (arrays of a left and a right point, or null). Corners that are missing or on one
    line give nulls and a fault."""
    corner = lambda i, c: F.try_element_at("corner", F.lit(i + 1))[c]
    unit = square_to_quad([(corner(i, "x"), corner(i, "y")) for i in range(4)])
    scale = {"0": COURT_W, "1": COURT_L, "2": 1.0}
    rows = clicks.withColumns({f"c{k}": v / scale[k[1]] for k, v in unit.items()})
    rows = rows.withColumns({f"h{k}": v for k, v in inverse({k: F.col(f"c{k}") for k in CELLS}).items()})
    court = [(0.0, 0.0), (COURT_W, 0.0), (COURT_W, COURT_L), (0.0, COURT_L)]
    image = [mapped("c", F.lit(x), F.lit(y)) for x, y in court]
    off = [F.pow(px - corner(i, "x"), 2) + F.pow(py - corner(i, "y"), 2) for i, (px, py) in enumerate(image)]
    near = F.col("user_baseline") == "near"

    def line_error(name: str, y: Column) -> Column:
        ends = [(mapped("c", F.lit(x), y), F.try_element_at(name, F.lit(i + 1))) for i, x in enumerate((0.0, COURT_W))]
        return sum(F.hypot(px - p["x"], py - p["y"]) for (px, py), p in ends) / 2

    own, other = F.when(near, NET_Y - KITCHEN).otherwise(NET_Y + KITCHEN), F.when(near, NET_Y + KITCHEN).otherwise(NET_Y - KITCHEN)

    def outline(a, b) -> Column:
        points = [mapped("c", F.lit(x), y) for x, y in ((0.0, a), (COURT_W, a), (COURT_W, b), (0.0, b))]
        return F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in points])

    net, base, far = F.lit(NET_Y), F.lit(0.0), F.lit(COURT_L)
    regions = {"own_half": F.when(near, outline(base, net)).otherwise(outline(net, far)), "other_half": F.when(near, outline(net, far)).otherwise(outline(base, net)),
               "own_kitchen_area": F.when(near, outline(own, net)).otherwise(outline(net, own)), "other_kitchen_area": F.when(near, outline(net, other)).otherwise(outline(other, net))}
    width = lambda a, b: F.hypot(image[b][0] - image[a][0], image[b][1] - image[a][1]) / COURT_W
    return rows.select("clip_id", *[f"c{k}" for k in CELLS], *[f"h{k}" for k in CELLS], F.sqrt(sum(off) / 4).alias("corner_rmse"), line_error("own_kitchen", own).alias("own_kitchen_error"), line_error("other_kitchen", other).alias("other_kitchen_error"),
                       width(0, 1).alias("near_px_per_ft"), width(3, 2).alias("far_px_per_ft"), *[v.alias(k) for k, v in regions.items()], F.when(F.col("c22").isNull(), "corners make no quadrilateral").alias("fault"))
