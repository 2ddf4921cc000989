"""Geometry as Column expressions: lines, boxes, vectors, homographies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side(px: Column, py: Column, x1, y1, x2, y2) -> Column:
    """Cross product that is positive on one side of the line and negative on the other."""
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def sign_change(a: Column, b: Column) -> Column:
    """Two points strictly on different sides."""
    return ((a > 0) & (b < 0)) | ((a < 0) & (b > 0))


def parameters(ax, ay, bx, by, x1, y1, x2, y2) -> tuple[Column, Column]:
    """Places t1 on a segment and t2 on a line where they meet; null for all but parallel ones."""
    dx, dy, ex, ey = bx - ax, by - ay, x2 - x1, y2 - y1
    cross = dx * ey - dy * ex
    t1 = ((x1 - ax) * ey - (y1 - ay) * ex) / cross
    t2 = ((x1 - ax) * dy - (y1 - ay) * dx) / cross
    apart = F.abs(cross) >= 0.01
    return F.when(apart, t1), F.when(apart, t2)


def intersects(ax, ay, bx, by, x1, y1, x2, y2) -> Column:
    t1, t2 = parameters(ax, ay, bx, by, x1, y1, x2, y2)
    return F.coalesce(t1.between(0, 1) & t2.between(0, 1), F.lit(False))


def double_line(first_x, first_y, last_x, last_y, out_line, in_line) -> Column:
    """A trace that crosses out_line (x1, y1, x2, y2) and, carried back beyond its first point, comes through in_line."""
    crossed = intersects(*out_line, first_x, first_y, last_x, last_y)
    t1, t2 = parameters(*in_line, first_x, first_y, last_x, last_y)
    return crossed & F.coalesce(t1.between(0, 1) & (t2 <= 0), F.lit(False))


def turned(dx: Column, dy: Column, step_x: Column, step_y: Column) -> tuple[Column, Column]:
    """A direction turned to agree with a step; a step across it leaves it as it is."""
    sign = F.when(dx * step_x + dy * step_y < -1e-9, -1).otherwise(1)
    return sign * dx, sign * dy


def y_at(x: Column, x1, y1, x2, y2) -> Column:
    """Height of a line at x; a vertical line has the slope 1e-11."""
    slope = F.when(x2 - x1 == 0, F.lit(1e-11)).otherwise((y2 - y1) / F.when(x2 - x1 == 0, F.lit(1)).otherwise(x2 - x1))
    return y1 + slope * (x - x1)


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Length that two half-open intervals share, 0 if none."""
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def union_box(a, b) -> Column:
    """Smallest box around two boxes (structs of x, y, w, h)."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, bottom = F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def intersection_area(a, b) -> Column:
    return overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])


def clip_box(x, y, w, h, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """A box cut to the frame."""
    left, top = F.greatest(F.lit(0), F.least(x, F.lit(width))), F.greatest(F.lit(0), F.least(y, F.lit(height)))
    right, bottom = F.greatest(left, F.least(x + w, F.lit(width))), F.greatest(top, F.least(y + h, F.lit(height)))
    return left, top, right - left, bottom - top


def scaled_box(x, y, w, h, factor: float, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """A box enlarged about its middle, sizes and halves rounded towards zero, cut to the frame."""
    new_w, new_h = (w * factor).cast("long"), (h * factor).cast("long")
    return clip_box(x - ((new_w - w) / 2).cast("long"), y - ((new_h - h) / 2).cast("long"), new_w, new_h, width, height)


def expanded_box(x, y, w, h, dx: int, dy: int, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """A box with dx more on the left and on the right, and dy above and below, cut to the frame."""
    return clip_box(x - dx, y - dy, w + 2 * dx, h + 2 * dy, width, height)


def inclusive_sizes(a, b) -> Column:
    """Sizes of the union and of the intersection of two boxes whose last row and column count: union_w, union_h, shared_w, shared_h."""
    right_a, right_b, bottom_a, bottom_b = a["x"] + a["w"], b["x"] + b["w"], a["y"] + a["h"], b["y"] + b["h"]
    return F.struct(
        (F.greatest(right_a, right_b) - F.least(a["x"], b["x"]) + 1).alias("union_w"), (F.greatest(bottom_a, bottom_b) - F.least(a["y"], b["y"]) + 1).alias("union_h"),
        (F.least(right_a, right_b) - F.greatest(a["x"], b["x"]) + 1).alias("shared_w"), (F.least(bottom_a, bottom_b) - F.greatest(a["y"], b["y"]) + 1).alias("shared_h"),
    )


def rotated(x: Column, y: Column, angle_: Column) -> tuple[Column, Column]:
    """A point turned about the origin by an angle in radians."""
    return x * F.cos(angle_) - y * F.sin(angle_), x * F.sin(angle_) + y * F.cos(angle_)


def cosine_at(px, py, ax, ay, bx, by) -> Column:
    """Cosine of the angle at p between a and b."""
    ux, uy, vx, vy = ax - px, ay - py, bx - px, by - py
    return (ux * vx + uy * vy) / F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy) + 1e-10)


def strictly_inside(px, py, x, y, w, h) -> Column:
    return (px > x) & (px < x + w) & (py > y) & (py < y + h)


def slope(x1, y1, x2, y2) -> Column:
    """Slope of a line; that of a vertical one is 1e-11."""
    run = F.when(x2 - x1 == 0, F.lit(1)).otherwise(x2 - x1)
    return F.when(x2 - x1 == 0, F.lit(1e-11)).otherwise((y2 - y1) / run)


def closest_point(px, py, x1, y1, x2, y2) -> tuple[Column, Column]:
    """Foot of the perpendicular from a point on the line through two others; null where these are one."""
    dx, dy = x2 - x1, y2 - y1
    u = F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy)
    return x1 + u * dx, y1 + u * dy


def meeting_point(x1, y1, x2, y2, u1, v1, u2, v2) -> tuple[Column, Column]:
    """Where two lines meet; (-1, -1) if they are parallel."""
    a, b = slope(x1, y1, x2, y2), slope(u1, v1, u2, v2)
    parallel, upright = a == b, (x1 == x2) | (u1 == u2)
    ca, cb = y1 - a * x1, v2 - b * u2
    x = F.when(parallel, F.lit(-1.0)).when(x1 == x2, x1).when(u1 == u2, u1).otherwise(F.try_divide(cb - ca, a - b))
    y = F.when(parallel, F.lit(-1.0)).when(x1 == x2, v2 + b * (x1 - u2)).when(u1 == u2, y2 + a * (u1 - x2)).otherwise(a * x + ca)
    return x, F.when(upright & parallel, F.lit(-1.0)).otherwise(y)


def parallel_line(x1, y1, x2, y2, distance: float) -> tuple[Column, Column, Column, Column]:
    """A line moved sideways by whole numbers of about the distance."""
    turn = F.atan2((x2 - x1).cast("double"), (y2 - y1).cast("double"))
    dx, dy = F.round(distance * F.cos(turn)), F.round(-distance * F.sin(turn))
    return x1 + dx, y1 + dy, x2 + dx, y2 + dy


def homography(x: Column, y: Column, m: list[float]) -> tuple[Column, Column]:
    """A point mapped by a 3 x 3 matrix, given by rows."""
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def angle(dx: Column, dy: Column) -> Column:
    """Direction in degrees."""
    return F.degrees(F.atan2(dy, dx))


def track_cost(dx: Column, dy: Column, vx: Column, vy: Column, has_trace: Column, distance: float, cos: float, big: float = 1e6) -> Column:
    """Cost of giving a detection (dx, dy from the track's last point) to a track that moves by (vx, vy).

    Beyond the distance it is big. With two trace points also where |cos| is below the gate, and
    where the detection is far and behind; else it grows as the direction differs. A standing
    track or detection has no direction: the cost is not a number.
    """
    d, v = F.hypot(dx, dy), F.hypot(vx, vy)
    c = F.when((d == 0) | (v == 0), F.lit(float("nan"))).otherwise((dx * vx + dy * vy) / F.when(d * v == 0, F.lit(1.0)).otherwise(d * v))
    moving = F.when(F.isnan(c), c).when((F.abs(c) < cos) | ((d > distance / 2) & (c < -0.3)), F.lit(big)).otherwise(d * F.exp((1 - F.abs(c)) / 2))
    return F.when(d > distance, F.lit(big)).when(has_trace, moving).otherwise(d)
