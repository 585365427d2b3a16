"""Rigid transforms, rotations and pinhole projection as column expressions.

Matrices are lists of columns, row by row; quaternions are (w, x, y, z).  All in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mat = list[Column]


def euler_to_rotation(roll: Column, pitch: Column, yaw: Column) -> Mat:
    """Rz(yaw) Ry(pitch) Rx(roll): extrinsic x, y, z."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]


def rotation_to_euler(r: Mat) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw); the sine of the pitch is clamped to [-1, 1]."""
    return F.atan2(r[7], r[8]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[6]))), F.atan2(r[3], r[0])


def euler_to_quaternion(roll: Column, pitch: Column, yaw: Column) -> Mat:
    cr, sr, cp, sp, cy, sy = F.cos(roll / 2), F.sin(roll / 2), F.cos(pitch / 2), F.sin(pitch / 2), F.cos(yaw / 2), F.sin(yaw / 2)
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def normalise_quaternion(q: Mat) -> Mat:
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [F.when(n > 0, x / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, x in enumerate(q)]


def quaternion_to_rotation(q: Mat) -> Mat:
    w, x, y, z = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def slerp(a: Mat, b: Mat, t: Column) -> Mat:
    """Spherical interpolation on the shorter arc; linear where the quaternions almost agree.

    As one expression; with_slerp() computes the same in steps, which is much cheaper to plan.
    """
    wa, wb = _slerp_weights(a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3], t)
    return normalise_quaternion([wa * x + wb * y for x, y in zip(a, b, strict=True)])


def _slerp_weights(d: Column, t: Column) -> tuple[Column, Column]:
    sign = F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    c = F.least(F.abs(d), F.lit(1.0))
    theta = F.acos(c)
    flat = c > 1 - 1e-9
    s = F.when(flat, F.lit(1.0)).otherwise(F.sin(theta))
    return F.when(flat, 1 - t).otherwise(F.sin((1 - t) * theta) / s), F.when(flat, t).otherwise(F.sin(t * theta) / s) * sign


def with_slerp(df: DataFrame, euler_a: Mat, euler_b: Mat, t: Column, name: str = "q") -> DataFrame:
    """df with name0..name3: the quaternion between two (roll, pitch, yaw).  Intermediate values are
    columns of their own, so that none is written out again in each place that uses it."""
    keep = df.columns
    q = [*(x.alias(f"__a{i}") for i, x in enumerate(euler_to_quaternion(*euler_a))), *(x.alias(f"__b{i}") for i, x in enumerate(euler_to_quaternion(*euler_b)))]
    one = df.select(*keep, t.alias("__t"), *q)
    two = one.select("*", (F.col("__a0") * F.col("__b0") + F.col("__a1") * F.col("__b1") + F.col("__a2") * F.col("__b2") + F.col("__a3") * F.col("__b3")).alias("__d"))
    wa, wb = _slerp_weights(F.col("__d"), F.col("__t"))
    three = two.select("*", wa.alias("__wa"), wb.alias("__wb"))
    four = three.select(*keep, *((F.col("__wa") * F.col(f"__a{i}") + F.col("__wb") * F.col(f"__b{i}")).alias(f"__q{i}") for i in range(4)))
    five = four.select("*", F.sqrt(sum((F.col(f"__q{i}") * F.col(f"__q{i}") for i in range(4)), F.lit(0.0))).alias("__n"))
    return five.select(*keep, *(F.when(F.col("__n") > 0, F.col(f"__q{i}") / F.col("__n")).otherwise(F.lit(1.0 if i == 0 else 0.0)).alias(f"{name}{i}") for i in range(4)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def alpha(t: Column, t0: Column, t1: Column) -> Column:
    """Where t lies between t0 and t1; 0 for an empty span."""
    return F.when(t1 > t0, (t - t0).cast("double") / (t1 - t0).cast("double")).otherwise(F.lit(0.0))


def mat_mul(a: Mat, b: Mat) -> Mat:
    """3x3 product."""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transpose(r: Mat) -> Mat:
    return [r[3 * j + i] for i in range(3) for j in range(3)]


def apply(r: Mat, t: Mat, p: Mat) -> Mat:
    """R p + t."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def compose(ra: Mat, ta: Mat, rb: Mat, tb: Mat) -> tuple[Mat, Mat]:
    """The transform that applies b first, then a."""
    return mat_mul(ra, rb), apply(ra, ta, tb)


def invert(r: Mat, t: Mat) -> tuple[Mat, Mat]:
    back = transpose(r)
    return back, [-(back[3 * i] * t[0] + back[3 * i + 1] * t[1] + back[3 * i + 2] * t[2]) for i in range(3)]


def projection(fx: Column, fy: Column, cx: Column, cy: Column, r: Mat, t: Mat) -> Mat:
    """K [R^T | -R^T t], 12 entries row by row, of a camera at (R, t) in the world."""
    rt, s = invert(r, t)
    rows = [[*rt[3 * i : 3 * i + 3], s[i]] for i in range(3)]
    return [*(fx * a + cx * c for a, c in zip(rows[0], rows[2], strict=True)), *(fy * b + cy * c for b, c in zip(rows[1], rows[2], strict=True)), *rows[2]]


def pixel(m: Mat, p: Mat) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a point; u and v null behind the camera."""
    a, b, c = (m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))
    ok = c > 0
    return F.when(ok, F.floor(a / c + 0.5)).cast("int"), F.when(ok, F.floor(b / c + 0.5)).cast("int"), c


def pixel_truncated(m: Mat, p: Mat) -> tuple[Column, Column]:
    """(u, v) of a point rounded by cutting off: a place less than a pixel left of or above the raster lands
    on its border.  Null behind the camera."""
    a, b, c = (m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))
    return tuple(F.when(c > 0, (x / c + 0.5).cast("int")) for x in (a, b))


def splat_radius(depth: Column, scale: float, least: int, most: int) -> Column:
    """Pixels that a point of a given extent covers at this depth, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.round(F.lit(scale) / depth))).cast("int")


def angle_axis(r: Mat) -> tuple[Column, Mat]:
    """(angle, unit axis) of a rotation; no turn has the axis (1, 0, 0)."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1) / 2)))
    axis = [r[7] - r[5], r[2] - r[6], r[3] - r[1]]
    n = F.sqrt(axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2])
    return angle, [F.when(n > 1e-12, x / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, x in enumerate(axis)]


def rotation_of(angle: Column, axis: Mat) -> Mat:
    """The rotation by an angle about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    d = 1 - c
    return [c + x * x * d, x * y * d - z * s, x * z * d + y * s, y * x * d + z * s, c + y * y * d, y * z * d - x * s, z * x * d - y * s, z * y * d + x * s, c + z * z * d]


def adjoint(r: Mat, t: Mat) -> Mat:
    """The 6x6 adjoint [[R, [t]R], [0, R]] of a transform, row by row."""
    cross = [F.lit(0.0), -t[2], t[1], t[2], F.lit(0.0), -t[0], -t[1], t[0], F.lit(0.0)]
    tr, zero = mat_mul(cross, r), [F.lit(0.0)] * 3
    return [x for i in range(3) for x in (*r[3 * i : 3 * i + 3], *tr[3 * i : 3 * i + 3])] + [x for i in range(3) for x in (*zero, *r[3 * i : 3 * i + 3])]
