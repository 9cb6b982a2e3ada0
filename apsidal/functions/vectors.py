"""Small vectors and symmetric 3x3 matrices as lists of Columns: turning, projecting, principal axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = list[Column]
#: A symmetric matrix as xx, xy, xz, yy, yz, zz.
Symmetric = list[Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def scaled(a: Vector, s: Column) -> Vector:
    return [x * s for x in a]


def plus(a: Vector, b: Vector, sign: int = 1) -> Vector:
    return [x + y if sign > 0 else x - y for x, y in zip(a, b, strict=True)]


def size(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    return scaled(a, 1 / size(a))


def packed(a: Vector) -> Column:
    return F.array(*a)


def unpacked(name: str) -> Vector:
    return [F.get(name, F.lit(i)) for i in range(3)]


def orbit_axes(r: Vector, v: Vector) -> tuple[Vector, Vector, Vector]:
    """Radial, along-track and cross-track directions of a state."""
    radial, normal = unit(r), unit(cross(r, v))
    return radial, cross(normal, radial), normal


def turned_variances(axes: tuple[Vector, Vector, Vector], variances: Vector) -> Symmetric:
    """The covariance that has these variances along these axes, in the frame of the axes' components."""
    term = lambda i, j: sum((axes[k][i] * axes[k][j] * variances[k] for k in (1, 2)), axes[0][i] * axes[0][j] * variances[0])
    return [term(0, 0), term(0, 1), term(0, 2), term(1, 1), term(1, 2), term(2, 2)]


def form(m: Symmetric, a: Vector, b: Vector) -> Column:
    """a' M b."""
    xx, xy, xz, yy, yz, zz = m
    return a[0] * (xx * b[0] + xy * b[1] + xz * b[2]) + a[1] * (xy * b[0] + yy * b[1] + yz * b[2]) + a[2] * (xz * b[0] + yz * b[1] + zz * b[2])


def principal_axes_2d(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    """The larger and the smaller variance of a 2x2 covariance, and the angle of the larger one's axis, in (-pi/2, pi/2]."""
    mean, half, apart = (xx + yy) / 2, (xx - yy) / 2, F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    return mean + apart, F.greatest(mean - apart, F.lit(0.0)), F.atan2(xy, half + apart)


def with_least_axis(df: DataFrame, m: Symmetric, name: str) -> DataFrame:
    """Add a unit eigenvector of the smallest eigenvalue as an array, in closed form.

    The eigenvalue is the trigonometric root of the cubic, the vector the longest product of two rows of the
    matrix less it. Each step is a column of its own, so that none is written out in the next.
    """
    df = df.withColumn("__m", F.array(*m)).withColumn("__mean", (F.get("__m", F.lit(0)) + F.get("__m", F.lit(3)) + F.get("__m", F.lit(5))) / 3)
    xx, xy, xz, yy, yz, zz = (F.get("__m", F.lit(i)) for i in range(6))
    mean, p, low = F.col("__mean"), F.col("__p"), F.col("__low")
    spread = (xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * (xy * xy + xz * xz + yz * yz)
    df = df.withColumn("__p", F.sqrt(spread / 6))
    det = (xx - mean) * ((yy - mean) * (zz - mean) - yz * yz) - xy * (xy * (zz - mean) - yz * xz) + xz * (xy * yz - (yy - mean) * xz)
    df = df.withColumn("__det", det / (2 * p * p * p))
    df = df.withColumn("__low", mean + 2 * p * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__det")))) / 3 + 2.0943951023931953))
    rows = [[xx - low, xy, xz], [xy, yy - low, yz], [xz, yz, zz - low]]
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        df = df.withColumn(f"__c{n}", packed(cross(rows[i], rows[j])))
    df = df.withColumn("__best", F.array_max(F.array(*[F.struct(dot(unpacked(f"__c{n}"), unpacked(f"__c{n}")).alias("n"), F.col(f"__c{n}").alias("v")) for n in range(3)])))
    return df.withColumn(name, packed([F.get("__best.v", F.lit(i)) / F.sqrt("__best.n") for i in range(3)])).drop("__m", "__mean", "__p", "__det", "__low", "__c0", "__c1", "__c2", "__best")


def encounter_plane(r1: Vector, v1: Vector, r2: Vector, v2: Vector) -> tuple[Vector, Vector, Column]:
    """Two unit axes across the relative velocity, and its size; a still pair is looked at along x."""
    dv = plus(v2, v1, -1)
    speed = size(dv)
    moving = speed > 1e-9
    along = [F.when(moving, x / speed).otherwise(float(i == 0)) for i, x in enumerate(dv)]
    first = cross(along, r1)
    flat = size(first) < 1e-9
    other = cross(along, [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    t = unit([F.when(flat, y).otherwise(x) for x, y in zip(first, other, strict=True)])
    return t, cross(t, along), speed
