"""Detector and diffraction geometry as column expressions; angles in degrees unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.functions.columns import col, wrap


def eta(y: Column | str, z: Column | str) -> Column:
    """Azimuth of a detector position, from +z towards -y, in (-180, 180]."""
    return F.degrees(F.atan2(-col(y), col(z)))


def radius_eta_to_yz(radius: Column | str, angle: Column | str) -> tuple[Column, Column]:
    a = F.radians(col(angle))
    return -col(radius) * F.sin(a), col(radius) * F.cos(a)


def two_theta(radius: Column | str, distance: Column | str | float) -> Column:
    return F.degrees(F.atan2(col(radius), col(distance)))


def radius_of_two_theta(angle: Column | str, distance: Column | str | float) -> Column:
    return col(distance) * F.tan(F.radians(col(angle)))


def bragg_theta(d: Column | str, wavelength: Column | str | float) -> Column:
    """Bragg angle; null where the spacing is too small for the wavelength."""
    s = col(wavelength) / (2 * col(d))
    return F.when(s <= 1, F.degrees(F.asin(s)))


def q_of_two_theta(angle: Column | str, wavelength: Column | str | float) -> Column:
    return 4 * F.pi() * F.sin(F.radians(col(angle)) / 2) / col(wavelength)


def d_of_q(q: Column | str) -> Column:
    return 2 * F.pi() / col(q)


def omega_solutions(g1: Column, g2: Column, g3: Column, theta: Column) -> Column:
    """The rotations, in (-180, 180], that bring a reciprocal vector into reflection: an array of none, one or two angles.

    With |g| sin(theta) = -g1 cos(w) + g2 sin(w) the unknown is a phase: two solutions about
    the phase of (g1, g2), one where they meet.
    """
    length = F.sqrt(g1 * g1 + g2 * g2 + g3 * g3)
    flat = F.sqrt(g1 * g1 + g2 * g2)
    ratio = length * F.sin(F.radians(theta)) / F.nullif(flat, F.lit(0.0))
    phase, half = F.degrees(F.atan2(g2, -g1)), F.degrees(F.acos(ratio))
    both = F.array(wrap(phase - half), wrap(phase + half))
    return F.when(ratio.isNull() | (F.abs(ratio) > 1), F.array().cast("array<double>")).otherwise(F.array_distinct(both))


def distortion(radius: Column, angle: Column, most: float, p: list[float]) -> Column:
    """Radial distortion factor: powers of radius / most with two-, four- and no-fold azimuthal terms; p is (p0, p1, p2, p3)."""
    x, a = radius / most, F.radians(90 - angle)
    return 1 + p[0] * x * x * F.cos(2 * a) + p[1] * F.pow(x, 4) * F.cos(4 * a + F.radians(F.lit(p[3]))) + p[2] * x * x


def tilt_corrected(y: Column, z: Column, distance: float, tilts: tuple[float, float, float]) -> tuple[Column, Column]:
    """A tilted detector's position projected on the plane at right angles to the beam (tilts about x, y, z)."""
    import math

    a, b, c = (math.radians(t) for t in tilts)
    rx = [[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]]
    ry = [[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]]
    rz = [[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]]

    def times(m: list, n: list) -> list:
        return [[sum(m[i][k] * n[k][j] for k in range(3)) for j in range(3)] for i in range(3)]

    m = times(rx, times(ry, rz))
    x, yy, zz = (m[i][1] * y + m[i][2] * z for i in range(3))
    scale = distance / (distance + x)
    return yy * scale, zz * scale


def polarisation(angle: Column | str, azimuth: Column | str, fraction: float = 0.99) -> Column:
    """Polarisation factor of a beam polarised in the plane by ``fraction``."""
    t, e = F.radians(col(angle)), F.radians(col(azimuth))
    across, along = 1 - F.pow(F.sin(t) * F.sin(e), 2), 1 - F.pow(F.sin(t) * F.cos(e), 2)
    return fraction * across + (1 - fraction) * along


def solid_angle(angle: Column | str) -> Column:
    """Relative solid angle of a flat detector's pixel: the cube of the cosine."""
    return F.pow(F.cos(F.radians(col(angle))), 3)


def flat_absorption(mu_t: Column | str, angle: Column | str) -> Column:
    """Transmission through a plate of optical thickness mu_t at an angle."""
    return F.exp(-col(mu_t) / F.cos(F.radians(col(angle))))


def flip(y: Column, z: Column, n_y: int, n_z: int, steps: list[int]) -> tuple[Column, Column, int, int]:
    """Pixel places after the image operations, in turn: 0 none, 1 flip y, 2 flip z, 3 transpose."""
    for step in steps:
        if step == 1:
            y = n_y - 1 - y
        elif step == 2:
            z = n_z - 1 - z
        elif step == 3:
            y, z, n_y, n_z = z, y, n_z, n_y
        elif step:
            raise ValueError(f"unknown image operation {step}")
    return y, z, n_y, n_z


def vector_edges(number: Column, least: float, step: float, wavelength: float, distance: float) -> tuple[Column, Column]:
    """Radii of the lower and upper edge of bin ``number`` of an even grid of scattering vectors."""
    import math

    def radius(q: Column) -> Column:
        return distance * F.tan(2 * F.asin(F.least(q * wavelength / (4 * math.pi), F.lit(1.0))))

    return radius(least + step * number), radius(least + step * number + step)


def hexagonal_grid(spark: SparkSession, spacing: float, radius: float) -> DataFrame:
    """(line, place, x, y): centres of the triangles, alternately pointing up and down, of a hexagon that covers a disk."""
    import math

    n = math.ceil(2 * radius / math.sqrt(3) / spacing)
    height = math.sqrt(3) * spacing / 2
    lines = spark.range(-n, n + 1).where("id <> 0").select(F.col("id").alias("line"))
    cells = lines.select("line", F.explode(F.sequence(F.lit(0).cast("long"), 2 * (2 * n - F.abs("line")))).alias("place"))
    down = F.col("line") < 0
    far = (F.col("place") % 2 == 0) == down
    x = -spacing * n + F.abs("line") * spacing / 2 + F.when(down, spacing / 2).otherwise(0.0) + spacing * F.col("place") / 2
    y = height * F.col("line") - F.signum("line") * height * F.when(far, F.lit(2.0) / 3).otherwise(F.lit(1.0) / 3)
    return cells.select("line", "place", x.alias("x"), y.alias("y"))
