"""Strain, stress and slip as column expressions over arrays; 3x3 matrices by rows, Voigt order 11, 22, 33, 23, 13, 12.

Each function names its arguments several times, so chains of matrix functions should go
through columns of a DataFrame rather than nest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.functions.columns import at, bound, col, total


def product(a: Column, b: Column) -> Column:
    """3x3 times 3x3."""
    return F.array(*[total([at(a, 3 * i + k) * at(b, 3 * k + j) for k in range(3)]) for i in range(3) for j in range(3)])


def transposed(a: Column) -> Column:
    return F.array(*[at(a, 3 * j + i) for i in range(3) for j in range(3)])


def apply(a: Column, v: Column) -> Column:
    """3x3 times a vector."""
    return F.array(*[total([at(a, 3 * i + k) * at(v, k) for k in range(3)]) for i in range(3)])


def determinant(a: Column) -> Column:
    m = [at(a, k) for k in range(9)]
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(a: Column) -> Column:
    """Inverse; null where the determinant is 0."""
    m, d = [at(a, k) for k in range(9)], determinant(a)
    parts = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    safe = F.when(d != 0, d)
    return F.when(d != 0, F.array(*[p / safe for p in parts]))


def rotated(t: Column, r: Column) -> Column:
    """r t r^T."""
    return bound(r, lambda m: bound(product(m, t), lambda half: product(half, transposed(m))))


def to_voigt(t: Column, shear: float = 1.0) -> Column:
    """Symmetric matrix to six parts; ``shear`` is 2 for engineering strains."""
    return F.array(at(t, 0), at(t, 4), at(t, 8), at(t, 5) * shear, at(t, 2) * shear, at(t, 1) * shear)


def from_voigt(v: Column, shear: float = 1.0) -> Column:
    a = [at(v, k) / (1.0 if k < 3 else shear) for k in range(6)]
    return F.array(a[0], a[5], a[4], a[5], a[1], a[3], a[4], a[3], a[2])


def cell_matrix(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Columns are the cell's vectors, a along x and b in the xy plane; angles in degrees."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cy = (ca - cb * cg) / sg
    return F.array(a, b * cg, c * cb, F.lit(0.0), b * sg, c * cy, F.lit(0.0), F.lit(0.0), c * F.sqrt(1 - cb * cb - cy * cy))


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    return a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)


def d_spacing(h: Column, k: Column, l: Column, a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:  # noqa: E741
    """Lattice spacing of any cell, from its reciprocal metric; null for (0, 0, 0)."""
    (ca, sa), (cb, sb), (cg, sg) = ((F.cos(F.radians(x)), F.sin(F.radians(x))) for x in (alpha, beta, gamma))
    squares = F.pow(h * b * c * sa, 2) + F.pow(k * a * c * sb, 2) + F.pow(l * a * b * sg, 2)
    mixed = h * k * a * b * c * c * (ca * cb - cg) + k * l * a * a * b * c * (cb * cg - ca) + h * l * a * b * b * c * (ca * cg - cb)
    return cell_volume(a, b, c, alpha, beta, gamma) / F.sqrt(F.nullif(squares + 2 * mixed, F.lit(0.0)))


def lattice_strain(strained: Column, reference: Column) -> Column:
    """Small strain between two cell matrices: the symmetric part of strained * reference^-1, less one."""
    def strain(f: Column) -> Column:
        return F.array(*[(at(f, 3 * i + j) + at(f, 3 * j + i)) / 2 - float(i == j) for i in range(3) for j in range(3)])

    return bound(reference, lambda r: bound(inverse(r), lambda i: bound(strained, lambda s: bound(product(s, i), strain))))


def hooke(strain: Column, c11: float, c12: float, c44: float) -> Column:
    """Stress of a cubic crystal, in Voigt order, from strains with tensor shears."""
    e = [at(strain, k) for k in range(6)]
    return F.array(*[c11 * e[i] + c12 * (e[(i + 1) % 3] + e[(i + 2) % 3]) for i in range(3)], *[2 * c44 * e[k] for k in (3, 4, 5)])


def hydrostatic(v: Column) -> Column:
    return (at(v, 0) + at(v, 1) + at(v, 2)) / 3


def deviatoric(v: Column) -> Column:
    return F.array(*[at(v, k) - hydrostatic(v) if k < 3 else at(v, k) for k in range(6)])


def von_mises(v: Column) -> Column:
    """Equivalent stress of six parts."""
    s = [at(v, k) for k in range(6)]
    return F.sqrt(((s[0] - s[1]) * (s[0] - s[1]) + (s[1] - s[2]) * (s[1] - s[2]) + (s[2] - s[0]) * (s[2] - s[0])) / 2 + 3 * (s[3] * s[3] + s[4] * s[4] + s[5] * s[5]))


def slip_systems(family: str = "fcc") -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """(plane, direction) of {111}<110> or {110}<111>, one of each opposite pair."""
    signs = [(x, y, z) for x in (1, -1) for y in (1, -1) for z in (1, -1)]
    full = [s for s in signs if s[0] == 1]
    edges = [e for e in ((0, 1, 1), (0, 1, -1), (1, 0, 1), (1, 0, -1), (1, 1, 0), (1, -1, 0))]
    planes, directions = (full, edges) if family == "fcc" else (edges, full)
    return [(n, b) for n in planes for b in directions if sum(x * y for x, y in zip(n, b, strict=True)) == 0]


def schmid_factors(load: Column, family: str = "fcc") -> Column:
    """Absolute Schmid factor of every slip system for a load direction in crystal axes."""
    size = total([at(load, k) * at(load, k) for k in range(3)])
    out = []
    for n, b in slip_systems(family):
        norm = math.sqrt(sum(x * x for x in n) * sum(x * x for x in b))
        out.append(F.abs(total([at(load, k) * n[k] for k in range(3)]) * total([at(load, k) * b[k] for k in range(3)])) / (size * norm))
    return F.array(*out)


def lorentzian_gaussian(x: Column | str, centre: Column | float, width: Column | float, share: Column | float) -> Column:
    """Pseudo-Voigt of unit height: ``share`` of the Lorentzian, full width at half height."""
    u = (col(x) - col(centre)) / col(width)
    return col(share) / (1 + 4 * u * u) + (1 - col(share)) * F.exp(-4 * math.log(2) * u * u)


def voigt_width(gauss: Column | str, lorentz: Column | str) -> tuple[Column, Column]:
    """Full width and Lorentzian share of the pseudo-Voigt that stands for a convolution, by the usual fifth-order sum."""
    g, w = col(gauss), col(lorentz)
    width = F.pow(F.pow(g, 5) + 2.69269 * F.pow(g, 4) * w + 2.42843 * F.pow(g, 3) * w * w + 4.47163 * g * g * F.pow(w, 3) + 0.07842 * g * F.pow(w, 4) + F.pow(w, 5), F.lit(0.2))
    r = w / width
    return width, 1.36603 * r - 0.47719 * r * r + 0.11116 * r * r * r


def sphere_form(q: Column | str, radius: Column | str) -> Column:
    """Form factor of a sphere, squared and 1 at q = 0."""
    x = col(q) * col(radius)
    f = 3 * (F.sin(x) - x * F.cos(x)) / F.pow(x, 3)
    return F.when(F.abs(x) < 1e-6, 1.0).otherwise(f * f)


def sine_transform(profile: DataFrame, grid: DataFrame, step: float, most: float | None = None) -> DataFrame:
    """(r, g, sigma) on a grid (r) from a structure factor (q, s, e): 2 / pi times the sum of q (s - 1) sin(q r) step, and its deviation from those of s. With ``most``, vectors beyond it are left out and the others damped by sin(x) / x, x = pi q / most."""
    x = math.pi * F.col("q") / most if most else None
    window = F.when(x == 0, 1.0).otherwise(F.sin(x) / x) if most else F.lit(1.0)
    kernel = F.col("q") * F.sin(F.col("q") * F.col("r")) * window
    points = profile.where(F.col("q") <= most) if most else profile
    met = points.crossJoin(F.broadcast(grid)).withColumn("__k", kernel)
    scale = 2 / math.pi * step
    return met.groupBy("r").agg((scale * F.sum((F.col("s") - 1) * F.col("__k"))).alias("g"), (scale * F.sqrt(F.sum(F.pow(F.col("__k") * F.col("e"), 2)))).alias("sigma"))
