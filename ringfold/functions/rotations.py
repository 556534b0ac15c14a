"""Rotations as arrays: quaternions (w, x, y, z), matrices by rows, Euler angles (Bunge), axes and angles; crystal symmetry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringfold.functions.columns import at, total, vector


def multiply(p: Column, q: Column) -> Column:
    """Product of two quaternions."""
    a, b, c, d = (at(p, k) for k in range(4))
    e, f, g, h = (at(q, k) for k in range(4))
    return F.array(a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def conjugate(q: Column) -> Column:
    return F.array(at(q, 0), -at(q, 1), -at(q, 2), -at(q, 3))


def normalised(q: Column) -> Column:
    """Unit quaternion with a non-negative first part."""
    n = F.sqrt(total([at(q, k) * at(q, k) for k in range(4)]))
    sign = F.when(at(q, 0) < 0, -1.0).otherwise(1.0)
    return F.transform(q, lambda x: x * sign / n)


def to_matrix(q: Column) -> Column:
    """Rotation matrix by rows."""
    w, x, y, z = (at(q, k) for k in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    )


def from_matrix(m: Column) -> Column:
    """Quaternion of a rotation matrix, by its largest part."""
    a = [at(m, k) for k in range(9)]
    squares = F.array(1 + a[0] + a[4] + a[8], 1 + a[0] - a[4] - a[8], 1 - a[0] + a[4] - a[8], 1 - a[0] - a[4] + a[8])
    big = F.array_position(squares, F.array_max(squares))
    h = F.sqrt(F.array_max(squares))
    first = F.array(h / 2, (a[7] - a[5]) / (2 * h), (a[2] - a[6]) / (2 * h), (a[3] - a[1]) / (2 * h))
    second = F.array((a[7] - a[5]) / (2 * h), h / 2, (a[1] + a[3]) / (2 * h), (a[2] + a[6]) / (2 * h))
    third = F.array((a[2] - a[6]) / (2 * h), (a[1] + a[3]) / (2 * h), h / 2, (a[5] + a[7]) / (2 * h))
    fourth = F.array((a[3] - a[1]) / (2 * h), (a[2] + a[6]) / (2 * h), (a[5] + a[7]) / (2 * h), h / 2)
    return normalised(F.when(big == 1, first).when(big == 2, second).when(big == 3, third).otherwise(fourth))


def from_euler(one: Column, middle: Column, two: Column) -> Column:
    """Quaternion of Bunge's z-x-z angles, in radians."""
    c, s, p, m = F.cos(middle / 2), F.sin(middle / 2), (one + two) / 2, (one - two) / 2
    return normalised(F.array(c * F.cos(p), s * F.cos(m), s * F.sin(m), c * F.sin(p)))


def to_euler(q: Column) -> Column:
    """Bunge's angles in radians, the outer two in [0, 2 pi); where the middle is 0 or pi the last is 0."""
    w, x, y, z = (at(q, k) for k in range(4))
    flat, tilted = F.sqrt(w * w + z * z), F.sqrt(x * x + y * y)
    p, m, full = F.atan2(z, w), F.atan2(y, x), F.lit(2 * math.pi)
    single = tilted < 1e-10
    opposite = flat < 1e-10
    one = F.when(single, 2 * p).when(opposite, 2 * m).otherwise(p + m)
    two = F.when(single | opposite, 0.0).otherwise(p - m)
    return F.array(F.pmod(one, full), 2 * F.atan2(tilted, flat), F.pmod(two, full))


def axis_angle(q: Column) -> Column:
    """(x, y, z, degrees) of a unit quaternion; the axis of no rotation is z."""
    s = F.sqrt(at(q, 1) * at(q, 1) + at(q, 2) * at(q, 2) + at(q, 3) * at(q, 3))
    none = s < 1e-12
    return F.array(*[F.when(none, float(k == 3)).otherwise(at(q, k) / F.when(none, 1.0).otherwise(s)) for k in (1, 2, 3)], F.degrees(2 * F.atan2(s, F.abs(at(q, 0)))))


def rodrigues(q: Column) -> Column:
    """Axis times the tangent of half the angle; null at half a turn."""
    return F.when(F.abs(at(q, 0)) > 1e-12, F.array(*[at(q, k) / at(q, 0) for k in (1, 2, 3)]))


def _close(parts: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
    """The group that these quaternions span, by repeated products; first non-zero part positive."""

    def product(p: tuple[float, ...], q: tuple[float, ...]) -> tuple[float, ...]:
        a, b, c, d = p
        e, f, g, h = q
        r = (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)
        lead = next(x for x in r if abs(x) > 1e-9)
        return tuple(round(x * math.copysign(1, lead), 12) + 0.0 for x in r)

    group = [(1.0, 0.0, 0.0, 0.0)]
    for p in group:
        for g in parts:
            r = product(p, g)
            if not any(max(abs(x - y) for x, y in zip(r, s, strict=True)) < 1e-9 for s in group):
                group.append(r)
    return group


def symmetry(laue: str) -> list[tuple[float, ...]]:
    """Proper rotations of a Laue group as quaternions, spanned by turns about its axes."""

    def turn(n: int, *axis: float) -> tuple[float, ...]:
        size, half = math.sqrt(sum(x * x for x in axis)), math.pi / n
        return (math.cos(half), *(math.sin(half) * x / size for x in axis))

    z, x, diagonal = (0, 0, 1), (1, 0, 0), (1, 1, 1)
    spans = {
        "-1": [], "2/m": [turn(2, 0, 1, 0)], "mmm": [turn(2, *z), turn(2, *x)], "4/m": [turn(4, *z)], "4/mmm": [turn(4, *z), turn(2, *x)],
        "-3": [turn(3, *z)], "-3m": [turn(3, *z), turn(2, *x)], "6/m": [turn(6, *z)], "6/mmm": [turn(6, *z), turn(2, *x)],
        "m-3": [turn(2, *z), turn(3, *diagonal)], "m-3m": [turn(4, *z), turn(3, *diagonal)],
    }
    return _close(spans[laue])


def symmetry_column(laue: str) -> Column:
    return F.array(*[vector(*q) for q in symmetry(laue)])


def nearness(turned: list[Column], laue: str) -> Column:
    """Largest size of the first part that a rotation, given by its four parts, takes under a Laue group.

    Plain arithmetic, for conditions on pairs: where a group holds all signs of one pattern of
    parts, these are one sum of sizes.
    """
    kinds: dict[tuple[float, ...], list[tuple[float, ...]]] = {}
    for s in symmetry(laue):
        kinds.setdefault(tuple(abs(x) for x in s), []).append(s)
    offers = []
    for sizes, signed in kinds.items():
        parts = [k for k in range(4) if sizes[k]]
        whole = len(signed) == 2 ** (len(parts) - 1)
        offers += [total([F.abs(turned[k]) * sizes[k] for k in parts])] if whole else [F.abs(total([turned[k] * s[k] for k in parts])) for s in signed]
    return F.greatest(*offers) if len(offers) > 1 else offers[0]


def misorientation(p: Column, q: Column, laue: str = "-1") -> Column:
    """Smallest angle between two orientations under a Laue group, in degrees."""
    a, b, c, d = (at(p, k) for k in range(4))
    e, f, g, h = (at(q, k) for k in range(4))
    turned = [a * e + b * f + c * g + d * h, a * f - b * e - c * h + d * g, a * g + b * h - c * e - d * f, a * h - b * g + c * f - d * e]
    return F.degrees(2 * F.acos(F.least(nearness(turned, laue), F.lit(1.0))))


def fundamental(q: Column, laue: str) -> Column:
    """The symmetric equivalent nearest the identity."""
    options = F.transform(symmetry_column(laue), lambda s: normalised(multiply(q, s)))
    return F.get(F.array_sort(options, lambda a, b: F.when(F.get(a, F.lit(0)) > F.get(b, F.lit(0)), -1).when(F.get(a, F.lit(0)) < F.get(b, F.lit(0)), 1).otherwise(0)), F.lit(0))


def about_z(degrees: Column) -> Column:
    """Matrix, by rows, of a turn about z."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, s, c, zero, zero, zero, one)
