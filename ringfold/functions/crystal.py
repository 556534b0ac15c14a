"""Crystals: space groups from Hall symbols, absences, multiplicities, structure factors, inverse pole figure colours.

A space group is a short list of operations, rotations and translations in 24ths of the cell,
worked out on the driver; reflections and atoms are tables.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.functions.columns import at, total

Operation = tuple[tuple[int, ...], tuple[int, int, int]]
_CELL = 24

# Translations of lattice and symbol letters, in 24ths.
_LATTICES = {"P": [], "A": [(0, 12, 12)], "B": [(12, 0, 12)], "C": [(12, 12, 0)], "I": [(12, 12, 12)], "R": [(16, 8, 8), (8, 16, 16)], "F": [(0, 12, 12), (12, 0, 12), (12, 12, 0)]}
_LETTERS = {"a": (12, 0, 0), "b": (0, 12, 0), "c": (0, 0, 12), "n": (12, 12, 12), "u": (6, 0, 0), "v": (0, 6, 0), "w": (0, 0, 6), "d": (6, 6, 6)}
# Rotations about z, and the twofold axes across it, by rows.
_TURNS = {1: (1, 0, 0, 0, 1, 0, 0, 0, 1), 2: (-1, 0, 0, 0, -1, 0, 0, 0, 1), 3: (0, -1, 0, 1, -1, 0, 0, 0, 1), 4: (0, -1, 0, 1, 0, 0, 0, 0, 1), 6: (1, -1, 0, 1, 0, 0, 0, 0, 1)}
_ACROSS = {"'": (0, -1, 0, -1, 0, 0, 0, 0, -1), '"': (0, 1, 0, 1, 0, 0, 0, 0, -1)}
_DIAGONAL = (0, 0, 1, 1, 0, 0, 0, 1, 0)


def _about(matrix: tuple[int, ...], axis: str) -> tuple[int, ...]:
    """A rotation about z as one about another axis, by turning the axes round."""
    step = {"z": 0, "x": 1, "y": 2}[axis]
    return tuple(matrix[3 * ((i - step) % 3) + (j - step) % 3] for i in range(3) for j in range(3))


def _times(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3))


def _moved(a: tuple[int, ...], v: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(sum(a[3 * i + k] * v[k] for k in range(3)) for i in range(3))


def generators(symbol: str) -> tuple[list[Operation], list[tuple[int, int, int]]]:
    """Generating operations and lattice translations of a Hall symbol, such as ``-F 4 2 3`` or ``-P 2ybc``.

    Axes that the symbol leaves out follow from their place: the first rotation is about z, a
    second twofold one about x after 2 or 4 and along a - b after 3 or 6, a threefold one in
    third place along the body's diagonal.
    """
    head = re.fullmatch(r"\s*(-?)\s*([PABCIRF])\s*((?:[^()]*))(?:\(([^)]*)\))?\s*", symbol)
    if not head:
        raise ValueError(f"no Hall symbol: {symbol}")
    found: list[Operation] = []
    if head[1]:
        found.append((tuple(-x for x in _TURNS[1]), (0, 0, 0)))
    before = ("", 0)
    for place, word in enumerate(head[3].split()):
        m = re.fullmatch(r"""(-?)([12346])([1-5]?)([xyz]?)(['"*]?)([xyz]?)([abcnuvwd]*)""", word)
        if not m:
            raise ValueError(f"no rotation of a Hall symbol: {word}")
        n, axis, sign = int(m[2]), m[4] or m[6], m[5]
        if not axis and not sign:
            if place and n == 2:
                axis, sign = ("x", "") if before[1] in (2, 4) else (before[0], "'")
            elif place >= 1 and n == 3:
                sign = "*"
        axis = axis or (before[0] if sign in ("'", '"') and before[0] else "z")
        if sign == "*":
            matrix = _DIAGONAL
        elif sign:
            if n != 2:
                raise ValueError(f"only twofold axes lie across: {word}")
            matrix = _about(_ACROSS[sign], axis)
        else:
            matrix = _about(_TURNS[n], axis)
        shift = [0, 0, 0]
        if m[3]:
            shift["xyz".index(axis)] += _CELL * int(m[3]) // n
        for letter in m[7]:
            shift = [a + b for a, b in zip(shift, _LETTERS[letter], strict=True)]
        if m[1]:
            matrix = tuple(-x for x in matrix)
        found.append((matrix, tuple(x % _CELL for x in shift)))
        before = (axis, n)
    if head[4]:
        v = tuple(2 * int(x) for x in head[4].split())
        found = [(r, tuple((t + a - b) % _CELL for t, a, b in zip(shift, v, _moved(r, v), strict=True))) for r, shift in found]
    return found, _LATTICES[head[2]]


@functools.cache
def operations(symbol: str) -> tuple[Operation, ...]:
    """All operations of a space group, lattice translations with them, by repeated products."""
    start, lattice = generators(symbol)
    start = start + [(_TURNS[1], t) for t in lattice]
    group: dict[Operation, None] = {(_TURNS[1], (0, 0, 0)): None}
    todo = list(group)
    while todo:
        r, t = todo.pop()
        for s, u in start:
            new = (_times(r, s), tuple((a + b) % _CELL for a, b in zip(_moved(r, u), t, strict=True)))
            if new not in group:
                if len(group) >= 192:
                    raise ValueError(f"{symbol} spans no space group")
                group[new] = None
                todo.append(new)
    return tuple(group)


def _table(symbol: str) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in (*r, *t)]) for r, t in operations(symbol)])


def absent(h: Column, k: Column, l: Column, symbol: str) -> Column:  # noqa: E741
    """Whether the space group extinguishes a reflection: an operation leaves it in place and shifts its phase."""
    def hit(op: Column) -> Column:
        x = [at(op, j) for j in range(12)]
        stays = total([F.abs(h * x[j] + k * x[3 + j] + l * x[6 + j] - v) for j, v in enumerate((h, k, l))]) == 0
        return stays & ((h * x[9] + k * x[10] + l * x[11]) % _CELL != 0)

    return F.exists(_table(symbol), hit)


def family(h: Column, k: Column, l: Column, symbol: str) -> Column:  # noqa: E741
    """All reflections equivalent to one by symmetry and inversion, sorted, as an array of (h, k, l) arrays."""
    def turned(op: Column) -> Column:
        x = [at(op, j) for j in range(9)]
        return F.array(*[h * x[j] + k * x[3 + j] + l * x[6 + j] for j in range(3)])

    ones = F.transform(_table(symbol), turned)
    return F.array_sort(F.array_distinct(F.concat(ones, F.transform(ones, lambda v: F.transform(v, lambda c: -c)))))


def unit_cell(atoms: list[tuple[str, float, float, float]], symbol: str) -> list[tuple[str, float, float, float]]:
    """All atoms of the cell that symmetry makes of the given ones, each once."""
    out: dict[tuple, tuple] = {}
    for name, *place in atoms:
        for r, t in operations(symbol):
            new = [(sum(r[3 * i + k] * place[k] for k in range(3)) + t[i] / _CELL) % 1.0 for i in range(3)]
            new = [0.0 if x > 1 - 1e-9 else round(x, 9) for x in new]
            out[name, *new] = (name, *new)
    return list(out.values())


def structure_factors(reflections: DataFrame, atoms: DataFrame, s2: str) -> DataFrame:
    """(h, k, l, real, imaginary, intensity) of ``reflections`` (h, k, l, s2 = sin^2 theta / lambda^2) for the cell's ``atoms`` (x, y, z, f, b): scattering lengths f with Debye-Waller factors exp(-b s2). The cell's atoms are few."""
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    size = F.col("f") * F.exp(-F.col("b") * F.col(s2))
    met = reflections.crossJoin(F.broadcast(atoms))
    sums = met.groupBy("h", "k", "l").agg(F.sum(size * F.cos(phase)).alias("real"), F.sum(size * F.sin(phase)).alias("imaginary"))
    return sums.withColumn("intensity", F.col("real") * F.col("real") + F.col("imaginary") * F.col("imaginary"))


def lorentz_polarisation(two_theta: Column, share: float = 0.5) -> Column:
    """(1 - K + K cos^2 2theta) / (sin^2 theta cos theta) of an angle in radians; K of 0.5 is unpolarised."""
    half = two_theta / 2
    return (1 - share + share * F.cos(two_theta) * F.cos(two_theta)) / (F.sin(half) * F.sin(half) * F.cos(half))


def pole_colour(direction: Column, family_: str = "cubic", gamma: float = 0.5) -> Column:
    """Red, green and blue of a direction in crystal axes, folded into the standard triangle, as an array."""
    size = F.sqrt(total([at(direction, k) * at(direction, k) for k in range(3)]))
    unit = F.transform(direction, lambda x: F.abs(x) / size)
    if family_ == "cubic":
        s = F.array_sort(unit)
        raw = F.array(at(s, 2) - at(s, 1), (at(s, 1) - at(s, 0)) * math.sqrt(2.0), at(s, 0) * math.sqrt(3.0))
    elif family_ == "hexagonal":
        flat = F.sqrt(at(unit, 0) * at(unit, 0) + at(unit, 1) * at(unit, 1))
        angle = F.pmod(F.degrees(F.atan2(at(unit, 1), at(unit, 0))), F.lit(60.0))
        share = F.least(F.greatest(F.least(angle, 60 - angle) / 30, F.lit(0.0)), F.lit(1.0))
        raw = F.array(at(unit, 2), flat * (1 - share), flat * share)
    else:
        raise ValueError(f"no triangle for {family_}")
    most = F.array_max(raw)
    return F.transform(raw, lambda x: F.pow(x / most, F.lit(gamma)))
