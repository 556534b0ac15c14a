"""Searches and iterative kernels: indexing of seeds, inversion of the detector's geometry, best solutions, medoids, smoothing of labels, selection of measurements.

What is iterative on one group's rows runs in one task for each group and says so; candidates
and matches are joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions import geometry, rotations
from ringfold.functions.columns import bound
from ringfold.operators import matching


def _angles(quats: np.ndarray, one: np.ndarray, laue: str) -> np.ndarray:
    """Misorientations, in degrees, of unit quaternions to one."""
    a, b, c, d = one
    w, x, y, z = quats.T
    turned = np.stack([a * w + b * x + c * y + d * z, a * x - b * w - c * z + d * y, a * y + b * z - c * w - d * x, a * z - b * y + c * x - d * w])
    return np.degrees(2 * np.arccos(np.minimum(np.abs(np.array(rotations.symmetry(laue)) @ turned).max(axis=0), 1.0)))


def best_solutions(offers: DataFrame, voxel: str, order: str, q: str, score: str, most: int, least_angle: float, laue: str) -> DataFrame:
    """(voxel, place, order, score): the ``most`` best of a voxel's offers, in the order of their coming: one within ``least_angle`` of a held one is turned away even if it is better, equal scores go before. With one place there is nothing to compare, and the best stays. A voxel is one task's work."""
    kinds = dict(offers.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        quats = np.array(rows[q].tolist(), float)
        quats /= np.linalg.norm(quats, axis=1, keepdims=True)
        held: list[int] = []
        scores = rows[score].to_numpy(float)
        for k in range(len(rows)):
            if most > 1 and least_angle > 0 and held and (_angles(quats[held], quats[k], laue) < least_angle).any():
                continue
            at = next((i for i, h in enumerate(held) if scores[k] >= scores[h]), len(held))
            held.insert(at, k)
            del held[most:]
        return pd.DataFrame({voxel: rows[voxel].iloc[held], "place": np.arange(len(held), dtype=np.int32), "offer": rows[order].iloc[held], "score": scores[held]})

    return offers.select(voxel, order, q, score).groupBy(voxel).applyInPandas(run, f"{voxel} {kinds[voxel]}, place int, offer {kinds[order]}, score double")


#: Rows of a group whose square of angles is held, 128 MB at most.
SQUARE_ROWS = 4096


class _Centre:
    """Finds, of any part of a table of orientations, the first with the least sum of angles to all of the part, without a square of angles.

    Rows stand in boxes of near ones. An angle to one point is convex along the arc between two
    others, while the same symmetry stays nearest: so a box's angles to a row sum up to no less
    than the box's middle and the slope there tell. Where another symmetry may be nearer, or
    beyond half a turn, the triangle's inequality serves. Only rows whose bound is below the least
    sum found are looked at. Of those the sums to all rows of smaller boxes are kept, so that later
    only boxes that are members in part are summed again.
    """

    def __init__(self, quats: np.ndarray, laue: str, most: int = 60_000_000):
        self.quats, self.laue, self.group = quats, laue, np.array(rotations.symmetry(laue))
        # signed symmetries of which all signs are there are one sum of sizes
        kinds: dict[tuple[float, ...], list[tuple[float, ...]]] = {}
        for x in self.group.tolist():
            kinds.setdefault(tuple(round(abs(f), 9) for f in x), []).append(x)
        self.even, self.odd = {}, []
        for sizes, signed in kinds.items():
            used = [k for k in range(4) if sizes[k]]
            if len(signed) == 2 ** (len(used) - 1) and len({sizes[k] for k in used}) == 1:
                self.even.setdefault(sizes[used[0]], []).append(used)
            else:
                self.odd += signed
        self.even = {len(found[0]) ** -0.5: found for found in self.even.values()}
        n = len(quats)
        best, image = np.full(n, -1.0), quats.copy()
        for s in self.group:
            turned = matching._times(quats, s)
            better = np.abs(turned[:, 0]) > best
            best[better], image[better] = np.abs(turned[better, 0]), turned[better]
        image *= np.where(image[:, :1] < 0, -1.0, 1.0)
        boxes = [np.arange(n)]
        while 12 * len(boxes) * n <= most and max(map(len, boxes)) > 16:
            boxes = [h for b in boxes for h in self._halves(b, image)]
        self.box = np.empty(n, np.int64)
        for k, b in enumerate(boxes):
            self.box[b] = k
        # all rows by smaller boxes, of whose sums those once made are kept, in blocks
        small = boxes
        while 2 * len(small) <= 1024 and max(map(len, small)) > 16:
            small = [h for b in small for h in self._halves(b, image)]
        self.small = np.empty(n, np.int64)
        for k, b in enumerate(small):
            self.small[b] = k
        self.by_box, self.sizes = np.concatenate(small), np.array([len(b) for b in small])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at, self.held = np.full(n, -1, np.int64), []
        middle = np.stack([image[b].sum(axis=0) for b in boxes])
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)
        own = middle[self.box]
        cosine = np.minimum((image * own).sum(axis=1), 1.0)
        half = np.arccos(np.maximum(cosine, -1.0))
        across = image - cosine[:, None] * own
        size = np.linalg.norm(across, axis=1)
        # arcs from the boxes' middles to their rows, as angles of rotation
        self.arc = np.where(size[:, None] > 1e-12, across / np.maximum(size, 1e-300)[:, None], 0.0) * np.degrees(2 * half)[:, None]
        self.off = np.degrees(2 * half)
        widest = np.zeros(len(boxes))
        np.maximum.at(widest, self.box, self.off)
        self.table = np.empty((n, 6, len(boxes)), np.float32)
        step = max(1, (1 << 21) // (len(self.group) * len(boxes)))
        for k in range(0, n, step):
            part = quats[k : k + step]
            images = np.stack([matching._times(part, s) for s in self.group], axis=1)
            dots = images.reshape(-1, 4) @ middle.T
            sign = dots.reshape(len(part), len(self.group), -1)
            sizes = np.abs(sign)
            which = sizes.argmax(axis=1)[:, None]
            nearest = np.take_along_axis(sizes, which, 1)[:, 0]
            first = np.degrees(2 * np.arccos(np.minimum(nearest, 1.0)))
            np.put_along_axis(sizes, which, -1.0, 1)
            second = np.degrees(2 * np.arccos(np.clip(sizes.max(axis=1), -1.0, 1.0)))
            there = images[np.arange(len(part))[:, None], which[:, 0]] * np.where(np.take_along_axis(sign, which, 1)[:, 0] < 0, -1.0, 1.0)[:, :, None]
            sure = (second - first > 2 * widest * (1 + 1e-6) + 1e-6) & (first + widest < 179.9) & (first > 0.01)
            slope = np.where(sure, -1.0 / np.maximum(np.sqrt(np.maximum(1 - nearest * nearest, 0.0)), 1e-9), 0.0)
            self.table[k : k + step, 0], self.table[k : k + step, 1] = first, np.where(sure, 0.0, -1.0)
            self.table[k : k + step, 2:] = ((there - nearest[:, :, None] * middle) * slope[:, :, None]).transpose(0, 2, 1)

    @staticmethod
    def _halves(rows: np.ndarray, image: np.ndarray) -> list[np.ndarray]:
        if len(rows) < 2:
            return [rows]
        axis = int(np.ptp(image[rows], axis=0).argmax())
        order = rows[np.argsort(image[rows, axis], kind="stable")]
        return [order[: len(order) // 2], order[len(order) // 2 :]]

    def _far(self, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Angles of some rows to some others."""
        best, (a, b, c, d) = np.zeros((len(some), len(others))), self.quats[some].T
        turns = [np.stack(x, axis=1) for x in ((a, b, c, d), (-b, a, d, -c), (-c, -d, a, b), (-d, c, -b, a))]
        for k in range(0, len(others), 2048):
            their, out = self.quats[others[k : k + 2048]].T, best[:, k : k + 2048]
            parts = [x @ their for x in turns]
            for signed in self.odd:
                np.maximum(out, np.abs(sum(x * f for x, f in zip(parts, signed, strict=True) if f)), out=out)
            for x in parts:
                np.abs(x, out=x)
            for size, kinds in self.even.items():
                most = None
                for used in kinds:
                    offer = parts[used[0]]
                    for j in used[1:]:
                        offer = offer + parts[j]
                    most = offer.copy() if most is None else np.maximum(most, offer, out=most)
                np.maximum(out, most * size, out=out)
            np.arccos(np.minimum(out, 1.0, out=out), out=out)
        best *= math.degrees(2)
        return best

    def _known(self, some: np.ndarray) -> np.ndarray:
        """Sums of the angles of some rows to all rows of each box, which are kept."""
        new = some[self.at[some] < 0]
        for k in range(0, len(new), 32):
            part = new[k : k + 32]
            self.at[part] = len(self.held) * 32 + np.arange(len(part))
            # a block of 32, of which the last may be filled in part
            block = np.zeros((32, len(self.starts)))
            block[: len(part)] = np.add.reduceat(self._far(part, self.by_box), self.starts, axis=1)
            self.held.append(block)
        rows = self.at[some]
        return np.stack([self.held[r >> 5][r & 31] for r in rows.tolist()]) if len(rows) else np.zeros((0, len(self.starts)))

    def _bound(self, members: np.ndarray, of: np.ndarray) -> np.ndarray:
        """What sums of angles to some rows aren't below, for all of the members. What single precision may add is taken off."""
        columns = [np.ones(len(of)), self.off[of], *self.arc[of].T]
        vector = np.concatenate([np.bincount(self.box[of], c, self.table.shape[2]) for c in columns]).astype(np.float32)
        return (self.table.reshape(len(self.quats), -1) @ vector)[members].astype(float) - 0.005 * len(of)

    def of(self, members: np.ndarray, guess: int) -> int:
        """Place among the members."""
        n, whole = len(members), np.bincount(self.small[members], minlength=len(self.starts)) == self.sizes
        # only boxes that are members in part are looked at again, others' sums are known
        rest = members[~whole[self.small[members]]]
        bound, part = self._bound(members, members), self._bound(members, rest)
        slack, sums = 1e-7 * n, np.full(n, np.inf)

        def look(some: np.ndarray, known: np.ndarray) -> None:
            sums[some] = known[:, whole].sum(axis=1) + self._far(members[some], rest).sum(axis=1)

        look(np.array([guess]), self._known(members[[guess]]))
        order, k = np.argsort(bound, kind="stable"), 0
        while k < n and bound[order[k]] <= sums.min() * (1 + 1e-9) + slack:
            some = order[k : k + 512]
            some = some[bound[some] <= sums.min() * (1 + 1e-9) + slack]
            known, k = self._known(members[some]), k + 512
            finer = known[:, whole].sum(axis=1) + part[some]
            ranks = np.argsort(finer, kind="stable")
            for r in range(0, len(ranks), 32):
                near = ranks[r : r + 32]
                near = near[finer[near] <= sums.min() * (1 + 1e-9) + slack]
                if not len(near):
                    break
                look(some[near], known[near])
        # equal sums are told apart by place, so those that are nearly equal are summed in one way
        last = np.flatnonzero(sums <= sums.min() * (1 + 1e-9) + slack)
        return int(last[np.argmin([_angles(self.quats[members], self.quats[members[i]], self.laue).sum() for i in last])])


def medoids(df: DataFrame, group: str, node: str, q: str, laue: str, k: int, starts: int = 10, seed: int = 1, rounds: int = 200) -> DataFrame:
    """(group, node, medoid): each node's nearest of k medoids by misorientation, the best of several seeded starts. A group is one task's work; beyond ``SQUARE_ROWS`` it holds sums of its angles by boxes, no square of them."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(node)
        quats = np.array(rows[q].tolist(), float)
        quats /= np.linalg.norm(quats, axis=1, keepdims=True)
        rng, best, after = np.random.default_rng(seed), (math.inf, None), {}
        square = np.stack([_angles(quats, one, laue) for one in quats]) if len(rows) <= SQUARE_ROWS else None
        centre = _Centre(quats, laue) if square is None else None

        def nearest(mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            far = square[:, mid] if square is not None else np.stack([_angles(quats, quats[m], laue) for m in mid], axis=1)
            label = far.argmin(axis=1)
            return label, far[np.arange(len(rows)), label]

        def central(m: np.ndarray, guess: int) -> int:
            return int(square[np.ix_(m, m)].sum(axis=1).argmin()) if square is not None else centre.of(m, int(np.searchsorted(m, guess)))

        for _ in range(starts):
            mid = rng.choice(len(rows), min(k, len(rows)), replace=False)
            for _ in range(rounds):
                if (new := after.get(tuple(mid))) is None:
                    label, _far = nearest(mid)
                    held = [np.flatnonzero(label == j) for j in range(len(mid))]
                    new = np.array([m[central(m, int(mid[j]))] if len(m) else rng.integers(len(rows)) for j, m in enumerate(held)])
                    if all(len(m) for m in held):
                        # starts that come to the same medoids go on alike
                        after[tuple(mid)] = new
                if (new == mid).all():
                    break
                mid = new
            label, far = nearest(mid)
            if (cost := far.sum()) < best[0]:
                best = (cost, mid[label])
        return pd.DataFrame({group: rows[group], node: rows[node], "medoid": rows[node].to_numpy()[best[1]]})

    return df.select(group, node, q).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {node} {kinds[node]}, medoid {kinds[node]}")


def smoothed_labels(posterior: DataFrame, group: str, y: str, x: str, grain: str, p: str, penalty: float, floor: float = 0.05, rounds: int = 30) -> DataFrame:
    """(group, y, x, grain): labels of a map smoothed by its neighbours, pixel by pixel in reading order until none changes: each takes the grain with the least of its own cost, weighted by how clearly its best grain leads, plus ``penalty`` for each of its four neighbours that differs. Pixels without evidence stay out. A map is one task's work."""
    kinds = dict(posterior.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(rows[grain].unique())
        low_y, low_x = rows[y].min(), rows[x].min()
        height, width = rows[y].max() - low_y + 1, rows[x].max() - low_x + 1
        field = np.zeros((len(names), height, width))
        field[np.searchsorted(names, rows[grain]), rows[y] - low_y, rows[x] - low_x] = rows[p]
        active = field.max(axis=0) > 0
        ranked = np.sort(field, axis=0)[::-1]
        lead = ranked[0] - (ranked[1] if len(names) > 1 else 0.0)
        weight = lead / max(field.max(), 1e-300) + floor
        cost = -np.log(field + 1e-6) * weight
        label = field.argmax(axis=0)
        for _ in range(rounds):
            changed = 0
            for i in range(height):
                for j in range(width):
                    if not active[i, j]:
                        continue
                    total = cost[:, i, j].copy()
                    for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                        if 0 <= a < height and 0 <= b < width and active[a, b]:
                            total += penalty
                            total[label[a, b]] -= penalty
                    best = int(total.argmin())
                    changed += best != label[i, j]
                    label[i, j] = best
            if not changed:
                break
        at = np.argwhere(active)
        return pd.DataFrame({group: rows[group].iloc[0], y: at[:, 0] + low_y, x: at[:, 1] + low_x, grain: names[label[active]]})

    return posterior.select(group, y, x, grain, p).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {y} {kinds[y]}, {x} {kinds[x]}, {grain} {kinds[grain]}")


def pixels_at(targets: DataFrame, radius: str, angle: str, distance: float, tilts: tuple[float, float, float], most: float, p: list[float], rounds: int = 12) -> DataFrame:
    """Adds y and z: the place on a tilted, distorted detector that is seen at a radius and an azimuth, by Newton's method from the flat detector's place, all rows at once."""
    a, b, c = (math.radians(t) for t in tilts)
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    m = rx @ ry @ rz

    def seen(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distorted coordinates in the plane across the beam."""
        scale = distance / (distance + m[0, 1] * y + m[0, 2] * z)
        u, v = (m[1, 1] * y + m[1, 2] * z) * scale, (m[2, 1] * y + m[2, 2] * z) * scale
        r, e = np.hypot(u, v), np.radians(90 - np.degrees(np.arctan2(-u, v)))
        x = r / most
        d = 1 + p[0] * x**2 * np.cos(2 * e) + p[1] * x**4 * np.cos(4 * e + math.radians(p[3])) + p[2] * x**2
        return u * d, v * d

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            t = np.radians(rows[angle].to_numpy(float))
            u, v = -rows[radius].to_numpy(float) * np.sin(t), rows[radius].to_numpy(float) * np.cos(t)
            y, z, h = u.copy(), v.copy(), 1e-4
            for _ in range(rounds):
                (f, g), (fy, gy), (fz, gz) = seen(y, z), seen(y + h, z), seen(y, z + h)
                a11, a12, a21, a22 = (fy - f) / h, (fz - f) / h, (gy - g) / h, (gz - g) / h
                det = a11 * a22 - a12 * a21
                y, z = y - (a22 * (f - u) - a12 * (g - v)) / det, z - (a11 * (g - v) - a21 * (f - u)) / det
            yield rows.assign(y=y, z=z)

    kinds = ", ".join(f"`{c}` {k}" for c, k in targets.dtypes)
    return targets.mapInPandas(run, f"{kinds}, y double, z double")


def chosen_measurements(rows: list[tuple], most: int, ridge: float = 1e-9) -> list[tuple[object, float]]:
    """(name, information) of a short list of (name, sensitivities), taken one by one: each time the one that adds most to the logarithm of the determinant of the information matrix."""
    if len(rows) > 10_000:
        raise ValueError("measurements are chosen from a short list only")
    names, g = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    info, out, left = ridge * np.eye(g.shape[1]), [], list(range(len(rows)))
    while left and len(out) < most:
        gains = [math.log1p(float(g[k] @ np.linalg.solve(info, g[k]))) for k in left]
        k = left.pop(int(np.argmax(gains)))
        info = info + np.outer(g[k], g[k])
        out.append((names[k], float(np.linalg.slogdet(info)[1])))
    return out


def guinier(points: DataFrame, q: str, intensity: str, weight: str, reach: float = 1.3, start: float = 10.0, rounds: int = 20) -> dict[str, float]:
    """Radius of gyration and forward intensity: a weighted line of ln I over q^2 for q up to reach / radius, repeated until the radius stays. Five sums come to the driver each round."""
    radius, out = start, {}
    for k in range(rounds):
        fine = points.where((F.col(q) > 0) & (F.col(q) <= reach / radius) & (F.col(intensity) > 0))
        x, y, w = F.col(q) * F.col(q), F.log(intensity), F.col(weight) * F.col(intensity) * F.col(intensity)
        n, s, sx, sy, sxx, sxy = fine.agg(F.count("*"), F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y)).first()
        if n < 3:
            break
        d = s * sxx - sx * sx
        slope, level = (s * sxy - sx * sy) / d, (sxx * sy - sx * sxy) / d
        new = math.sqrt(max(-3 * slope, 1e-30))
        done = abs(new - radius) / max(radius, 1e-30) < 1e-4
        radius, out = new, {"radius": new, "forward": math.exp(level), "points": n, "rounds": k + 1}
        if done:
            break
    return out


def candidate_orientations(seeds: DataFrame, g: str, hkl: str, step: float) -> DataFrame:
    """One row for every orientation, ``step`` degrees apart about the seed's scattering vector, that turns its crystal direction onto it: adds ``turn`` and ``q``. ``g`` and ``hkl`` are arrays of three."""
    def unit(v: Column) -> Column:
        return bound(v, lambda x: F.transform(x, lambda c: c / F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, d: s + d * d))))

    a, b = unit(F.transform(hkl, lambda x: x.cast("double"))), unit(F.col(g))
    # the shortest turn from a to b: its axis is across both; opposite vectors turn about any axis across
    both = seeds.withColumn("__a", a).withColumn("__b", b).withColumn("__d", F.col("__a")[0] * F.col("__b")[0] + F.col("__a")[1] * F.col("__b")[1] + F.col("__a")[2] * F.col("__b")[2])
    cross = F.array(*[F.col("__a")[(k + 1) % 3] * F.col("__b")[(k + 2) % 3] - F.col("__a")[(k + 2) % 3] * F.col("__b")[(k + 1) % 3] for k in range(3)])
    aside = F.when(F.abs(F.col("__a")[0]) < 0.9, F.array(F.lit(0.0), F.lit(0.0), F.col("__a")[2], -F.col("__a")[1])).otherwise(F.array(F.lit(0.0), -F.col("__a")[2], F.lit(0.0), F.col("__a")[0]))
    first = F.when(F.col("__d") < -1 + 1e-12, aside).otherwise(F.concat(F.array(1 + F.col("__d")), cross))
    turns = F.explode(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(360 / step) - 1)), lambda n: n * float(step)))
    every = both.withColumn("__f", bound(first, rotations.normalised)).withColumn("turn", turns)
    half = F.radians(F.col("turn") / 2)
    about = F.concat(F.array(F.cos(half)), F.transform("__b", lambda x: x * F.sin(half)))
    return every.withColumn("q", bound(about, lambda p: rotations.multiply(p, F.col("__f")))).drop("__a", "__b", "__d", "__f")


def predicted(candidates: DataFrame, key: list[str], q: str, reflections: DataFrame, wavelength: float, lattice: float) -> DataFrame:
    """(key, ring, omega, eta): every spot that a cubic crystal's reflections (h, k, l, ring) give in each orientation."""
    m = candidates.select(*key, rotations.to_matrix(F.col(q)).alias("__m"))
    met = m.crossJoin(F.broadcast(reflections))
    g = met.select(*key, "ring", *[((F.col("__m")[3 * i] * F.col("h") + F.col("__m")[3 * i + 1] * F.col("k") + F.col("__m")[3 * i + 2] * F.col("l")) / lattice).alias(f"__g{i}") for i in range(3)],
                   F.degrees(F.asin(wavelength * F.sqrt((F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")).cast("double")) / (2 * lattice))).alias("__t"))
    w = g.select("*", F.explode(geometry.omega_solutions(F.col("__g0"), F.col("__g1"), F.col("__g2"), F.col("__t"))).alias("omega"))
    y = F.sin(F.radians("omega")) * F.col("__g0") + F.cos(F.radians("omega")) * F.col("__g1")
    return w.select(*key, "ring", "omega", geometry.eta(y, F.col("__g2")).alias("eta"))


def indexed(seeds: DataFrame, observed: DataFrame, reflections: DataFrame, seed: str, g: str, hkl: str, step: float, wavelength: float, lattice: float, omega_tolerance: float, eta_tolerance: float) -> DataFrame:
    """(seed, turn, q, matched, total, share): for each seed the candidate orientation whose predicted spots are observed most, ties to the smaller turn. ``observed``: (spot, ring, omega, eta)."""
    c = candidate_orientations(seeds, g, hkl, step)
    p = predicted(c, [seed, "turn"], "q", reflections, wavelength, lattice).withColumn("__k", F.struct(seed, "turn", "ring", "omega", "eta"))
    met = matching.associated(p.select(F.col("__k").alias("spot"), "ring", "omega", "eta"), observed.select(F.col("spot").alias("o"), "ring", "omega", "eta"), "spot", "o", "ring", "omega", "eta", omega_tolerance, eta_tolerance)
    hits = met.groupBy(F.col(f"spot.{seed}").alias(seed), F.col("spot.turn").alias("turn")).agg(F.count("*").alias("matched"))
    total = p.groupBy(seed, "turn").agg(F.count("*").alias("total"))
    scored = total.join(hits, [seed, "turn"], "left").na.fill(0, ["matched"]).withColumn("share", F.col("matched") / F.col("total"))
    best = scored.withColumn("__n", F.row_number().over(Window.partitionBy(seed).orderBy(F.desc("share"), "turn"))).where("__n = 1").drop("__n")
    return best.join(c.select(seed, "turn", "q"), [seed, "turn"])


def powder_model(spots: DataFrame, coverage: DataFrame, ring: str, eta: str, value: str, width: float) -> DataFrame:
    """(ring, bin, panels, mean): a ring's intensity in each azimuth bin over the number of panels that cover the bin; 0 where none does. ``coverage``: (panel, ring, lo, hi), in degrees."""
    n = round(360 / width)
    arcs = coverage.select("panel", F.col("ring").alias(ring), F.explode(F.sequence(F.floor((F.col("lo") + 180) / width), F.ceil((F.col("hi") + 180) / width) - 1)).alias("bin"))
    seen = arcs.where((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy(ring, "bin").agg(F.count_distinct("panel").alias("panels"))
    sums = spots.groupBy(ring, F.least(F.greatest(F.floor((F.col(eta) + 180) / width), F.lit(0)), F.lit(n - 1)).alias("bin")).agg(F.sum(value).alias("__i"))
    return sums.join(seen, [ring, "bin"], "left").select(ring, "bin", F.coalesce("panels", F.lit(0)).alias("panels"), F.when(F.col("panels") > 0, F.col("__i") / F.col("panels")).otherwise(0.0).alias("mean"))


def convolved(image: DataFrame, kernel: list[list[float]], keys: list[str] | None = None) -> DataFrame:
    """(keys, y, x, w): an image (keys, y, x, v) convolved with a small odd kernel; missing pixels count 0, and only the image's own pixels are given."""
    keys, half = keys or [], len(kernel) // 2
    cells = [(i - half, j - half, kernel[i][j]) for i in range(len(kernel)) for j in range(len(kernel)) if kernel[i][j]]
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(c)).alias("c")) for i, j, c in cells])).alias("s")
    spread = image.select(*keys, F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("v").alias("__v"), table).select(*keys, (F.col("__y") + F.col("s.i")).alias("y"), (F.col("__x") + F.col("s.j")).alias("x"), (F.col("__v") * F.col("s.c")).alias("__p"))
    sums = spread.groupBy(*keys, "y", "x").agg(F.sum("__p").alias("w"))
    return image.select(*keys, "y", "x").join(sums, [*keys, "y", "x"])


def log_kernel(sigma: float, half: int) -> list[list[float]]:
    """Laplacian of a Gaussian on a grid, shifted so that its sum is 0."""
    axis = np.arange(-half, half + 1)
    r2 = axis[:, None] ** 2 + axis[None, :] ** 2
    k = (r2 - 2 * sigma**2) / sigma**4 * np.exp(-r2 / (2 * sigma**2))
    return (k - k.mean()).tolist()
