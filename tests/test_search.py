"""Searches against known answers and plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.functions import rotations
from ringfold.operators import matching, search

REFLECTIONS = [(h, k, l, n) for h, k, l in itertools.product(range(-2, 3), repeat=3) if (n := {3: 1, 4: 2, 8: 3}.get(h * h + k * k + l * l)) and h % 2 == k % 2 == l % 2]


def angle(p, q):
    """Cubic misorientation in degrees, by the sizes of the parts."""
    a, b, c, d = p
    w, x, y, z = q
    r = sorted(abs(v) for v in (a * w + b * x + c * y + d * z, a * x - b * w - c * z + d * y, a * y + b * z - c * w - d * x, a * z - b * y + c * x - d * w))
    return math.degrees(2 * math.acos(min(1.0, max(r[3], (r[2] + r[3]) / math.sqrt(2), sum(r) / 2))))


def test_indexing_finds_the_grain(spark):
    """Spots of one grain, and a seed from one of them: the best candidate is that grain's orientation."""
    q = np.array([0.9, 0.2, -0.3, 0.15])
    q = (q / np.linalg.norm(q)).tolist()
    hkl = spark.createDataFrame(REFLECTIONS, "h int, k int, l int, ring int")
    grain = spark.createDataFrame([(1, q)], "grain int, q array<double>")
    spots = search.predicted(grain, ["grain"], "q", hkl, 0.18, 4.05).withColumn("spot", F.monotonically_increasing_id()).drop("grain")
    spots = spark.createDataFrame(spots.collect(), "ring int, omega double, eta double, spot long")
    assert 40 < spots.count()
    m = np.array(grain.select(rotations.to_matrix(F.col("q")).alias("m")).first().m).reshape(3, 3)
    seeds = spark.createDataFrame([(7, (m @ np.array([1, 1, 1])).tolist(), [1, 1, 1]), (8, (m @ np.array([0, 2, 0])).tolist(), [2, 0, 0])], "seed int, g array<double>, hkl array<int>")
    found = search.indexed(seeds, spots, hkl, "seed", "g", "hkl", 2.0, 0.18, 4.05, 2.5, 2.5).collect()
    assert len(found) == 2 and all(angle(r.q, q) < 2.0 and r.share > 0.9 and r.matched <= r.total for r in found)


def test_candidates_turn_the_crystal_onto_the_vector(spark):
    seeds = spark.createDataFrame([(1, [0.3, -2.0, 0.4], [1, 1, 0]), (2, [-1.0, -1.0, -1.0], [1, 1, 1]), (3, [2.0, 0.0, 0.0], [1, 0, 0])], "seed int, g array<double>, hkl array<int>")
    rows = search.candidate_orientations(seeds, "g", "hkl", 30.0).withColumn("m", rotations.to_matrix(F.col("q"))).collect()
    assert len(rows) == 36
    for r in rows:
        g, h = np.array(r.g), np.array(r.hkl, float)
        assert np.allclose(np.array(r.m).reshape(3, 3) @ (h / np.linalg.norm(h)), g / np.linalg.norm(g), atol=1e-9)


def test_best_solutions_are_offered_in_order(spark):
    rng = np.random.default_rng(5)
    rows = [(v, k, (lambda q: (q / np.linalg.norm(q)).tolist())(np.array([1.0, *rng.uniform(-0.2, 0.2, 3)])), float(rng.integers(0, 6)) / 6) for v in range(3) for k in range(30)]
    d = spark.createDataFrame(rows, "v int, k int, q array<double>, s double")
    for most in (1, 3):
        got = sorted((r.v, r.place, r.offer) for r in search.best_solutions(d, "v", "k", "q", "s", most, 10.0, "m-3m").collect())
        want = []
        for v in range(3):
            held = []
            for _, k, q, s in [r for r in rows if r[0] == v]:
                if most > 1 and any(angle(q, h[1]) < 10.0 for h in held):
                    continue
                place = next((i for i, h in enumerate(held) if s >= h[2]), len(held))
                held.insert(place, (k, q, s))
                held = held[:most]
            want += [(v, i, h[0]) for i, h in enumerate(held)]
        assert got == sorted(want)


def test_medoids_and_smoothing(spark):
    rng = np.random.default_rng(6)
    rows = [(1, k, (lambda q: (q / np.linalg.norm(q)).tolist())(np.array([1.0, 0.3 * (k % 2), 0.0, 0.0]) + np.array([0.0, *rng.uniform(-0.02, 0.02, 3)]))) for k in range(20)]
    found = {r.k: r.medoid % 2 for r in search.medoids(spark.createDataFrame(rows, "g int, k int, q array<double>"), "g", "k", "q", "m-3m", 2).collect()}
    assert all(m == k % 2 for k, m in found.items())
    cells = [(1, y, x, g, (0.9 if g == 1 else 0.1) if (y, x) != (2, 2) else (0.45 if g == 1 else 0.55)) for y in range(5) for x in range(5) for g in (1, 2)] + [(1, 9, 9, 1, 0.0)]
    d = spark.createDataFrame(cells, "m int, y int, x int, g int, p double")
    smooth = {(r.y, r.x): r.g for r in search.smoothed_labels(d, "m", "y", "x", "g", "p", 1.0).collect()}
    assert smooth[2, 2] == 1 and len(smooth) == 25 and {r.g for r in search.smoothed_labels(d, "m", "y", "x", "g", "p", 0.0).where("y = 2 AND x = 2").collect()} == {2}


def test_chosen_measurements_add_most():
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.0]), ("c", [0.0, 0.5]), ("d", [0.1, 0.1])]
    assert [n for n, _ in search.chosen_measurements(rows, 2)] == ["a", "c"]


def test_inversion_takes_the_detector_back(spark):
    from ringfold.functions import geometry

    p = [0.002, 0.001, -0.003, 20.0]
    d = spark.createDataFrame([(float(r), float(e)) for r in (50, 300, 600) for e in (-170, -45, 0, 90, 179)], "r double, e double")
    placed = search.pixels_at(d, "r", "e", 4000.0, (0.5, 0.4, -0.3), 700.0, p)
    y, z = geometry.tilt_corrected(F.col("y"), F.col("z"), 4000.0, (0.5, 0.4, -0.3))
    seen = placed.select("r", "e", F.sqrt(y * y + z * z).alias("q"), geometry.eta(y, z).alias("a")).select("r", "e", (F.col("q") * geometry.distortion(F.col("q"), F.col("a"), 700.0, p)).alias("q"), "a").collect()
    assert all(abs(s.q - s.r) < 1e-6 and abs(s.a - s.e) < 1e-6 for s in seen) and matching is not None


def test_medoids_without_the_square_of_angles_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(k % 2, k, (lambda q: (q / np.linalg.norm(q)).tolist())(np.array([1.0, *rng.uniform(-0.4, 0.4, 3)]))) for k in range(120)]
    d, got = spark.createDataFrame(rows, "g int, k int, q array<double>"), []
    for most in (0, 4096):
        monkeypatch.setattr(search, "SQUARE_ROWS", most)
        got.append(sorted(map(tuple, search.medoids(d, "g", "k", "q", "m-3m", 3).collect())))
    assert got[0] == got[1] and len(got[0]) == 120


@pytest.mark.parametrize("laue", ["m-3m", "6/mmm", "-1"])
def test_centres_of_parts_are_those_of_all_angles(laue):
    """With copies, so that the first of equal sums must be found, and wide enough that symmetries compete; not every row's sums are made."""
    rng = np.random.default_rng(13)
    q = np.stack([1 + rng.uniform(-0.3, 0.3, 1500), *rng.uniform(-0.35, 0.35, (3, 1500))], axis=1)
    q = (q / np.linalg.norm(q, axis=1, keepdims=True))[np.concatenate([np.arange(1500), np.arange(0, 1500, 4)])]
    square = np.stack([search._angles(q, one, laue) for one in q])
    centre = search._Centre(q, laue)
    assert np.allclose(centre._far(np.arange(40), np.arange(len(q))), square[:40], atol=1e-5)
    parts = [np.arange(len(q)), np.flatnonzero(square[3] < square[700]), np.flatnonzero(square[3] < square[9]), np.arange(1480, 1520), np.array([5]), np.flatnonzero(q[:, 1] > 0)]
    for m in parts:
        want = square[np.ix_(m, m)].sum(axis=1)
        assert centre.of(m, len(m) // 2) == np.flatnonzero(want <= want.min() * (1 + 1e-12))[0]
    assert laue == "m-3m" or (centre.at >= 0).sum() < len(q)
