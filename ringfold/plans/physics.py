"""Queries that show the column functions of crystals, detectors, tensors and profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions import crystal, geometry, rotations, tensors
from ringfold.operators import plugins
from ringfold.plans.matching import _Q, _oriented, _turned_sql, _wrap_sql
from ringfold.plans.registry import Registry, Tables
from ringfold.plans.synthetic import SPOTS_SQL, rounded, spots

queries = Registry()

_EVEN = "h % 2 = 0 AND k % 2 = 0 AND l % 2 = 0"
_SAME = "(abs(h) % 2 = abs(k) % 2 AND abs(k) % 2 = abs(l) % 2)"
#: Space groups with the reflection conditions that tables give for them.
_GROUPS = {
    "-F 4 2 3": _SAME,
    "-I 4 2 3": "(h + k + l) % 2 = 0",
    "F 4d 2 3 -1d": f"{_SAME} AND (h <> 0 OR (k + l) % 4 = 0) AND (k <> 0 OR (h + l) % 4 = 0) AND (l <> 0 OR (h + k) % 4 = 0)",
    "-P 2ybc": "(NOT (h = 0 AND l = 0) OR k % 2 = 0) AND (k <> 0 OR l % 2 = 0)",
    "P 61": "NOT (h = 0 AND k = 0) OR l % 6 = 0",
    '-R 3 2"': "(-h + k + l) % 3 = 0",
    "P 4 2 3": "TRUE",
    "I 4bd 2c 3": "(h + k + l) % 2 = 0 AND (NOT (k = 0 AND l = 0) OR h % 4 = 0) AND (NOT (h = 0 AND l = 0) OR k % 4 = 0) AND (NOT (h = 0 AND k = 0) OR l % 4 = 0)",
    "-P 6c 2c": "(NOT (h = k) OR l % 2 = 0) AND (NOT (k = -2 * h) OR l % 2 = 0) AND (NOT (h = -2 * k) OR l % 2 = 0) AND (NOT (h = 0 AND k = 0) OR l % 2 = 0)",
}
_GRID = "(SELECT a.i AS h, b.i AS k, c.i AS l FROM range(-4, 5) a(i), range(-4, 5) b(i), range(-4, 5) c(i) WHERE a.i <> 0 OR b.i <> 0 OR c.i <> 0)"


def _grid(t: Tables, n: int = 4) -> DataFrame:
    axis = F.explode(F.sequence(F.lit(-n).cast("long"), F.lit(n).cast("long")))
    return t.spark.range(1).select(axis.alias("h")).select("h", axis.alias("k")).select("h", "k", axis.alias("l")).where("h <> 0 OR k <> 0 OR l <> 0")


@queries.add(" UNION ALL ".join(f"SELECT '{s}' AS symbol, h, k, l FROM {_GRID} WHERE {c}" for s, c in _GROUPS.items()))
def allowed_reflections(t: Tables) -> DataFrame:
    """Reflections that nine space groups, given by their Hall symbols, allow."""
    out = None
    for symbol in _GROUPS:
        mine = _grid(t).where(~crystal.absent(F.col("h"), F.col("k"), F.col("l"), symbol)).select(F.lit(symbol).alias("symbol"), "h", "k", "l")
        out = mine if out is None else out.unionByName(mine)
    return out


_ORDERS = {"-F 4 2 3": 192, "-I 4 2 3": 96, "F 4d 2 3 -1d": 192, "-P 2ybc": 4, "P 61": 6, '-R 3 2"': 36, "P 4 2 3": 24, "I 4bd 2c 3": 48, "-P 6c 2c": 24, "P 1": 1, "-C 2yc": 8, "P 2ac 2ab": 4, "P 2ac 2ab (0 0 3)": 4}


@queries.add("SELECT symbol, CAST(n AS BIGINT) AS operations FROM (VALUES " + ", ".join(f"('{s}', {n})" for s, n in _ORDERS.items()) + ") AS v(symbol, n)")
def group_orders(t: Tables) -> DataFrame:
    """How many operations space groups have."""
    return t.spark.createDataFrame([(s, len(crystal.operations(s))) for s in _ORDERS], "symbol string, operations long")


@queries.add(f"SELECT s[3] AS h, s[2] AS k, s[1] AS l, count(*) AS multiplicity FROM (SELECT list_sort([abs(h), abs(k), abs(l)]) AS s FROM {_GRID}) GROUP BY s")
def multiplicities(t: Tables) -> DataFrame:
    """How many reflections are equivalent to each, and the one that stands for them."""
    f = _grid(t).withColumn("f", crystal.family(F.col("h"), F.col("k"), F.col("l"), "P 4 2 3"))
    first = f.withColumn("lead", F.element_at("f", -1)).where((F.col("lead")[0] == F.col("h")) & (F.col("lead")[1] == F.col("k")) & (F.col("lead")[2] == F.col("l")))
    return first.select("h", "k", "l", F.size("f").cast("long").alias("multiplicity"))


_SALT = [(n, x, y, z, f, b) for n, x, y, z in crystal.unit_cell([("Na", 0.0, 0.0, 0.0), ("Cl", 0.5, 0.5, 0.5)], "-F 4 2 3") for f, b in ((11.0, 1.2) if n == "Na" else (17.0, 0.9),)]
_SALT_SQL = "(VALUES " + ", ".join(f"(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), CAST({z} AS DOUBLE), CAST({f} AS DOUBLE), CAST({b} AS DOUBLE))" for _, x, y, z, f, b in _SALT) + ") AS atoms(x, y, z, f, b)"


@queries.add(f"""
    WITH g AS (SELECT h, k, l, (h * h + k * k + l * l) / (4 * 5.64 * 5.64) AS s2 FROM {_GRID}), f AS (SELECT h, k, l, any_value(s2) AS s2, sum(f * exp(-b * s2) * cos(2 * pi() * (h * x + k * y + l * z))) AS re, sum(f * exp(-b * s2) * sin(2 * pi() * (h * x + k * y + l * z))) AS im FROM g, {_SALT_SQL} GROUP BY 1, 2, 3)
    SELECT h, k, l, round(re * re + im * im, 4) AS intensity, round((re * re + im * im) * (0.5 + 0.5 * pow(cos(2 * asin(0.4 * sqrt(s2))), 2)) / (pow(0.4 * sqrt(s2), 2) * cos(asin(0.4 * sqrt(s2)))), 3) AS corrected FROM f""")
def structure_factors(t: Tables) -> DataFrame:
    """Intensities of rock salt's reflections, and with the Lorentz and polarisation factor."""
    g = _grid(t).withColumn("s2", (F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")) / (4 * 5.64 * 5.64))
    atoms = t.spark.createDataFrame([r[1:] for r in _SALT], "x double, y double, z double, f double, b double")
    found = crystal.structure_factors(g, atoms, "s2").join(g, ["h", "k", "l"])
    factor = crystal.lorentz_polarisation(2 * F.asin(0.4 * F.sqrt("s2")))
    return found.select("h", "k", "l", F.round("intensity", 4).alias("intensity"), F.round(F.col("intensity") * factor, 3).alias("corrected"))


_CELL = (5.0, 6.5, 7.25, 81.0, 95.5, 104.0)


def _reciprocal() -> list[float]:
    """The reciprocal metric of the cell: 11, 22, 33, 23, 13, 12."""
    a, b, c = _CELL[:3]
    (ca, sa), (cb, sb), (cg, sg) = ((math.cos(math.radians(x)), math.sin(math.radians(x))) for x in _CELL[3:])
    v2 = (a * b * c) ** 2 * (1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    return [x / v2 for x in ((b * c * sa) ** 2, (a * c * sb) ** 2, (a * b * sg) ** 2, a * a * b * c * (cb * cg - ca), a * b * b * c * (ca * cg - cb), a * b * c * c * (ca * cb - cg))]


_M = _reciprocal()


@queries.add(f"SELECT h, k, l, round(1 / sqrt(h * h * {_M[0]!r} + k * k * {_M[1]!r} + l * l * {_M[2]!r} + 2 * k * l * {_M[3]!r} + 2 * h * l * {_M[4]!r} + 2 * h * k * {_M[5]!r}), 8) AS d FROM {_GRID}")
def triclinic_spacings(t: Tables) -> DataFrame:
    """Lattice spacings of a cell without right angles."""
    d = tensors.d_spacing(*[F.col(c).cast("double") for c in "hkl"], *[F.lit(x) for x in _CELL])
    return _grid(t).select("h", "k", "l", F.round(d, 8).alias("d"))


@queries.add("""
    WITH v AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 4)] AS v FROM embeddings), u AS (SELECT vec_id, list_sort([abs(x) / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) FOR x IN v]) AS u FROM v WHERE v[1] <> 0 OR v[2] <> 0 OR v[3] <> 0),
    c AS (SELECT vec_id, [u[3] - u[2], (u[2] - u[1]) * sqrt(2.0), u[1] * sqrt(3.0)] AS c FROM u) SELECT vec_id, round(sqrt(c[1] / list_max(c)), 6) AS red, round(sqrt(c[2] / list_max(c)), 6) AS green, round(sqrt(c[3] / list_max(c)), 6) AS blue FROM c""")
def pole_colours(t: Tables) -> DataFrame:
    """Colours of crystal directions by their place in the cubic triangle."""
    v = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0))
    c = v.withColumn("c", crystal.pole_colour(F.col("v")))
    return c.select("vec_id", *[F.round(F.col("c")[k], 6).alias(n) for k, n in enumerate(("red", "green", "blue"))])


def _tilts() -> list[list[float]]:
    a, b, c = (math.radians(x) for x in (0.3, -0.2, 0.5))
    rx = [[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]]
    ry = [[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]]
    rz = [[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]]
    times = lambda m, n: [[sum(m[i][k] * n[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return times(rx, times(ry, rz))


_T = _tilts()


@queries.add(f"""
    WITH p AS (SELECT spot, y - 498.5 AS y, z - 495.25 AS z FROM {SPOTS_SQL}), q AS (SELECT spot, {_T[0][1]!r} * y + {_T[0][2]!r} * z AS a, {_T[1][1]!r} * y + {_T[1][2]!r} * z AS b, {_T[2][1]!r} * y + {_T[2][2]!r} * z AS c FROM p),
    f AS (SELECT spot, b * 5000.0 / (5000.0 + a) AS y, c * 5000.0 / (5000.0 + a) AS z FROM q), g AS (SELECT spot, sqrt(y * y + z * z) AS r, degrees(atan2(-y, z)) AS e FROM f)
    SELECT spot, round(r, 6) AS r, round(e, 6) AS eta, round(r * (1 + 0.001 * pow(r / 700, 2) * cos(2 * radians(90 - e)) + 0.0005 * pow(r / 700, 4) * cos(4 * radians(90 - e) + radians(12.0)) - 0.002 * pow(r / 700, 2)), 6) AS corrected FROM g""")
def projected_pixels(t: Tables) -> DataFrame:
    """Places on a tilted and distorted detector, brought to the plane across the beam."""
    p = spots(t).select("spot", (F.col("y") - 498.5).alias("y"), (F.col("z") - 495.25).alias("z"))
    y, z = geometry.tilt_corrected(F.col("y"), F.col("z"), 5000.0, (0.3, -0.2, 0.5))
    g = p.select("spot", y.alias("y"), z.alias("z")).select("spot", F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("r"), geometry.eta("y", "z").alias("eta"))
    return rounded(g.withColumn("corrected", F.col("r") * geometry.distortion(F.col("r"), F.col("eta"), 700.0, [0.001, 0.0005, -0.002, 12.0])))


@queries.add("""
    WITH b AS (SELECT i, 0.5 + 0.25 * i AS q FROM range(40) r(i)), e AS (SELECT i, q, 2 * asin(least(q * 0.18 / (4 * pi()), 1)) AS t0, 2 * asin(least((q + 0.25) * 0.18 / (4 * pi()), 1)) AS t1 FROM b)
    SELECT CAST(i AS BIGINT) AS bin, round(5000 * tan(t0), 6) AS lo, round(5000 * tan(t1), 6) AS hi, round(degrees(t0), 8) AS two_theta FROM e""")
def vector_bins(t: Tables) -> DataFrame:
    """Radii of bins that are even in the scattering vector."""
    edges = geometry.vector_edges(F.col("bin"), 0.5, 0.25, 0.18, 5000.0)
    return t.spark.range(40).withColumnRenamed("id", "bin").select("bin", F.round(edges[0], 6).alias("lo"), F.round(edges[1], 6).alias("hi"), F.round(geometry.two_theta(edges[0], 5000.0), 8).alias("two_theta"))


@queries.add(f"""
    WITH g AS (SELECT spot, atan(sqrt(y * y + z * z) / 5000) AS t, radians(eta) AS e, ii FROM {SPOTS_SQL})
    SELECT spot, round(ii / (pow(cos(t), 3) * (0.95 * (1 - pow(sin(t) * sin(e), 2)) + 0.05 * (1 - pow(sin(t) * cos(e), 2))) * exp(-0.3 / cos(t))), 4) AS corrected FROM g""")
def corrected_intensities(t: Tables) -> DataFrame:
    """Intensities with solid angle, polarisation and a plate's absorption taken out."""
    g = spots(t).withColumn("t", geometry.two_theta(F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")), 5000.0))
    factor = geometry.solid_angle("t") * geometry.polarisation("t", "eta", 0.95) * geometry.flat_absorption(F.lit(0.3), "t")
    return g.select("spot", F.round(F.col("ii") / factor, 4).alias("corrected"))


@queries.add("""
    WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS x, 0.2 + p_partkey % 7 * 0.1 AS g, 0.1 + p_partkey % 5 * 0.1 AS w FROM part), f AS (SELECT *, pow(pow(g, 5) + 2.69269 * pow(g, 4) * w + 2.42843 * pow(g, 3) * w * w + 4.47163 * g * g * pow(w, 3) + 0.07842 * g * pow(w, 4) + pow(w, 5), 0.2) AS fw FROM p),
    s AS (SELECT *, 1.36603 * w / fw - 0.47719 * pow(w / fw, 2) + 0.11116 * pow(w / fw, 3) AS share FROM f)
    SELECT p_partkey, round(fw, 8) AS width, round(share, 8) AS share, round(share / (1 + 4 * pow((x - 2.5) / fw, 2)) + (1 - share) * exp(-4 * ln(2.0) * pow((x - 2.5) / fw, 2)), 8) AS height FROM s""")
def peak_shapes(t: Tables) -> DataFrame:
    """Widths of convoluted peaks and their heights at a place."""
    p = t.part.select("p_partkey", (F.col("p_size").cast("double") / 10).alias("x"), (0.2 + F.col("p_partkey") % 7 * 0.1).alias("g"), (0.1 + F.col("p_partkey") % 5 * 0.1).alias("w"))
    width, share = tensors.voigt_width("g", "w")
    f = p.withColumn("width", width).withColumn("share", share)
    return f.select("p_partkey", F.round("width", 8).alias("width"), F.round("share", 8).alias("share"), F.round(tensors.lorentzian_gaussian("x", 2.5, F.col("width"), F.col("share")), 8).alias("height"))


@queries.add("""
    WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 * (10.0 + p_partkey % 9) AS x FROM part) SELECT p_partkey, round(pow(3 * (sin(x) - x * cos(x)) / pow(x, 3), 2), 8) AS form FROM p""")
def sphere_forms(t: Tables) -> DataFrame:
    """Form factors of spheres."""
    p = t.part.select("p_partkey", (F.col("p_size").cast("double") / 50).alias("q"), (10.0 + F.col("p_partkey") % 9).alias("r"))
    return p.select("p_partkey", F.round(tensors.sphere_form("q", "r"), 8).alias("form"))


_A = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS m{k}" for k in range(18))


@queries.add(f"""
    WITH e AS (SELECT vec_id, {_A} FROM embeddings), d AS (SELECT *, m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) AS det FROM e)
    SELECT vec_id, round(det, 8) AS det, round(m0 * m9 + m1 * m12 + m2 * m15, 8) AS p00, round(m6 * m11 + m7 * m14 + m8 * m17, 8) AS p22, round(det * CASE WHEN det <> 0 THEN (m1 * m5 - m2 * m4) / det END, 8) AS i02 FROM d""")
def matrix_algebra(t: Tables) -> DataFrame:
    """Determinants, products and inverses of small matrices."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    m = t.embeddings.select("vec_id", F.slice(x, 1, 9).alias("a"), F.slice(x, 10, 9).alias("b")).withColumns({"det": tensors.determinant(F.col("a")), "p": tensors.product(F.col("a"), F.col("b")), "i": tensors.inverse(F.col("a"))})
    return m.select("vec_id", F.round("det", 8).alias("det"), F.round(F.col("p")[0], 8).alias("p00"), F.round(F.col("p")[8], 8).alias("p22"), F.round(F.col("det") * F.col("i")[2], 8).alias("i02"))


@queries.add("""
    WITH e AS (SELECT vec_id, radians(CAST(vec_id % 360 AS DOUBLE)) AS w, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 7)] AS s FROM embeddings)
    SELECT vec_id, round(cos(w) * s[1] - sin(w) * s[2], 8) AS x, round(sin(w) * s[1] + cos(w) * s[2], 8) AS y, round(cos(w) * cos(w) * s[1] + sin(w) * sin(w) * s[2] - 2 * sin(w) * cos(w) * s[6], 8) AS t11, round(s[3], 8) AS t33 FROM e""")
def turned_frames(t: Tables) -> DataFrame:
    """Vectors and tensors brought from the laboratory to the sample, turned about z."""
    e = t.embeddings.select("vec_id", (F.col("vec_id") % 360).cast("double").alias("w"), F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("s"))
    r = e.withColumn("r", rotations.about_z(F.col("w"))).withColumn("m", tensors.from_voigt(F.col("s"))).withColumn("v", tensors.apply(F.col("r"), F.slice("s", 1, 3))).withColumn("t", tensors.rotated(F.col("m"), F.col("r")))
    return r.select("vec_id", F.round(F.col("v")[0], 8).alias("x"), F.round(F.col("v")[1], 8).alias("y"), F.round(F.col("t")[0], 8).alias("t11"), F.round(F.col("t")[8], 8).alias("t33"))


@queries.add("""
    WITH c AS (SELECT p_partkey, 4.0 + p_size * 0.001 AS a, 5.0 + p_partkey % 10 * 0.002 AS b, 6.0 + p_partkey % 7 * 0.003 AS c, 90.0 + p_partkey % 5 * 0.1 AS g FROM part)
    SELECT p_partkey, round(a / 4.01 - 1, 8) AS e11, round(b * sin(radians(g)) / 5.01 - 1, 8) AS e22, round(c / 6.01 - 1, 8) AS e33, round(b * cos(radians(g)) / 5.01 / 2, 8) AS e12 FROM c""")
def lattice_strains(t: Tables) -> DataFrame:
    """Strains of cells against a reference cell of right angles."""
    c = t.part.select("p_partkey", (4.0 + F.col("p_size") * 0.001).alias("a"), (5.0 + F.col("p_partkey") % 10 * 0.002).alias("b"), (6.0 + F.col("p_partkey") % 7 * 0.003).alias("c"), (90.0 + F.col("p_partkey") % 5 * 0.1).alias("g"))
    right = F.lit(90.0)
    m = c.withColumn("m", tensors.cell_matrix(F.col("a"), F.col("b"), F.col("c"), right, right, F.col("g"))).withColumn("n", tensors.cell_matrix(F.lit(4.01), F.lit(5.01), F.lit(6.01), right, right, right))
    e = m.withColumn("e", tensors.lattice_strain(F.col("m"), F.col("n")))
    return e.select("p_partkey", F.round(F.col("e")[0], 8).alias("e11"), F.round(F.col("e")[4], 8).alias("e22"), F.round(F.col("e")[8], 8).alias("e33"), F.round(F.col("e")[1], 8).alias("e12"))


_LORCH = "CASE WHEN q = 0 THEN 1 ELSE sin(pi() * q / 10) / (pi() * q / 10) END"


@queries.add(f"""
    WITH s AS (SELECT CAST(p_size AS DOUBLE) / 5 AS q, avg(p_retailprice) / 1300 AS s, 0.01 * count(*) AS e FROM part GROUP BY 1), r AS (SELECT i * 0.1 AS r FROM range(1, 61) t(i))
    SELECT round(r, 2) AS r, round(2 / pi() * 0.2 * sum(q * (s - 1) * sin(q * r) * {_LORCH}), 6) AS g, round(2 / pi() * 0.2 * sqrt(sum(pow(q * sin(q * r) * {_LORCH} * e, 2))), 8) AS sigma FROM s, r WHERE q <= 10 GROUP BY r""")
def windowed_pair_distribution(t: Tables) -> DataFrame:
    """Sine transform with a damping window, and its deviation."""
    s = t.part.groupBy((F.col("p_size").cast("double") / 5).alias("q")).agg((F.avg("p_retailprice") / 1300).alias("s"), (0.01 * F.count("*")).alias("e"))
    grid = t.spark.range(1, 61).select((F.col("id") * 0.1).alias("r"))
    return tensors.sine_transform(s, grid, 0.2, 10.0).select(F.round("r", 2).alias("r"), F.round("g", 6).alias("g"), F.round("sigma", 8).alias("sigma"))


@queries.add("SELECT 'sample' || s_nationkey || '_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.ge' || (s_suppkey % 5) AS name, 'sample' || s_nationkey AS stem, s_suppkey AS num, CAST(6 AS INTEGER) AS padding, '.ge' || (s_suppkey % 5) AS ext FROM supplier")
def parsed_names(t: Tables) -> DataFrame:
    """Names of frame files taken apart."""
    n = t.supplier.select(F.concat(F.lit("sample"), F.col("s_nationkey").cast("string"), F.lit("_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".ge"), (F.col("s_suppkey") % 5).cast("string")).alias("name"))
    p = r"^(.*)_([0-9]+)(\.[^/]*)$"
    number = F.regexp_extract("name", p, 2)
    return n.select("name", F.regexp_extract("name", p, 1).alias("stem"), number.cast("long").alias("num"), F.length(number).alias("padding"), F.regexp_extract("name", p, 3).alias("ext"))


@queries.add(f"""
    WITH o AS (SELECT grain, 1 - 2 * (q2 * q2 + q3 * q3) AS m0, 2 * (q1 * q2 - q0 * q3) AS m1, 2 * (q1 * q3 + q0 * q2) AS m2, 2 * (q1 * q2 + q0 * q3) AS m3, 1 - 2 * (q1 * q1 + q3 * q3) AS m4, 2 * (q2 * q3 - q0 * q1) AS m5, 2 * (q1 * q3 - q0 * q2) AS m6, 2 * (q2 * q3 + q0 * q1) AS m7, 1 - 2 * (q1 * q1 + q2 * q2) AS m8 FROM {_Q}),
    g AS (SELECT grain, h, k, l, (m0 * h + m1 * k + m2 * l) / 4.05 AS g1, (m3 * h + m4 * k + m5 * l) / 4.05 AS g2, (m6 * h + m7 * k + m8 * l) / 4.05 AS g3, asin(0.18 * sqrt(CAST(h * h + k * k + l * l AS DOUBLE)) / (2 * 4.05)) AS theta FROM o, (VALUES (1, 1, 1), (2, 0, 0), (2, 2, 0), (0, 0, 2)) AS r(h, k, l)),
    p AS (SELECT *, sqrt(g1 * g1 + g2 * g2 + g3 * g3) * sin(theta) / nullif(sqrt(g1 * g1 + g2 * g2), 0) AS c, degrees(atan2(g2, -g1)) AS ph FROM g), s AS (SELECT *, degrees(acos(c)) AS half FROM p WHERE abs(c) < 0.99999),
    w AS (SELECT *, {_wrap_sql('ph - half')} AS omega FROM s UNION ALL SELECT *, {_wrap_sql('ph + half')} AS omega FROM s)
    SELECT grain, CAST(h AS INTEGER) AS h, CAST(k AS INTEGER) AS k, CAST(l AS INTEGER) AS l, round(omega, 4) AS omega, round(degrees(atan2(-(sin(radians(omega)) * g1 + cos(radians(omega)) * g2), g3)), 3) AS eta FROM w""")
def predicted_spots(t: Tables) -> DataFrame:
    """Rotations and azimuths at which grains' reflections are met."""
    m = _oriented(t).select("grain", rotations.to_matrix(F.col("q")).alias("m"))
    hkl = t.spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 2, 0), (0, 0, 2)], "h int, k int, l int")
    g = m.crossJoin(F.broadcast(hkl)).withColumn("g", F.transform(tensors.apply(F.col("m"), F.array("h", "k", "l")), lambda x: x / 4.05))
    g = g.select("grain", "h", "k", "l", *[F.col("g")[j].alias(f"g{j + 1}") for j in range(3)], F.degrees(F.asin(0.18 * F.sqrt((F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")).cast("double")) / (2 * 4.05))).alias("theta"))
    ratio = F.sqrt(F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") + F.col("g3") * F.col("g3")) * F.sin(F.radians("theta")) / F.nullif(F.sqrt(F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2")), F.lit(0.0))
    w = g.where(F.abs(ratio) < 0.99999).select("*", F.explode(geometry.omega_solutions(F.col("g1"), F.col("g2"), F.col("g3"), F.col("theta"))).alias("omega"))
    y = F.sin(F.radians("omega")) * F.col("g1") + F.cos(F.radians("omega")) * F.col("g2")
    return w.select("grain", "h", "k", "l", F.round("omega", 4).alias("omega"), F.round(geometry.eta(y, F.col("g3")), 3).alias("eta"))


@queries.add("""
    WITH i AS (SELECT i FROM range(-6, 7) r(i) WHERE i <> 0), e AS (SELECT i, unnest(range(0, 2 * (12 - abs(i)) + 1)) AS j FROM i), p AS (SELECT i, j, (j % 2 = 0) = (i < 0) AS big FROM e)
    SELECT CAST(i AS BIGINT) AS line, CAST(j AS BIGINT) AS place, round(-6 * 5.0 + abs(i) * 2.5 + CASE WHEN i < 0 THEN 2.5 ELSE 0 END + 5.0 * j / 2, 6) AS x, round(sqrt(3.0) * 2.5 * i - sign(i) * sqrt(3.0) * 2.5 * CASE WHEN big THEN 2.0 / 3 ELSE 1.0 / 3 END, 6) AS y FROM p""")
def hexagonal_grid(t: Tables) -> DataFrame:
    """Triangles' centres of a hexagonal grid over a disk."""
    return rounded(geometry.hexagonal_grid(t.spark, 5.0, 25.0))


@queries.add(f"WITH q AS (SELECT grain, list_sort([abs(q0), abs(q1), abs(q2), abs(q3)]) AS r FROM {_Q}) SELECT grain, round(greatest(r[4], (r[3] + r[4]) / sqrt(2.0), (r[1] + r[2] + r[3] + r[4]) / 2), 8) AS w FROM q")
def zone_parts(t: Tables) -> DataFrame:
    """The first part of each orientation's representative nearest the identity."""
    return _oriented(t).withColumn("f", rotations.fundamental(F.col("q"), "m-3m")).select("grain", F.round(F.col("f")[0], 8).alias("w"))


@queries.add("""
    WITH e AS (SELECT user_id % 10 AS run, CAST(1 + event_id % 50 AS DOUBLE) AS t, least(greatest(1 - exp(-pow(0.05 * (1 + event_id % 50), 1.5 + user_id % 10 * 0.1)) + (value - 50) * 0.0001, 0.001), 0.999) AS x FROM events),
    f AS (SELECT run, regr_slope(ln(-ln(1 - x)), ln(t)) AS n, regr_intercept(ln(-ln(1 - x)), ln(t)) AS b, count(*) AS rows FROM e GROUP BY 1) SELECT run, round(n, 5) AS exponent, round(exp(b / n), 6) AS rate, rows FROM f""")
def kinetics_fits(t: Tables) -> DataFrame:
    """Exponent and rate of a transformation from its share over time, on doubly logarithmic axes."""
    k = 1 + F.col("event_id") % 50
    run = F.col("user_id") % 10
    x = F.least(F.greatest(1 - F.exp(-F.pow(0.05 * k, 1.5 + run * 0.1)) + (F.col("value") - 50) * 0.0001, F.lit(0.001)), F.lit(0.999))
    e = t.events.select(run.alias("run"), F.log(k.cast("double")).alias("t"), F.log(-F.log(1 - x)).alias("y"))
    f = e.groupBy("run").agg(F.regr_slope("y", "t").alias("n"), F.regr_intercept("y", "t").alias("b"), F.count("*").alias("rows"))
    return f.select("run", F.round("n", 5).alias("exponent"), F.round(F.exp(F.col("b") / F.col("n")), 6).alias("rate"), "rows")


@queries.add(" UNION ALL ".join(f"SELECT '{n}' AS statistic, p_brand AS grp, round({e}, 6) AS value FROM part GROUP BY 2" for n, e in (("mean", "avg(p_retailprice)"), ("median", "quantile_cont(p_retailprice, 0.5)"), ("spread", "quantile_cont(p_retailprice, 0.84) - quantile_cont(p_retailprice, 0.16)"))))
def plugged_statistics(t: Tables) -> DataFrame:
    """Statistics named by the caller, each a plug-in of the registry."""
    out = None
    for name in ("mean", "median", "spread"):
        mine = plugins.summarise(t.part, ["p_brand"], "p_retailprice", name).select(F.lit(name).alias("statistic"), F.col("p_brand").alias("grp"), F.round("value", 6).alias("value"))
        out = mine if out is None else out.unionByName(mine)
    return out


@queries.add("""
    WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat(o_orderkey, '-7'))) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, count(*) FILTER (WHERE k <= n * 0.5) AS trained, count(*) FILTER (WHERE k > n * 0.5) AS held FROM s GROUP BY 1""")
def train_splits(t: Tables) -> DataFrame:
    """Half of each group's rows, by seeded order, to fit with and the rest held out."""
    w = Window.partitionBy("o_custkey")
    k = F.row_number().over(w.orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("-7")))))
    s = t.orders.select("o_custkey", k.alias("k"), F.count("*").over(w).alias("n"))
    return s.groupBy("o_custkey").agg(F.count_if(F.col("k") <= F.col("n") * 0.5).alias("trained"), F.count_if(F.col("k") > F.col("n") * 0.5).alias("held"))
