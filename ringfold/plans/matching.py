"""Queries that show binned probes, associations, neighbours and de-duplication on spots and grains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions import rotations
from ringfold.operators import checks, joins, matching, windows
from ringfold.operators.graph import connected
from ringfold.plans.registry import Registry, Tables
from ringfold.plans.synthetic import GRAINS_SQL, SPOTS_SQL, grains, rounded, spots

queries = Registry()

_Q = "(SELECT *, w0 / n AS q0, w1 / n AS q1, w2 / n AS q2, w3 / n AS q3 FROM (SELECT *, sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3) AS n FROM " + GRAINS_SQL + "))"


def _turned_sql(a: str, b: str) -> str:
    """Sizes of the parts of the rotation between two orientations, rising."""
    parts = ["{a}.q0*{b}.q0+{a}.q1*{b}.q1+{a}.q2*{b}.q2+{a}.q3*{b}.q3", "{a}.q0*{b}.q1-{a}.q1*{b}.q0-{a}.q2*{b}.q3+{a}.q3*{b}.q2", "{a}.q0*{b}.q2+{a}.q1*{b}.q3-{a}.q2*{b}.q0-{a}.q3*{b}.q1", "{a}.q0*{b}.q3-{a}.q1*{b}.q2+{a}.q2*{b}.q1-{a}.q3*{b}.q0"]
    return "list_sort([" + ", ".join(f"abs({p.format(a=a, b=b)})" for p in parts) + "])"


def _angle_sql(r: str) -> str:
    """Smallest cubic angle from those sizes."""
    return f"degrees(2 * acos(least(greatest({r}[4], ({r}[3] + {r}[4]) / sqrt(2.0), ({r}[1] + {r}[2] + {r}[3] + {r}[4]) / 2), 1.0)))"


def _gap_sql(a: str, b: str) -> str:
    return f"sqrt(({a}.x-{b}.x)*({a}.x-{b}.x)+({a}.y-{b}.y)*({a}.y-{b}.y)+({a}.z-{b}.z)*({a}.z-{b}.z))"


def _wrap_sql(x: str) -> str:
    return f"(180 - ((180 - ({x})) - 360 * floor((180 - ({x})) / 360)))"


def _oriented(t: Tables) -> DataFrame:
    return grains(t).withColumn("q", rotations.normalised(F.array("w0", "w1", "w2", "w3")))


@queries.add(f"SELECT frame, spot, row_number() OVER (PARTITION BY frame ORDER BY eta, spot) AS seq FROM {SPOTS_SQL} WHERE ii >= 60000")
def peaks_by_azimuth(t: Tables) -> DataFrame:
    """Peaks that are bright enough, in order of azimuth within each frame, ties by their place."""
    return windows.renumber(spots(t).where("ii >= 60000").select("frame", "spot", "eta"), "seq", ["eta", "spot"], ["frame"]).select("frame", "spot", "seq")


_RINGS = [(1, 250.0), (2, 500.0), (3, 540.0), (4, 900.0)]
_RINGS_SQL = "(VALUES " + ", ".join(f"({k}, CAST({c} AS DOUBLE))" for k, c in _RINGS) + ") AS rings(band, centre)"


@queries.add(f"SELECT row_number() OVER (ORDER BY spot, band) AS new_id, spot AS old_id, band FROM (SELECT *, sqrt(y * y + z * z) AS r FROM {SPOTS_SQL}) JOIN {_RINGS_SQL} ON abs(r - centre) < 30")
def ring_spots(t: Tables) -> DataFrame:
    """One row for each ring that a spot lies in, numbered anew over the whole table; the old number stays."""
    r = spots(t).withColumn("r", F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    met = joins.band_join(r, t.spark.createDataFrame(_RINGS, "band int, centre double"), "r", "centre", 30.0)
    return windows.renumber(met.select(F.col("spot").alias("old_id"), "band"), "new_id", ["old_id", "band"]).select("new_id", "old_id", "band")


@queries.add(f"SELECT spot, eta FROM {SPOTS_SQL} WHERE abs(eta) >= 90")
def top_layer(t: Tables) -> DataFrame:
    """Spots on the far half of the azimuth."""
    return spots(t).where(F.abs(F.col("eta")) >= 90).select("spot", "eta")


@queries.add(f"SELECT spot FROM {SPOTS_SQL} WHERE ring = 2 AND ii >= 50000 AND abs(eta) > 6 AND abs(eta) < 174 AND ((omega BETWEEN -180 AND -60) OR (omega BETWEEN 20 AND 90 AND y BETWEEN 100 AND 800 AND z BETWEEN 0 AND 700))")
def seed_spots(t: Tables) -> DataFrame:
    """Spots to begin indexing from: one ring, clear of the poles, bright, and in one of the ranges of omega with its box."""
    o, e = F.col("omega"), F.abs(F.col("eta"))
    boxes = checks.any_of([o.between(-180, -60), o.between(20, 90) & F.col("y").between(100, 800) & F.col("z").between(0, 700)])
    return spots(t).where((F.col("ring") == 2) & (F.col("ii") >= 50000) & (e > 6) & (e < 174) & boxes).select("spot")


@queries.add(f"""
    WITH s AS (SELECT spot, y - 500.5 AS y, z - 500.25 AS z, omega FROM {SPOTS_SQL}), a AS (SELECT *, degrees(atan2(-y, z)) AS e, sqrt(y * y + z * z) AS r FROM s),
    b AS (SELECT *, degrees(atan(r / 5000.0)) AS t FROM a), k AS (SELECT *, sin(radians(t / 2)) AS st, cos(radians(t / 2)) AS ct FROM b),
    u AS (SELECT *, -st*st*cos(radians(0.7)) + st*ct*cos(radians(e))*sin(radians(0.7)) AS a1, -st*ct*sin(radians(e)) AS k2, st*ct*cos(radians(e))*cos(radians(0.7)) + st*st*sin(radians(0.7)) AS g3 FROM k),
    g AS (SELECT *, a1*cos(radians(omega)) + k2*sin(radians(omega)) AS g1, k2*cos(radians(omega)) - a1*sin(radians(omega)) AS g2 FROM u),
    p AS (SELECT *, sqrt(g1*g1+g2*g2+g3*g3) * st / sqrt(g1*g1+g2*g2) AS c, degrees(atan2(g2, -g1)) AS ph FROM g),
    h AS (SELECT *, CASE WHEN abs(c) <= 1 THEN degrees(acos(c)) END AS half FROM p),
    o AS (SELECT *, {_wrap_sql('ph - half')} AS o1, {_wrap_sql('ph + half')} AS o2 FROM h)
    SELECT spot, round(CASE WHEN abs({_wrap_sql('o2 - omega')}) < abs({_wrap_sql('o1 - omega')}) THEN o2 ELSE o1 END, 4) AS omega, round(e, 5) AS eta, round(t, 6) AS two_theta FROM o""")
def wedge_correction(t: Tables) -> DataFrame:
    """Rotations of spots with the axis tilted by 0.7 degrees."""
    s = spots(t).select("spot", (F.col("y") - 500.5).alias("y"), (F.col("z") - 500.25).alias("z"), "omega")
    made = matching.wedge_corrected(F.col("y"), F.col("z"), 5000.0, F.col("omega"), 0.2, 0.7)
    return s.select("spot", F.round(made["omega"], 4).alias("omega"), F.round(made["eta"], 5).alias("eta"), F.round(made["two_theta"], 6).alias("two_theta"))


_REGION = "SELECT l_partkey % 300 AS region, l_suppkey % 40 AS r, l_orderkey % 40 AS c, l_extendedprice AS v FROM lineitem"


@queries.add(f"""
    WITH p AS ({_REGION}), m AS (SELECT r // 10 AS cr, c // 10 AS cc, quantile_cont(v, 0.5) AS med FROM p GROUP BY 1, 2),
    s AS (SELECT cr, cc, any_value(med) AS med, 1.4826 * quantile_cont(abs(v - med), 0.5) AS sig FROM p JOIN m ON cr = r // 10 AND cc = c // 10 GROUP BY 1, 2),
    o AS (SELECT region, count(*) AS n, max(v) AS peak, CAST(round_even(avg(r), 0) AS BIGINT) // 10 AS cr, CAST(round_even(avg(c), 0) AS BIGINT) // 10 AS cc FROM p GROUP BY 1)
    SELECT region, n, round(CASE WHEN sig > 0 THEN (peak - med) / sig ELSE 0 END, 6) AS snr FROM o LEFT JOIN s USING (cr, cc) WHERE n > 2 AND n < 250 AND CASE WHEN sig > 0 THEN (peak - med) / sig ELSE 0 END >= 0.8""")
def clear_regions(t: Tables) -> DataFrame:
    """Regions of a size strictly between two bounds that stand out from the noise of their cell."""
    p = t.lineitem.selectExpr("l_partkey % 300 AS region", "l_suppkey % 40 AS r", "l_orderkey % 40 AS c", "l_extendedprice AS v")
    return matching.region_contrast(p, "region", "r", "c", "v", 10).where("n > 2 AND n < 250 AND snr >= 0.8").withColumn("snr", F.round("snr", 6))


_IMAGE = "SELECT a.i AS row, b.i AS col, (a.i * 7 + b.i * 3) % 5 AS value FROM range(64) a(i), range(64) b(i)"


@queries.add(f"""
    WITH i AS ({_IMAGE}), g AS (SELECT grain, x - 150 AS x, y - 150 AS y FROM {GRAINS_SQL}), p AS (SELECT *, CAST(trunc(x / 5.0) AS BIGINT) + 32 AS c, CAST(trunc(y / 5.0) AS BIGINT) + 32 AS u FROM g)
    SELECT grain FROM p JOIN i ON i.col = c AND i.row = 64 - u WHERE c BETWEEN 0 AND 63 AND u BETWEEN 0 AND 63 AND value <> 0""")
def grid_in_image(t: Tables) -> DataFrame:
    """Grid points whose pixel of a square image is set; the image's rows run the other way."""
    n = t.spark.range(64)
    image = n.select(F.col("id").alias("row")).crossJoin(n.select(F.col("id").alias("column"))).withColumn("value", (F.col("row") * 7 + F.col("column") * 3) % 5)
    g = grains(t).select("grain", (F.col("x") - 150).alias("x"), (F.col("y") - 150).alias("y"))
    return matching.masked_by_image(g, image, "x", "y", 5.0, 64).select("grain")


@queries.add(f"SELECT grain FROM {GRAINS_SQL} WHERE x BETWEEN 20 AND 200 AND y BETWEEN 30 AND 250")
def grid_in_box(t: Tables) -> DataFrame:
    """Grid points in a box, its edges with it."""
    return grains(t).where(F.col("x").between(20, 200) & F.col("y").between(30, 250)).select("grain")


@queries.add("""
    WITH p AS (SELECT a.i AS y, b.i AS z FROM range(80) a(i), range(60) b(i)), e AS (SELECT *, degrees(atan2(z - 29.5, y - 40.25)) AS e FROM p)
    SELECT y, z, ((e - 20) - 360 * floor((e - 20) / 360) <= 55 OR (e - 200) - 360 * floor((e - 200) / 360) <= 55) AS single_and_turned FROM e""")
def gasket_mask(t: Tables) -> DataFrame:
    """Pixels in an open wedge of 55 degrees and its copy half a turn on."""
    p = t.spark.range(80 * 60).select(F.floor(F.col("id") / 60).alias("y"), (F.col("id") % 60).alias("z"))
    return p.select("y", "z", matching.open_wedge(F.col("y").cast("double"), F.col("z").cast("double"), (40.25, 29.5), (20.0, 75.0)).alias("single_and_turned"))


@queries.add(f"""
    WITH g AS (SELECT grain, sqrt((x - 25 * round(x / 25)) * (x - 25 * round(x / 25)) + (y - 25 * round(y / 25)) * (y - 25 * round(y / 25)) + (z - 25 * round(z / 25)) * (z - 25 * round(z / 25))) AS d FROM {GRAINS_SQL})
    SELECT grain, round(CASE WHEN d <= 9 THEN d END, 6) AS distance, CASE WHEN d <= 9 THEN 'bragg' ELSE 'diffuse' END AS kind FROM g""")
def lattice_classes(t: Tables) -> DataFrame:
    """Points near a lattice, and those between its points."""
    axis = lambda n, c: t.spark.range(n).select((F.col("id") * 25.0).alias(c))
    lattice = axis(15, "x").crossJoin(axis(15, "y")).crossJoin(axis(6, "z"))
    return rounded(matching.classified_by_lattice(grains(t).select("grain", "x", "y", "z"), lattice, ["x", "y", "z"], 9.0, "grain"))


@queries.add(f"""
    WITH s AS (SELECT spot, o_custkey, (scan - 2.5) * 100 AS p, omega FROM {SPOTS_SQL} JOIN orders ON o_orderkey = spot),
    m AS (SELECT spot, p, (x - 150) * sin(radians(omega)) + (y - 150) * cos(radians(omega)) AS v FROM s JOIN {GRAINS_SQL} ON grain = o_custkey)
    SELECT spot, abs(p - v) < 40 AS direct FROM m WHERE abs(p - v) < 40 OR abs(p + v) < 40""")
def scan_positions(t: Tables) -> DataFrame:
    """Spots whose scan passes through their voxel, or whose mirror image does."""
    s = t.orders.selectExpr("o_orderkey AS spot", "o_custkey", "(CAST(o_orderkey % 6 AS INT) - 2.5D) * 100 AS p", "CAST(o_orderkey * 37 % 3600 AS DOUBLE) / 10 - 180 AS omega")
    v = (F.col("x") - 150) * F.sin(F.radians("omega")) + (F.col("y") - 150) * F.cos(F.radians("omega"))
    m = s.join(grains(t).select("grain", "x", "y"), F.col("o_custkey") == F.col("grain")).withColumn("v", v)
    near = F.abs(F.col("p") - F.col("v")) < 40
    return m.where(checks.any_of([near, F.abs(F.col("p") + F.col("v")) < 40])).select("spot", near.alias("direct"))


@queries.add()
def greedy_frame_matches(t: Tables) -> DataFrame:
    """Spots of one frame matched with those of the next, in order, each taken once."""
    s = spots(t).select("spot", (F.col("frame") / 2).cast("int").alias("pair"), (F.col("frame") % 2).alias("odd"), "y", "z", F.col("ring").cast("double").alias("r"))
    return matching.greedy_mutual(s.where("odd = 0"), s.where("odd = 1"), "pair", "spot", "spot", "y", "z", "r", 60.0)


_RADII = {1: 300.0, 2: 420.0, 3: 560.0, 4: 0.0, 5: 900.0}


def _radius() -> object:
    return F.coalesce(*[F.when(F.col("ring") == k, F.lit(r)) for k, r in _RADII.items()])


def _entries_sql(columns: str = "spot, ring, eta, omega") -> str:
    radius = "CASE ring " + " ".join(f"WHEN {k} THEN CAST({r} AS DOUBLE)" for k, r in _RADII.items()) + " END"
    return f"""
    m AS (SELECT *, least(1.5 + 0.25 / greatest(abs(sin(radians(eta))), 1e-12), 180.0) AS far, degrees(atan(4.0 / r)) + 0.25 AS wide FROM (SELECT *, {radius} AS r FROM {SPOTS_SQL}) WHERE r > 0),
    j AS (SELECT *, CAST(floor((180 + eta - wide) / 3.0) AS BIGINT) AS e0, CAST(floor((180 + eta + wide) / 3.0) AS BIGINT) AS e1, CAST(floor((180 + omega - far) / 4.0) AS BIGINT) AS o0, CAST(floor((180 + omega + far) / 4.0) AS BIGINT) AS o1 FROM m),
    k AS (SELECT *, unnest(range(e0, e1 + 1)) AS ie FROM j), l AS (SELECT *, unnest(range(o0, o1 + 1)) AS io FROM k),
    entries AS (SELECT DISTINCT {columns}, (ie % 120 + 120) % 120 AS ieta, (io % 90 + 90) % 90 AS iomega FROM l)"""


def _entries(t: Tables) -> DataFrame:
    return matching.bin_entries(spots(t), "ring", "eta", "omega", _radius(), 4.0, 1.5, 0.5, 3.0, 4.0)


@queries.add(f"WITH {_entries_sql()} SELECT ring, ieta, iomega, count(*) AS n, min(spot) AS first FROM entries GROUP BY 1, 2, 3")
def bin_contents(t: Tables) -> DataFrame:
    """Spots of every bin of ring, azimuth and rotation that their margins touch, over the ends of the turn."""
    return _entries(t).groupBy("ring", "ieta", "iomega").agg(F.count("*").alias("n"), F.min("spot").alias("first"))


@queries.add(f"WITH {_entries_sql('spot, ring, eta, omega, scan')} SELECT ring, ieta, iomega, scan, count(*) AS n FROM entries GROUP BY 1, 2, 3, 4")
def scan_bin_contents(t: Tables) -> DataFrame:
    """The same with the scan beside each entry."""
    return _entries(t).groupBy("ring", "ieta", "iomega", "scan").agg(F.count("*").alias("n"))


_PREDICTED = "SELECT c_custkey AS k, CAST(c_custkey % 5 + 1 AS INT) AS p_ring, CAST(c_custkey * 71 % 3600 AS DOUBLE) / 10 - 180 + 0.03 AS p_eta, CAST(c_custkey * 59 % 3600 AS DOUBLE) / 10 - 180 + 0.02 AS p_omega, CAST(c_custkey % 50 AS DOUBLE) AS p_offset FROM customer"


@queries.add(f"""
    WITH {_entries_sql('spot, ring, eta, omega, y')}, p AS ({_PREDICTED}),
    c AS (SELECT k, spot, abs(omega - p_omega) AS gap FROM p JOIN entries ON ring = p_ring AND ieta = CAST(floor((180 + p_eta) / 3.0) AS BIGINT) % 120 AND iomega = CAST(floor((180 + p_omega) / 4.0) AS BIGINT) % 90 WHERE abs(eta - p_eta) < 2.5 AND abs(y % 50 - p_offset) < 30),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, spot) AS n FROM c) SELECT k, spot, round(gap, 6) AS gap FROM r WHERE n = 1""")
def probed_predictions(t: Tables) -> DataFrame:
    """For each predicted spot the observed one of its bin with the least difference in rotation, within tolerances of azimuth and radius."""
    p = t.customer.selectExpr("c_custkey AS k", "CAST(c_custkey % 5 + 1 AS INT) AS p_ring", "CAST(c_custkey * 71 % 3600 AS DOUBLE) / 10 - 180 + 0.03D AS p_eta", "CAST(c_custkey * 59 % 3600 AS DOUBLE) / 10 - 180 + 0.02D AS p_omega", "CAST(c_custkey % 50 AS DOUBLE) AS p_offset")
    observed = _entries(t).withColumn("offset", F.col("y") % 50)
    named = p.select("k", F.col("p_ring").alias("ring"), F.col("p_eta").alias("eta"), F.col("p_omega").alias("omega"), F.col("p_offset").alias("offset"))
    return rounded(matching.probed(named, observed, "k", "ring", "eta", "omega", "offset", {"eta": 2.5, "offset": 30.0}, 3.0, 4.0, "spot"))


@queries.add("""
    SELECT p_partkey, round(CASE WHEN d < 12 THEN 1.0 ELSE 0.0 END, 6) AS hard, round(least(greatest((10.0 + 5 - d) / 5, 0), 1), 6) AS trapezoid, round(CASE WHEN d <= 30 THEN exp(-d * d / (2 * pow(20 / (2 * sqrt(2 * ln(2.0))), 2))) ELSE 0 END, 6) AS gaussian
    FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * 0.7 AS d FROM part)""")
def beam_weights(t: Tables) -> DataFrame:
    """How much of three beams reaches a distance."""
    d = F.col("p_size") * 0.7
    return t.part.select("p_partkey", F.round(matching.beam_weight(d, "hard", 12.0), 6).alias("hard"), F.round(matching.beam_weight(d, "trapezoid", 20.0, 5.0), 6).alias("trapezoid"), F.round(matching.beam_weight(d, "gaussian", 20.0, 30.0), 6).alias("gaussian"))


@queries.add(f"""
    WITH p AS ({_PREDICTED}), d AS (SELECT spot, k, abs({_wrap_sql('omega - p_omega')}) AS d_omega, abs({_wrap_sql('eta - p_eta')}) AS d_eta FROM {SPOTS_SQL} JOIN p ON ring = p_ring),
    r AS (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY d_omega * d_omega + d_eta * d_eta, k) AS n FROM d)
    SELECT spot, k, round(d_omega, 5) AS d_omega, round(d_eta, 5) AS d_eta FROM r WHERE n = 1 AND d_omega <= 12 AND d_eta <= 5""")
def associated_spots(t: Tables) -> DataFrame:
    """For each spot the nearest prediction of its ring, over the ends of the turn, if it is within both tolerances."""
    p = t.customer.selectExpr("c_custkey AS k", "CAST(c_custkey % 5 + 1 AS INT) AS ring", "CAST(c_custkey * 71 % 3600 AS DOUBLE) / 10 - 180 + 0.03D AS eta", "CAST(c_custkey * 59 % 3600 AS DOUBLE) / 10 - 180 + 0.02D AS omega")
    return rounded(matching.associated(spots(t), p, "spot", "k", "ring", "omega", "eta", 12.0, 5.0), 5)


def _components_sql(edges: str) -> str:
    """Every node of the edges (a, b) with the smallest node that it reaches."""
    return f"""both_ AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})), reach_(n, m) AS (SELECT a, a FROM both_ UNION SELECT both_.b, reach_.m FROM reach_ JOIN both_ ON both_.a = reach_.n), parts_ AS (SELECT n, min(m) AS component FROM reach_ GROUP BY n)"""


@queries.add(f"""
    WITH RECURSIVE s AS (SELECT * FROM {SPOTS_SQL}), e AS (SELECT a.spot AS a, b.spot AS b FROM s a JOIN s b ON a.scan = b.scan + 1 AND a.ring = b.ring AND abs(a.y - b.y) < 8 AND abs(a.z - b.z) * 0.09375 < 8 AND abs(a.omega - b.omega) < 25),
    {_components_sql('SELECT a, b FROM e')} SELECT spot, coalesce(component, spot) AS chain FROM s LEFT JOIN parts_ ON n = spot""")
def merged_scans(t: Tables) -> DataFrame:
    """Spots of neighbouring scans that are one: each within tolerances of one in the scan before."""
    # z is compared on the scale of y
    s = spots(t).withColumn("z", F.col("z") * 0.09375)
    return matching.chained_scans(s, "spot", "scan", "ring", "y", "z", "omega", 8.0, 25.0)


_STATES = f"a AS (SELECT * FROM {_Q} WHERE grain % 2 = 0), b AS (SELECT * FROM {_Q} WHERE grain % 2 = 1), r AS (SELECT a.grain AS one, b.grain AS two, {_gap_sql('a', 'b')} AS distance, a.radius AS s1, b.radius AS s2, {_turned_sql('a', 'b')} AS r FROM a JOIN b ON {_gap_sql('a', 'b')} < 45)"


@queries.add(f"""
    WITH {_STATES}, c AS (SELECT one, two, distance, {_angle_sql('r')} AS angle FROM r WHERE abs(s1 - s2) <= s1 * 0.6), k AS (SELECT *, abs(angle - 5) / 2 + distance / 10 AS cost FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY two ORDER BY cost, one) AS n FROM k)
    SELECT one, two, round(cost, 4) AS cost, round(angle, 4) AS angle, round(distance, 4) AS distance FROM n WHERE n = 1""")
def state_matches(t: Tables) -> DataFrame:
    """For each grain of a later state the cheapest of the earlier one by angle and distance, of like size."""
    g = _oriented(t)
    one, two = g.where("grain % 2 = 0").withColumnRenamed("grain", "one"), g.where("grain % 2 = 1").withColumnRenamed("grain", "two")
    return rounded(matching.cheapest_states(one, two, "one", "two", ["x", "y", "z"], "q", "radius", "m-3m", 45.0, (2.0, 10.0), 60.0, 5.0), 4)


@queries.add(f"""
    WITH {_STATES}, c AS (SELECT one, two, distance, {_angle_sql('r')} AS angle FROM r)
    SELECT one, two, round(angle, 4) AS orientation, round(distance, 4) AS position FROM c WHERE angle > 0.01""")
def state_cost_modes(t: Tables) -> DataFrame:
    """Costs by orientation alone and by distance alone."""
    g = _oriented(t)
    one, two = g.where("grain % 2 = 0").withColumnRenamed("grain", "one"), g.where("grain % 2 = 1").withColumnRenamed("grain", "two")
    # both modes' costs stand beside each other: pairs are looked at once
    costs = matching.state_costs(one, two, "one", "two", ["x", "y", "z"], "q", "radius", "m-3m", 45.0, "orientation")
    return rounded(costs.select("one", "two", F.col("cost").alias("orientation"), F.col("distance").alias("position")).where("orientation > 0.01"), 4)


@queries.add()
def stitched_layers(t: Tables) -> DataFrame:
    """Grains of neighbouring layers that are one, merged in order."""
    return rounded(matching.stitched(_oriented(t).withColumn("stack", F.lit(1)), "stack", "grain", "layer", ["x", "y", "z"], "q", "m-3m", 40.0, 12.0))


@queries.add(f"""
    SELECT grain, round(x + coalesce(r.r_regionkey, 0) * 1.5, 6) AS x, round(z + 100 * layer, 6) AS z FROM {GRAINS_SQL} LEFT JOIN (SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0) r ON r.n_nationkey = layer""")
def grain_offsets(t: Tables) -> DataFrame:
    """Grains' places moved by their layer's offset, where there is one, and by the beam's thickness for each layer."""
    offsets = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("layer"), (F.col("n_regionkey") * 1.5).alias("offset"))
    moved = joins.with_default(grains(t), offsets, "layer", "offset", 0.0)
    return rounded(moved.select("grain", (F.col("x") + F.col("offset")).alias("x"), (F.col("z") + 100 * F.col("layer")).alias("z")))


@queries.add(f"WITH q AS (SELECT * FROM {_Q}), p AS (SELECT a.grain AS a, b.grain AS b, {_turned_sql('a', 'b')} AS r FROM q a JOIN q b ON a.grain < b.grain) SELECT a, b, round({_angle_sql('r')}, 3) AS angle FROM p WHERE {_angle_sql('r')} < 4")
def orientation_pairs(t: Tables) -> DataFrame:
    """Pairs of grains of nearly one orientation, by cells of their symmetric representatives."""
    return rounded(matching.orientation_pairs(_oriented(t), "grain", "q", "m-3m", 4.0), 3)


@queries.add(f"""
    WITH RECURSIVE q AS (SELECT *, row_number() OVER (ORDER BY grain) AS i FROM {_Q}), p AS (SELECT a.grain AS a, b.grain AS b, {_turned_sql('a', 'b')} AS r FROM q a JOIN q b ON a.grain < b.grain AND {_gap_sql('a', 'b')} < 60),
    l AS (SELECT b, list(a) AS low FROM p WHERE {_angle_sql('r')} < 25 GROUP BY b), n AS (SELECT i, grain, coalesce(low, []) AS low FROM q LEFT JOIN l ON b = grain),
    w(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.i, CASE WHEN list_has_any(w.kept, n.low) THEN w.kept ELSE list_append(w.kept, n.grain) END FROM w JOIN n ON n.i = w.i + 1)
    SELECT grain, confidence FROM q JOIN (SELECT unnest(kept) AS k FROM (SELECT kept FROM w ORDER BY i DESC LIMIT 1)) ON k = grain WHERE confidence >= 0.05""")
def distinct_grains(t: Tables) -> DataFrame:
    """Grains that aren't duplicates of an earlier kept one near them in place and orientation, and are confident enough."""
    g = _oriented(t)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (matching.gaps(a[:, :3], b[:, :3]) < 60) & (matching.misoriented(a[:, 3:], b[:, 3:], "m-3m") < 25)

    def pairs(rest: DataFrame) -> DataFrame:
        some = g.join(rest.select("grain"), "grain", "left_semi")
        met = joins.pairs_within(some, "grain", ["x", "y", "z"], 60.0).select("a", "b")
        both = met.join(some.select(F.col("grain").alias("a"), F.col("q").alias("p")), "a").join(some.select(F.col("grain").alias("b"), F.col("q").alias("q")), "b")
        return both.where(rotations.misorientation(F.col("p"), F.col("q"), "m-3m") < 25)

    leads = matching.first_leads(g.select("grain", "x", "y", "z", *[F.col("q")[k].alias(f"q{k}") for k in range(4)]), "grain", ["x", "y", "z", "q0", "q1", "q2", "q3"], near, pairs)
    marked = leads.select("grain", (F.col("lead") != F.col("grain")).alias("duplicate"))
    return g.join(marked.where("NOT duplicate"), "grain").where("confidence >= 0.05").select("grain", "confidence")


_TWIN = "CASE WHEN r[4] >= (r[3] + r[4]) / sqrt(2.0) AND r[4] >= (r[1] + r[2] + r[3] + r[4]) / 2 THEN [r[3], r[2], r[1]] WHEN (r[3] + r[4]) / sqrt(2.0) >= (r[1] + r[2] + r[3] + r[4]) / 2 THEN [(r[4] - r[3]) / sqrt(2.0), (r[2] + r[1]) / sqrt(2.0), (r[2] - r[1]) / sqrt(2.0)] ELSE [abs(-r[4] + r[3] - r[2] + r[1]) / 2, abs(-r[4] + r[3] + r[2] - r[1]) / 2, abs(-r[4] - r[3] + r[2] + r[1]) / 2] END"


@queries.add(f"""
    WITH m AS (SELECT * FROM {_Q} WHERE variant = 0), w AS (SELECT * FROM {_Q} WHERE variant = 1), d AS (SELECT m.grain AS matrix, w.grain AS twin, {_gap_sql('m', 'w')} AS distance, {_turned_sql('m', 'w')} AS r FROM m JOIN w ON {_gap_sql('m', 'w')} < 80),
    n AS (SELECT *, row_number() OVER (PARTITION BY matrix ORDER BY distance, twin) AS k FROM d), a AS (SELECT *, {_angle_sql('r')} AS angle, {_TWIN} AS axis FROM n WHERE k <= 10),
    f AS (SELECT *, row_number() OVER (PARTITION BY matrix ORDER BY distance, twin) AS f FROM a WHERE angle BETWEEN 30 AND 60 AND (axis[1] + axis[2] + axis[3]) / sqrt(3.0) / sqrt(axis[1] * axis[1] + axis[2] * axis[2] + axis[3] * axis[3]) >= 0.93)
    SELECT matrix, twin, round(distance, 4) AS distance, round(angle, 3) AS angle FROM f WHERE f = 1""")
def twin_partners(t: Tables) -> DataFrame:
    """For each matrix grain the nearest of its ten nearest twins that is turned by the right angle about the right axis."""
    g = _oriented(t)
    near = matching.spatial_neighbours(g.where("variant = 0").select(F.col("grain").alias("matrix"), "x", "y", "z"), g.where("variant = 1").select(F.col("grain").alias("twin"), "x", "y", "z"), "matrix", "twin", ["x", "y", "z"], 80.0, 10)
    both = near.join(g.select(F.col("grain").alias("matrix"), F.col("q").alias("p")), "matrix").join(g.select(F.col("grain").alias("twin"), "q"), "twin")
    both = both.withColumns({"angle": rotations.misorientation(F.col("p"), F.col("q"), "m-3m"), "axis": matching.disorientation_axis(F.col("p"), F.col("q"), "m-3m")})
    aligned = F.aggregate("axis", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.sqrt(F.lit(3.0))
    fine = both.where(F.col("angle").between(30, 60) & (aligned >= 0.93))
    return rounded(fine.groupBy("matrix").agg(F.min(F.struct("distance", "twin", "angle")).alias("m")).select("matrix", "m.twin", F.round("m.distance", 4).alias("distance"), F.round("m.angle", 3).alias("angle")))


@queries.add(f"""
    WITH q AS (SELECT * FROM {_Q}), d AS (SELECT a.grain, b.grain AS other, {_gap_sql('a', 'b')} AS distance, {_turned_sql('a', 'b')} AS r FROM q a JOIN q b ON a.grain <> b.grain AND a.variant = b.variant AND {_gap_sql('a', 'b')} < 60 AND {_gap_sql('a', 'b')} > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY grain ORDER BY distance, other) AS k FROM d)
    SELECT grain, count(*) AS neighbours, round(avg(radians({_angle_sql('r')}) / (distance * 0.25)), 6) AS density FROM n WHERE k <= 5 GROUP BY grain""")
def dislocation_density(t: Tables) -> DataFrame:
    """Mean angle to the five nearest grains of the same variant over their distance."""
    g = _oriented(t)
    both = matching.nearest_others(g, "grain", ["x", "y", "z"], 60.0, 5, ["variant"], ["q"])
    angle = F.radians(rotations.misorientation(F.col("a_q"), F.col("b_q"), "m-3m"))
    return both.groupBy("grain").agg(F.count("*").alias("neighbours"), F.round(F.avg(angle / (F.col("distance") * 0.25)), 6).alias("density"))


@queries.add(f"""
    WITH p AS (SELECT c_custkey AS k, CAST(c_custkey * 17 % 997 AS DOUBLE) AS py, CAST(c_custkey * 19 % 991 AS DOUBLE) AS pz, CAST(c_custkey * 59 % 3600 AS DOUBLE) / 10 - 180 AS po FROM customer),
    c AS (SELECT k, spot, pow((y - py) / 40, 2) + pow((z - pz) / 40, 2) + pow((omega - po) / 20, 2) AS d FROM p JOIN {SPOTS_SQL} ON abs(y - py) < 40 AND abs(z - pz) < 40 AND abs(omega - po) < 20), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, spot) AS n FROM c)
    SELECT k, spot, round(d, 6) AS d FROM r WHERE n = 1""")
def attributed_spots(t: Tables) -> DataFrame:
    """The detected spot that each predicted one claims: the nearest on the scale of the tolerances."""
    p = t.customer.selectExpr("c_custkey AS k", "CAST(c_custkey * 17 % 997 AS DOUBLE) AS y", "CAST(c_custkey * 19 % 991 AS DOUBLE) AS z", "CAST(c_custkey * 59 % 3600 AS DOUBLE) / 10 - 180 AS omega")
    return rounded(matching.claimed_nearest(p, spots(t), "k", "spot", {"y": 40.0, "z": 40.0, "omega": 20.0}))


_AGREE = "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) FILTER (WHERE a.l_returnflag = b.l_returnflag) AS agree, count(*) FILTER (WHERE a.l_returnflag <> b.l_returnflag) AS disagree FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2"


@queries.add(f"""
    WITH RECURSIVE g AS ({_AGREE}), {_components_sql('SELECT a, b FROM g WHERE agree >= 2 AND disagree <= agree')}, l AS (SELECT s_suppkey AS n, coalesce(component, s_suppkey) AS component FROM supplier LEFT JOIN parts_ ON n = s_suppkey)
    SELECT DISTINCT least(x.component, y.component) AS one, greatest(x.component, y.component) AS two FROM g JOIN l x ON x.n = g.a JOIN l y ON y.n = g.b WHERE disagree >= 3 AND x.component <> y.component""")
def twin_components(t: Tables) -> DataFrame:
    """Components of candidates that agree, and the pairs of components that contradict each other often enough to be twins."""
    one = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("a"), F.col("l_returnflag").alias("fa"))
    met = one.join(t.lineitem.select("l_partkey", F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("fb")), "l_partkey").where("a < b")
    g = met.groupBy("a", "b").agg(F.count_if(F.col("fa") == F.col("fb")).alias("agree"), F.count_if(F.col("fa") != F.col("fb")).alias("disagree"))
    found = connected(g.where("agree >= 2 AND disagree <= agree"), "a", "b")
    named = t.supplier.select(F.col("s_suppkey").alias("node")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    both = g.where("disagree >= 3").join(named.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    return both.where("x <> y").select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")).distinct()


_HKL = "(SELECT a.i AS h, b.i AS k, c.i AS l, a.i * a.i + b.i * b.i + c.i * c.i AS ring FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i) WHERE a.i <> 0 OR b.i <> 0 OR c.i <> 0)"


@queries.add(f"""
    WITH v AS (SELECT vec_id, label % 3 + 1 AS ring, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 4)] AS v FROM embeddings), c AS (SELECT vec_id, h, k, l, (h * v[1] + k * v[2] + l * v[3]) / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) / sqrt(CAST(r.ring AS DOUBLE)) AS c FROM v JOIN {_HKL} r ON r.ring = v.ring),
    n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, h, k, l) AS n FROM c) SELECT vec_id, h, k, l, round(degrees(acos(least(c, 1.0))), 4) AS angle FROM n WHERE n = 1 AND degrees(acos(least(c, 1.0))) <= 25""")
def seed_reflections(t: Tables) -> DataFrame:
    """The signed reflection of its ring that each seed's direction is nearest to; none if that is too far."""
    axis = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    hkl = t.spark.range(1).select(axis.alias("h")).select("h", axis.alias("k")).select("h", "k", axis.alias("l")).where("h <> 0 OR k <> 0 OR l <> 0").withColumn("ring", F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l"))
    v = t.embeddings.select("vec_id", (F.col("label") % 3 + 1).alias("ring"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"v{k}") for k in range(3)])
    size = F.sqrt(F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2"))
    c = (F.col("h") * F.col("v0") + F.col("k") * F.col("v1") + F.col("l") * F.col("v2")) / size / F.sqrt(F.col("ring").cast("double"))
    best = v.join(F.broadcast(hkl), "ring").groupBy("vec_id").agg(F.min(F.struct((-c).alias("c"), F.col("h").cast("long").alias("h"), F.col("k").cast("long").alias("k"), F.col("l").cast("long").alias("l"))).alias("m"))
    angle = F.degrees(F.acos(F.least(-F.col("m.c"), F.lit(1.0))))
    return best.where(angle <= 25).select("vec_id", "m.h", "m.k", "m.l", F.round(angle, 4).alias("angle"))


_ANTIPODAL = f"s AS (SELECT spot, ring, omega, (y - 498.5) / sqrt(pow(y - 498.5, 2) + pow(z - 495.5, 2)) AS u, (z - 495.5) / sqrt(pow(y - 498.5, 2) + pow(z - 495.5, 2)) AS v FROM {SPOTS_SQL}), c AS (SELECT a.ring, a.spot AS a, b.spot AS b, abs(abs(a.omega - b.omega) - 180) / 1.5 + sqrt((a.u + b.u) * (a.u + b.u) + (a.v + b.v) * (a.v + b.v)) / 0.2 AS score FROM s a JOIN s b ON a.ring = b.ring AND a.spot < b.spot AND abs(abs(a.omega - b.omega) - 180) < 1.5 AND sqrt((a.u + b.u) * (a.u + b.u) + (a.v + b.v) * (a.v + b.v)) < 0.2)"


@queries.add(f"WITH {_ANTIPODAL} SELECT ring, a, b, round(score, 6) AS score FROM c")
def friedel_candidates(t: Tables) -> DataFrame:
    """Pairs of spots half a turn apart in opposite directions."""
    return rounded(matching.antipodal_pairs(*_directions(t)))


def _directions(t: Tables) -> tuple:
    """Spots with their directions, and what names and bounds antipodal pairs."""
    y, z = F.col("y") - 498.5, F.col("z") - 495.5
    n = F.sqrt(F.pow(y, 2) + F.pow(z, 2))
    s = spots(t).select("spot", "ring", "omega", (y / n).alias("u"), (z / n).alias("v"))
    return s, "spot", ["ring"], "omega", "u", "v", 1.5, 0.2


@queries.add(f"""
    WITH RECURSIVE {_ANTIPODAL}, o AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY score, a, b) AS i FROM c),
    w(ring, i, used, a, b) AS (SELECT DISTINCT ring, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o UNION ALL SELECT o.ring, o.i, CASE WHEN list_has_any(w.used, [o.a, o.b]) THEN w.used ELSE list_concat(w.used, [o.a, o.b]) END, CASE WHEN list_has_any(w.used, [o.a, o.b]) THEN NULL ELSE o.a END, o.b FROM w JOIN o ON o.ring = w.ring AND o.i = w.i + 1)
    SELECT ring, a, b FROM w WHERE a IS NOT NULL""")
def friedel_matches(t: Tables) -> DataFrame:
    """The same, best first, each spot used once."""
    return matching.antipodal_matches(*_directions(t))


@queries.add(f"WITH {_ANTIPODAL} SELECT DISTINCT s.spot FROM s JOIN c ON s.spot IN (c.a, c.b)")
def friedel_seeds(t: Tables) -> DataFrame:
    """Seeds that an observed partner confirms."""
    return matching.antipodal_spots(*_directions(t))


_PHASES = [("copper", 3.615), ("iron", 2.866), ("nickel", 3.524), ("gold", 4.078)]


@queries.add("""
    WITH o AS (SELECT DISTINCT 4.078 / sqrt(CAST(p_size % 9 + 1 AS DOUBLE)) * (1 + (p_size % 4) * 0.001) AS d FROM part), m AS (SELECT name, a / sqrt(CAST(n AS DOUBLE)) AS r FROM (VALUES """ + ", ".join(f"('{n}', CAST({a} AS DOUBLE))" for n, a in _PHASES) + """) AS p(name, a), (VALUES (3), (4), (8), (11), (12)) AS q(n)),
    l AS (SELECT o.d, name, min(abs(o.d - r) / r) AS gap FROM o, m GROUP BY 1, 2), s AS (SELECT name, avg(gap) AS score FROM l GROUP BY 1) SELECT name, round(score, 8) AS score, row_number() OVER (ORDER BY score, name) AS place FROM s""")
def detected_phases(t: Tables) -> DataFrame:
    """Candidate crystals by how near their spacings come to the observed ones."""
    o = t.part.select((F.lit(4.078) / F.sqrt((F.col("p_size") % 9 + 1).cast("double")) * (1 + (F.col("p_size") % 4) * 0.001)).alias("d")).distinct()
    c = t.spark.createDataFrame([(n, a / k**0.5) for n, a in _PHASES for k in (3, 4, 8, 11, 12)], "name string, r double")
    found = matching.likeliest(o, c, "d", "name", "r")
    return found.select("name", F.round("score", 8).alias("score"), F.row_number().over(Window.orderBy("score", "name")).alias("place"))


@queries.add("SELECT o_orderkey AS frame, o_totalprice AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'pumped' ELSE 'rest' END AS state FROM orders")
def trigger_tags(t: Tables) -> DataFrame:
    """Frames with their trigger's state; a trigger for each frame must be there."""
    frames = t.orders.select(F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("v"))
    triggers = t.orders.select(F.col("o_orderkey").alias("frame"), F.when(F.col("o_orderkey") % 2 == 0, "pumped").otherwise("rest").alias("state"))
    return matching.tagged(frames, triggers, "frame")


@queries.add(f"WITH a AS (SELECT * FROM {GRAINS_SQL} WHERE grain % 2 = 0), b AS (SELECT * FROM {GRAINS_SQL} WHERE grain % 2 = 1) SELECT grain FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_gap_sql('a', 'b')} < 20)")
def unmatched_grains(t: Tables) -> DataFrame:
    """Grains without any of the other state near them."""
    g = grains(t).select("grain", "x", "y", "z")
    one, two = g.where("grain % 2 = 0"), g.where("grain % 2 = 1").withColumnRenamed("grain", "other")
    return matching.lonely(one, two, "grain", "other", ["x", "y", "z"], 20.0).select("grain")
