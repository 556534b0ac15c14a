"""Queries that show searches and iterative kernels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.functions import geometry
from ringfold.operators import checks, search
from ringfold.operators.graph import connected, grid_links
from ringfold.plans.matching import _components_sql, _oriented
from ringfold.plans.registry import Registry, Tables
from ringfold.plans.synthetic import SPOTS_SQL, rounded, spots

queries = Registry()

_ARCS = [(1, r, -180.0, 40.0) for r in range(1, 5)] + [(2, r, -30.0, 180.0) for r in range(1, 4)] + [(3, r, 100.0, 140.0) for r in (2, 3)]
_ARCS_SQL = "(VALUES " + ", ".join(f"({p}, {r}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for p, r, a, b in _ARCS) + ") AS arcs(panel, ring, lo, hi)"
_MODEL_SQL = f"""seen AS (SELECT ring, bin, count(DISTINCT panel) AS panels FROM (SELECT panel, ring, unnest(range(CAST(floor((lo + 180) / 10) AS BIGINT), CAST(ceil((hi + 180) / 10) AS BIGINT))) AS bin FROM {_ARCS_SQL}) GROUP BY 1, 2),
    sums AS (SELECT ring, least(greatest(CAST(floor((eta + 180) / 10) AS BIGINT), 0), 35) AS bin, sum(ii) AS i FROM {SPOTS_SQL} GROUP BY 1, 2), model AS (SELECT ring, bin, coalesce(panels, 0) AS panels, CASE WHEN panels > 0 THEN i / panels ELSE 0 END AS mean FROM sums LEFT JOIN seen USING (ring, bin))"""


@queries.add(f"WITH {_MODEL_SQL} SELECT ring, bin, panels, round(mean, 4) AS mean FROM model")
def powder_model(t: Tables) -> DataFrame:
    """Powder intensity by ring and azimuth, averaged over the panels that see it."""
    return _model(t).withColumn("mean", F.round("mean", 4))


def _model(t: Tables) -> DataFrame:
    return search.powder_model(spots(t), t.spark.createDataFrame(_ARCS, "panel int, ring int, lo double, hi double"), "ring", "eta", "ii", 10.0)


@queries.add(f"WITH {_MODEL_SQL}, total AS (SELECT ring, sum(mean) * 10 AS t FROM model GROUP BY 1) SELECT spot, round(CASE WHEN t > 0 THEN pow(3 * 1000000 * ii / t / (4 * pi()), 1.0 / 3) END, 6) AS radius FROM {SPOTS_SQL} JOIN total USING (ring)")
def powder_radii(t: Tables) -> DataFrame:
    """Radii of grains from their spots' share of the powder model."""
    total = _model(t).groupBy("ring").agg((F.sum("mean") * 10).alias("t"))
    share = F.when(F.col("t") > 0, 3 * 1000000 * F.col("ii") / F.when(F.col("t") > 0, F.col("t")) / (4 * math.pi))
    return spots(t).join(F.broadcast(total), "ring").select("spot", F.round(F.pow(share, 1.0 / 3), 6).alias("radius"))


@queries.add(f"SELECT spot, round(sqrt(pow(y - 498.5, 2) + pow(z - 495.25, 2)), 5) AS radius, round(eta, 5) AS eta FROM {SPOTS_SQL}")
def inverted_pixels(t: Tables) -> DataFrame:
    """Radius and azimuth to a place on the detector, and from there back by the detector's own equations."""
    p = [0.001, 0.0005, -0.002, 12.0]
    s = spots(t).select("spot", F.sqrt(F.pow(F.col("y") - 498.5, 2) + F.pow(F.col("z") - 495.25, 2)).alias("radius"), "eta")
    placed = search.pixels_at(s.select("spot", "radius", "eta"), "radius", "eta", 5000.0, (0.3, -0.2, 0.5), 700.0, p)
    y, z = geometry.tilt_corrected(F.col("y"), F.col("z"), 5000.0, (0.3, -0.2, 0.5))
    flat = placed.select("spot", y.alias("y"), z.alias("z")).select("spot", F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("r"), geometry.eta("y", "z").alias("e"))
    seen = flat.select("spot", (F.col("r") * geometry.distortion(F.col("r"), F.col("e"), 700.0, p)).alias("radius"), F.col("e").alias("eta"))
    # half a turn is one azimuth with two names
    return seen.select("spot", F.round("radius", 5).alias("radius"), F.round(F.when(F.col("eta") > 179.999999, F.col("eta") - 360).otherwise(F.col("eta")), 5).alias("eta"))


@queries.add("""
    WITH p AS (SELECT n_nationkey AS file, n_nationkey % 4 AS rmin, n_regionkey AS rmax, 10 + n_nationkey % 3 AS first, 12 - n_nationkey % 4 AS last, n_nationkey % 3 + 1 AS rings, 2 AS thresholds, 0.25 * (n_nationkey % 2 * 2 - 1) AS step, n_regionkey * 10.0 - 20 AS w0, n_nationkey - 12.0 AS w1 FROM nation)
    SELECT file, 'radii' AS rule FROM p WHERE NOT rmax > rmin UNION ALL SELECT file, 'numbers' FROM p WHERE NOT first <= last UNION ALL SELECT file, 'thresholds' FROM p WHERE NOT rings = thresholds UNION ALL SELECT file, 'direction' FROM p WHERE NOT sign(step) = sign(w1 - w0)""")
def parameter_rules(t: Tables) -> DataFrame:
    """Rules over several parameters of a file at once, on parameters pivoted to a row for each file."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in (("rmin", n % 4), ("rmax", r), ("first", 10 + n % 3), ("last", 12 - n % 4), ("rings", n % 3 + 1), ("thresholds", F.lit(2)), ("step", 0.25 * (n % 2 * 2 - 1)), ("w0", r * 10.0 - 20), ("w1", n - 12.0))])
    long = t.nation.select(n.alias("file"), F.explode(rows).alias("p")).select("file", "p.key", "p.value")
    wide = long.groupBy("file").pivot("key", ["rmin", "rmax", "first", "last", "rings", "thresholds", "step", "w0", "w1"]).agg(F.first("value"))
    rules = {"radii": F.col("rmax") > F.col("rmin"), "numbers": F.col("first") <= F.col("last"), "thresholds": F.col("rings") == F.col("thresholds"), "direction": F.signum("step") == F.signum(F.col("w1") - F.col("w0"))}
    return checks.violations(wide, "file", rules)


_KERNEL = search.log_kernel(1.0, 2)
_KERNEL_SQL = "(VALUES " + ", ".join(f"({i - 2}, {j - 2}, CAST({_KERNEL[i][j]!r} AS DOUBLE))" for i in range(5) for j in range(5)) + ") AS kernel(di, dj, c)"
_STACK = "SELECT l_linenumber AS frame, CAST(l_partkey % 30 AS BIGINT) AS y, CAST(l_suppkey % 10 * 3 + l_orderkey % 3 AS BIGINT) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"


@queries.add(f"""
    WITH RECURSIVE s AS ({_STACK}), m AS (SELECT y, x, quantile_disc(v, 0.5) AS m FROM s GROUP BY 1, 2), c AS (SELECT frame, y, x, greatest(v - m, 0) AS v FROM s JOIN m USING (y, x)),
    l AS (SELECT a.frame, a.y + di AS y, a.x + dj AS x, sum(a.v * c) AS w FROM c a CROSS JOIN {_KERNEL_SQL} GROUP BY 1, 2, 3), b AS (SELECT c.frame, c.y, c.x, c.frame * 1000 + c.y * 30 + c.x AS id FROM c JOIN l ON l.frame = c.frame AND l.y = c.y AND l.x = c.x WHERE l.w < -20),
    e AS (SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.frame = q.frame AND p.id < q.id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1), {_components_sql('SELECT a, b FROM e')}, z AS (SELECT b.*, coalesce(component, id) AS label FROM b LEFT JOIN parts_ ON n = id)
    SELECT frame, CAST(label AS BIGINT) AS label, count(*) AS pixels, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM z GROUP BY 1, 2 HAVING count(*) >= 2""")
def labelled_spots(t: Tables) -> DataFrame:
    """Spots of a stack of images: the temporal median off, a Laplacian of a Gaussian, what lies below a bound, and its connected regions."""
    s = t.lineitem.groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 30).alias("y"), (F.col("l_suppkey") % 10 * 3 + F.col("l_orderkey") % 3).alias("x")).agg(F.sum("l_quantity").alias("v"))
    m = s.groupBy("y", "x").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("m"))
    c = s.join(m, ["y", "x"]).select("frame", "y", "x", F.greatest(F.col("v") - F.col("m"), F.lit(0.0)).alias("v"))
    b = search.convolved(c, _KERNEL, ["frame"]).where("w < -20").withColumn("id", F.col("frame") * 1000 + F.col("y") * 30 + F.col("x"))
    found = connected(grid_links(b, ["frame"], "id", "y", "x"), "a", "b")
    named = b.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    return named.groupBy("frame", "label").agg(F.count("*").alias("pixels"), F.round(F.avg("y"), 6).alias("y"), F.round(F.avg("x"), 6).alias("x")).where("pixels >= 2")


@queries.add("""
    WITH RECURSIVE d AS (SELECT CAST(p_size AS DOUBLE) / 200 AS q, 1000 * exp(-pow(12.0 * p_size / 200, 2) / 3) * (1 + 0.01 * (p_size % 5 - 2)) AS i, count(*) * 1.0 AS w FROM part GROUP BY p_size), p AS (SELECT q * q AS x, q, ln(i) AS y, w * i * i AS w FROM d),
    r(k, rg, done) AS (SELECT 0, CAST(10.0 AS DOUBLE), FALSE UNION ALL SELECT k + 1, n.rg, abs(n.rg - r.rg) / r.rg < 1e-4 FROM r, LATERAL (SELECT sqrt(greatest(-3 * (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 1e-30)) AS rg FROM p WHERE q <= 1.3 / r.rg) n WHERE k < 20 AND NOT done)
    SELECT round(rg, 6) AS radius, CAST(k AS BIGINT) AS rounds FROM r ORDER BY k DESC LIMIT 1""")
def guinier_rounds(t: Tables) -> DataFrame:
    """A radius of gyration, its range narrowed round by round."""
    size = F.col("p_size")
    d = t.part.groupBy("p_size").agg(F.count("*").alias("n")).select((size.cast("double") / 200).alias("q"), (1000 * F.exp(-F.pow(12.0 * size / 200, 2) / 3) * (1 + 0.01 * (size % 5 - 2))).alias("i"), (F.col("n") * 1.0).alias("w"))
    fit = search.guinier(d, "q", "i", "w")
    return t.spark.createDataFrame([(round(fit["radius"], 6), fit["rounds"])], "radius double, rounds long")


@queries.add()
def best_solutions(t: Tables) -> DataFrame:
    """The three best orientations of each voxel, no two of them alike, in the order in which they were offered."""
    return search.best_solutions(_oriented(t).withColumn("score", F.col("confidence")), "layer", "grain", "q", "score", 3, 8.0, "m-3m")


@queries.add()
def variant_medoids(t: Tables) -> DataFrame:
    """Grains of each layer about two medoids by orientation."""
    return search.medoids(_oriented(t), "layer", "grain", "q", "m-3m", 2)


@queries.add()
def smoothed_maps(t: Tables) -> DataFrame:
    """Maps of grains smoothed where the evidence is weak."""
    p = t.lineitem.groupBy(F.col("l_returnflag").alias("m"), (F.col("l_partkey") % 20).alias("y"), (F.col("l_suppkey") % 10 * 2 + F.col("l_orderkey") % 2).alias("x"), (F.col("l_linenumber") % 4).alias("grain")).agg(F.sum("l_quantity").alias("p"))
    return search.smoothed_labels(p.withColumn("p", F.col("p") / 500), "m", "y", "x", "grain", "p", 0.4)


@queries.add()
def chosen_measurements(t: Tables) -> DataFrame:
    """The five measurements of a short list that tell most together."""
    rows = [(r.vec_id, [float(x) for x in r.v]) for r in t.embeddings.where("vec_id < 40").select("vec_id", F.slice("embedding", 1, 4).alias("v")).orderBy("vec_id").collect()]
    return t.spark.createDataFrame([(n, round(i, 6)) for n, i in search.chosen_measurements(rows, 5)], "vec_id long, information double")
