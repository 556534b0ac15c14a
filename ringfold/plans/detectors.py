"""Queries that show the image, cake and voxel operators on grids made of the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.operators import images, windows
from ringfold.plans.registry import Registry, Tables

queries = Registry()

_IMAGE = "SELECT CAST(l_orderkey // 4 % 30 AS BIGINT) AS y, CAST(l_partkey % 30 AS BIGINT) AS x, sum(l_quantity) AS v, sum(l_tax) AS t FROM lineitem GROUP BY 1, 2"


def _image(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.floor(F.col("l_orderkey") / 4) % 30).alias("y"), (F.col("l_partkey") % 30).alias("x")).agg(F.sum("l_quantity").alias("v"), F.sum("l_tax").alias("t"))


@queries.add(f"""
    WITH i AS ({_IMAGE}) SELECT y, x, round(greatest((v - CASE WHEN x % 2 = 0 THEN 10 * y ELSE 0 END) / CASE WHEN y < 20 THEN 2.0 ELSE 1.0 END, 0), 6) AS v FROM i
    WHERE NOT (y BETWEEN 5 AND 7) AND greatest((v - CASE WHEN x % 2 = 0 THEN 10 * y ELSE 0 END) / CASE WHEN y < 20 THEN 2.0 ELSE 1.0 END, 0) > 20""")
def corrected_frame(t: Tables) -> DataFrame:
    """A frame with dark, flood, mask and threshold applied."""
    i = _image(t).select("y", "x", "v")
    dark, flood = i.where("x % 2 = 0").select("y", "x", (F.col("y") * 10.0).alias("v")), i.where("y < 20").select("y", "x", F.lit(2.0).alias("v"))
    return images.corrected(i, dark, flood, i.where("y BETWEEN 5 AND 7"), F.lit(20.0)).select("y", "x", F.round("v", 6).alias("v"))


@queries.add(f"""
    WITH i AS ({_IMAGE}) SELECT a.y, a.x, round(CASE WHEN a.y BETWEEN 1 AND 28 AND a.x BETWEEN 1 AND 28 THEN (SELECT quantile_disc(b.v, 0.5) FROM i b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) ELSE a.v END, 6) AS median FROM i a""")
def spatial_medians(t: Tables) -> DataFrame:
    """3x3 medians, the border as it is."""
    return images.spatial_median(_image(t).select("y", "x", "v"), [], 30, 30).select("y", "x", F.round("median", 6).alias("median"))


@queries.add(f"""
    WITH i AS (SELECT y, x, v - 1500 AS v FROM ({_IMAGE})) SELECT a.y, a.x FROM i a JOIN i b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
    WHERE a.y BETWEEN 1 AND 28 AND a.x BETWEEN 1 AND 28 GROUP BY 1, 2 HAVING min((b.v >= 0)::INT) <> max((b.v >= 0)::INT)""")
def zero_crossings(t: Tables) -> DataFrame:
    """Pixels whose neighbourhood changes sign."""
    return images.zero_crossings(_image(t).select("y", "x", (F.col("v") - 1500).alias("v")), [], 30, 30).select("y", "x")


@queries.add(f"""
    WITH i AS ({_IMAGE}), e AS (SELECT *, (v > 500)::BIGINT + (v > 1000)::BIGINT + (v > 2000)::BIGINT AS k FROM i) SELECT least(k, 3) AS cell, count(*) AS n, round(avg(t), 6) AS mean FROM e GROUP BY 1""")
def remapped_cells(t: Tables) -> DataFrame:
    """Pixels put on a grid of uneven edges: the mean of each cell."""
    cell = images.lower_edge(F.col("v"), [0.0, 500.0, 1000.0, 2000.0, 1e9]).cast("long")
    return _image(t).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean"))


@queries.add("""
    WITH m AS (SELECT l_returnflag AS k, CAST(l_linenumber AS DOUBLE) AS r, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT k, i * 0.5 AS q FROM m, range(1, 17) t(i)),
    j AS (SELECT g.k, q, max(a.r) FILTER (WHERE a.r <= q) AS lo, min(a.r) FILTER (WHERE a.r > q) AS hi FROM g JOIN m a ON a.k = g.k GROUP BY 1, 2)
    SELECT j.k, q, round(CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (q - lo) / (hi - lo) END, 4) AS v FROM j LEFT JOIN m a ON a.k = j.k AND a.r = lo LEFT JOIN m b ON b.k = j.k AND b.r = hi""")
def regrouped_profile(t: Tables) -> DataFrame:
    """Azimuthal means interpolated on a common grid, the ends held."""
    cake = t.lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").cast("double").alias("r"), F.col("l_extendedprice").alias("i"))
    grid = cake.select("k").distinct().select("k", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("n")).select("k", (F.col("n") * 0.5).alias("q"))
    return images.regrouped(cake, ["k"], "r", "i", grid, "q").select("k", "q", F.round("v", 4).alias("v"))


@queries.add("""
    SELECT l_linenumber AS q, round(coalesce(sum(v / (s * s)) FILTER (WHERE s > 0) / sum(1 / (s * s)) FILTER (WHERE s > 0), avg(v)), 4) AS value, round(1 / sqrt(sum(1 / (s * s)) FILTER (WHERE s > 0)), 6) AS sigma, count(*) AS n
    FROM (SELECT l_linenumber, l_returnflag, avg(l_extendedprice) AS v, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def combined_detectors(t: Tables) -> DataFrame:
    """Several detectors on one grid by inverse variance."""
    parts = t.lineitem.groupBy(F.col("l_linenumber").alias("q"), "l_returnflag").agg(F.avg("l_extendedprice").alias("v"), F.stddev_pop("l_quantity").alias("s"))
    return images.combined(parts, ["q"], "v", "s").select("q", F.round("value", 4).alias("value"), F.round("sigma", 6).alias("sigma"), "n")


@queries.add(f"""
    WITH i AS ({_IMAGE}), s AS (SELECT y, count(*) AS n, sum(v) AS a, sum(v * x) / sum(v) AS m, sum(v * x * x) / sum(v) AS q FROM i GROUP BY 1)
    SELECT y, n, round(m, 6) AS centre, round(2.3548200450309493 * sqrt(greatest(q - m * m, 0)), 5) AS fwhm, round(a, 4) AS total FROM s WHERE n >= 10""")
def spot_moments(t: Tables) -> DataFrame:
    """Centroids, widths and sums by intensity."""
    return images.moments(_image(t), ["y"], "x", "v", 10).select("y", "n", F.round("centre", 6).alias("centre"), F.round("fwhm", 5).alias("fwhm"), F.round("total", 4).alias("total"))


@queries.add(f"""
    WITH i AS ({_IMAGE}), m AS (SELECT y, max(v) AS m FROM i GROUP BY 1) SELECT y, x, round(v / m * t, 8) AS p FROM i JOIN m USING (y)""")
def fused_posterior(t: Tables) -> DataFrame:
    """Normalised shapes times scores."""
    i = _image(t)
    return images.posterior(i.select("y", "x", "v"), i.select("y", "x", "t"), "y", "x", "v", "t").select("y", "x", F.round("p", 8).alias("p"))


@queries.add("""
    WITH n AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) SELECT l_suppkey, round(sum(CASE WHEN k > 1 THEN l_quantity * l_discount ELSE l_quantity END), 4) AS volume FROM lineitem JOIN n USING (l_orderkey) GROUP BY 1""")
def owned_cells(t: Tables) -> DataFrame:
    """Contested cells weighted by ownership."""
    return images.owned(t.lineitem, "l_orderkey", "l_suppkey", "l_quantity", "l_discount").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 4).alias("volume"))


@queries.add("SELECT event_type, round(count(*) FILTER (WHERE value <= 30) / CAST(count(*) AS DOUBLE), 8) AS coverage FROM events GROUP BY 1")
def ring_coverage(t: Tables) -> DataFrame:
    """The unmasked share of each ring."""
    return images.coverage(t.events, "event_type", F.col("value") > 30).select("event_type", F.round("coverage", 8).alias("coverage"))


@queries.add("""
    WITH p AS (SELECT o_orderpriority AS frame, month(o_orderdate) AS q, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), r AS (SELECT q, v AS ref FROM p WHERE frame = '1-URGENT')
    SELECT frame, round(sqrt(avg(pow(v - ref, 2))) / avg(ref), 8) AS rms, sqrt(avg(pow(v - ref, 2))) / avg(ref) > 0.05 AS jumped, count(*) AS bins FROM p JOIN r USING (q) GROUP BY 1""")
def quality_flags(t: Tables) -> DataFrame:
    """Frames that differ from a reference profile."""
    p = t.orders.groupBy(F.col("o_orderpriority").alias("frame"), F.month("o_orderdate").alias("q")).agg(F.avg("o_totalprice").alias("v"))
    r = p.where("frame = '1-URGENT'").select("q", F.col("v").alias("ref"))
    rms = F.sqrt(F.avg((F.col("v") - F.col("ref")) * (F.col("v") - F.col("ref")))) / F.avg("ref")
    return p.join(r, "q").groupBy("frame").agg(F.round(rms, 8).alias("rms"), (rms > 0.05).alias("jumped"), F.count("*").alias("bins"))


@queries.add("""
    WITH p AS (SELECT a.p_size AS h, a.p_brand, avg(a.p_retailprice) AS i FROM part a GROUP BY 1, 2)
    SELECT p.p_brand, round(avg(abs(p.i - m.i) / (p.i + m.i)), 10) AS asymmetry, count(*) AS pairs FROM p JOIN p m ON m.p_brand = p.p_brand AND m.h = 51 - p.h AND p.h < m.h GROUP BY 1""")
def pair_asymmetry(t: Tables) -> DataFrame:
    """Intensity asymmetry of opposite members, within each grain."""
    p = t.part.groupBy("p_brand", F.col("p_size").alias("h")).agg(F.avg("p_retailprice").alias("i"))
    m = p.select("p_brand", (51 - F.col("h")).alias("h"), F.col("i").alias("j"))
    met = p.join(m, ["p_brand", "h"]).where("h < 51 - h")
    return met.groupBy("p_brand").agg(F.round(F.avg(F.abs(F.col("i") - F.col("j")) / (F.col("i") + F.col("j"))), 10).alias("asymmetry"), F.count("*").alias("pairs"))


@queries.add("""
    WITH s AS (SELECT l_orderkey AS o, l_suppkey % 10 AS a, l_partkey % 3 AS v FROM lineitem),
    p AS (SELECT x.a, y.a AS b, count(*) FILTER (WHERE x.v = y.v) AS agree, count(*) FILTER (WHERE x.v <> y.v) AS differ FROM s x JOIN s y ON x.o = y.o AND x.a < y.a GROUP BY 1, 2)
    SELECT a, b, least(agree, 32767) AS agree, least(differ, 32767) AS differ FROM p""")
def agreement_graph(t: Tables) -> DataFrame:
    """How often two grains agree and disagree on the variant of a shared spot."""
    s = t.lineitem.select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 10).alias("a"), (F.col("l_partkey") % 3).alias("v"))
    met = s.join(s.select("o", F.col("a").alias("b"), F.col("v").alias("w")), "o").where("a < b")
    return met.groupBy("a", "b").agg(F.least(F.count_if(F.col("v") == F.col("w")), F.lit(32767)).alias("agree"), F.least(F.count_if(F.col("v") != F.col("w")), F.lit(32767)).alias("differ"))


@queries.add("""
    WITH d AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part GROUP BY 1), k AS (SELECT * FROM d WHERE n >= 70), x AS (SELECT * FROM d WHERE n < 70),
    j AS (SELECT x.p_brand, k.p_brand AS near, abs(x.m - k.m) AS gap, x.s, row_number() OVER (PARTITION BY x.p_brand ORDER BY abs(x.m - k.m), k.p_brand) AS r FROM x JOIN k ON true)
    SELECT p_brand, near, round(gap, 6) AS gap, gap >= 0.01 * s AS kept FROM j WHERE r = 1""")
def forced_keeps(t: Tables) -> DataFrame:
    """Dropped grains that lie far enough from the nearest kept one to be kept after all."""
    d = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    kept = d.where("n >= 70").select(F.col("p_brand").alias("near"), F.col("m").alias("km"))
    met = d.where("n < 70").join(F.broadcast(kept), F.lit(True)).withColumn("gap", F.abs(F.col("m") - F.col("km")))
    best = windows.top_rows(met, ["p_brand"], ["gap", "near"], 1)
    return best.select("p_brand", "near", F.round("gap", 6).alias("gap"), (F.col("gap") >= 0.01 * F.col("s")).alias("kept"))


@queries.add("""
    WITH a AS (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT round(regr_slope(v, date_diff('month', TIMESTAMP '1992-01-01', m)), 6) AS slope, round(regr_intercept(v, date_diff('month', TIMESTAMP '1992-01-01', m)), 4) AS start, count(*) AS anchors FROM a""")
def drift_line(t: Tables) -> DataFrame:
    """A drift as a line through monthly anchors."""
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    a = t.orders.groupBy(month.alias("x")).agg(F.avg("o_totalprice").alias("v"))
    return a.agg(F.round(F.regr_slope("v", "x"), 6).alias("slope"), F.round(F.regr_intercept("v", "x"), 4).alias("start"), F.count("*").alias("anchors"))


@queries.add(f"""
    WITH i AS ({_IMAGE}), w AS (SELECT y, x, v, lag(v) OVER (PARTITION BY y ORDER BY x) AS a, lead(v) OVER (PARTITION BY y ORDER BY x) AS b, max(v) OVER (PARTITION BY y) AS top FROM i)
    SELECT y, count(*) AS maxima FROM w WHERE v >= 0.8 * top AND v >= coalesce(a, v) AND v > b GROUP BY 1""")
def row_maxima(t: Tables) -> DataFrame:
    """Candidates for distinct maxima: at least a share of the row's peak, not below the left and above the right neighbour."""
    w = Window.partitionBy("y").orderBy("x")
    i = _image(t).withColumns({"a": F.lag("v").over(w), "b": F.lead("v").over(w), "top": F.max("v").over(Window.partitionBy("y"))})
    return i.where((F.col("v") >= 0.8 * F.col("top")) & (F.col("v") >= F.coalesce("a", "v")) & (F.col("v") > F.col("b"))).groupBy("y").agg(F.count("*").alias("maxima"))
