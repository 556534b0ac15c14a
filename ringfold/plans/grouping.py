"""Queries that show grouped summaries of peaks, grains, voxels, cakes and sinograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions import rotations, tensors
from ringfold.operators import aggregates, images, joins, matching, summaries, windows
from ringfold.operators.graph import connected
from ringfold.plans.matching import _Q, _angle_sql, _components_sql, _gap_sql, _oriented, _turned_sql
from ringfold.plans.registry import Registry, Tables
from ringfold.plans.synthetic import GRAINS_SQL, SPOTS_SQL, grains, rounded, spots

queries = Registry()

_CODED = f"(SELECT *, spot % 4 = 1 AS touched, CASE WHEN spot % 3 = 0 THEN 0 ELSE spot % 5 END AS code FROM {SPOTS_SQL})"


@queries.add(f"""
    SELECT grain, sum(ii) AS ii, round(sum(omega * ii) / sum(ii), 6) AS omega, round(sum(y * ii) / sum(ii), 6) AS y, min(omega) AS least_omega, max(omega) AS most_omega, max(z) AS z, count(*) AS n, arg_max(eta, spot) AS eta,
        CAST(max(touched::INT) AS INTEGER) AS touched, coalesce(arg_min(code, spot) FILTER (WHERE code <> 0), 0) AS code FROM {_CODED} GROUP BY grain""")
def accumulated_chains(t: Tables) -> DataFrame:
    """Merged peaks of each chain: weighted means, extremes, the last azimuth, flags, and the first code that tells of a failure."""
    s = spots(t).withColumn("touched", (F.col("spot") % 4 == 1).cast("int")).withColumn("code", F.when(F.col("spot") % 3 == 0, 0).otherwise(F.col("spot") % 5)).withColumn("rotation", F.col("omega"))
    made = summaries.accumulated(s, "grain", "spot", "ii", ["rotation", "y"], ["z"], [], ["eta"], "touched", "code", "omega")
    return made.select("grain", F.round("ii", 6).alias("ii"), F.round("rotation", 6).alias("omega"), F.round("y", 6).alias("y"), "least_omega", "most_omega", "z", "n", "eta", "touched", "code")


_VOLUMES = f"WITH p AS (SELECT *, sum(ii) OVER (PARTITION BY ring) / 24 AS powder, 2.0 + ring AS theta, 0.5 + frame % 3 * 0.25 AS span FROM {SPOTS_SQL}), a AS (SELECT *, asin(least(greatest(sin(radians(theta)) * cos(radians(span)) + cos(radians(theta)) * abs(sin(radians(eta))) * sin(radians(span)), -1), 1)) - radians(theta) AS wide FROM p), v AS (SELECT *, 0.5 * wide * cos(radians(theta)) * 1000.0 * ii / (span / 0.25 * powder) AS v FROM a)"


@queries.add(_VOLUMES + " SELECT spot, round(v, 8) AS volume, round(sign(v) * pow(abs(v) * 3 / (4 * pi()), 1.0 / 3), 6) AS radius FROM v")
def spot_volumes(t: Tables) -> DataFrame:
    """Volume and radius of the grain behind each spot from its share of its ring's powder intensity."""
    s = spots(t).withColumn("powder", F.sum("ii").over(Window.partitionBy("ring")) / 24).withColumns({"theta": 2.0 + F.col("ring"), "span": 0.5 + F.col("frame") % 3 * 0.25})
    volume, radius = summaries.spot_volume(F.col("theta"), F.col("eta"), F.col("span"), F.col("span") / 0.25, F.col("ii"), F.col("powder"), 1000.0)
    return s.select("spot", F.round(volume, 8).alias("volume"), F.round(radius, 6).alias("radius"))


@queries.add(_VOLUMES + " SELECT grain, round(quantile_cont(v, 0.5), 8) AS median, round(avg(v), 8) AS mean, count(*) AS n FROM v GROUP BY grain")
def grain_volumes(t: Tables) -> DataFrame:
    """Volumes of grains as medians and means over their spots."""
    s = spots(t).withColumn("powder", F.sum("ii").over(Window.partitionBy("ring")) / 24).withColumns({"theta": 2.0 + F.col("ring"), "span": 0.5 + F.col("frame") % 3 * 0.25})
    volume, _ = summaries.spot_volume(F.col("theta"), F.col("eta"), F.col("span"), F.col("span") / 0.25, F.col("ii"), F.col("powder"), 1000.0)
    return s.select("grain", volume.alias("v")).groupBy("grain").agg(F.round(F.percentile("v", 0.5), 8).alias("median"), F.round(F.avg("v"), 8).alias("mean"), F.count("*").alias("n"))


@queries.add(f"SELECT ring, round(sum(ii) / 24, 4) AS powder, count(*) AS n FROM {SPOTS_SQL} GROUP BY ring")
def ring_powder(t: Tables) -> DataFrame:
    """Powder intensity of each ring for a frame."""
    return spots(t).groupBy("ring").agg(F.round(F.sum("ii") / 24, 4).alias("powder"), F.count("*").alias("n"))


_FRAMES = "SELECT l_orderkey % 5 AS frame, l_partkey % 200 AS pixel, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


@queries.add(f"""
    WITH f AS ({_FRAMES}), m AS (SELECT i AS pixel, (i + s) % 9 AS bin, (1.0 + i % 3) / 2 AS w FROM range(200) p(i), range(2) q(s)), c AS (SELECT frame, bin, sum(v * w) AS total, sum(w) AS weight FROM f JOIN m USING (pixel) GROUP BY 1, 2)
    SELECT frame, bin, round(total, 6) AS total, round(weight, 6) AS weight, round(total / weight, 6) AS mean FROM c""")
def fused_integration(t: Tables) -> DataFrame:
    """A stack of frames integrated with the average of two shifted maps: sums, weights and means of each bin."""
    f = t.lineitem.groupBy((F.col("l_orderkey") % 5).alias("frame"), (F.col("l_partkey") % 200).alias("pixel")).agg(F.sum("l_quantity").alias("v"))
    one = t.spark.range(200).select(F.col("id").alias("pixel"), (1.0 + F.col("id") % 3).alias("w"))
    both = summaries.fused([one.withColumn("bin", (F.col("pixel") + s) % 9) for s in (0, 1)], "w")
    c = f.join(both, "pixel").groupBy("frame", "bin").agg(F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("weight"))
    return c.select("frame", "bin", F.round("total", 6).alias("total"), F.round("weight", 6).alias("weight"), F.round(F.col("total") / F.col("weight"), 6).alias("mean"))


@queries.add("""
    WITH p AS (SELECT l_linenumber AS energy, CAST(floor(l_suppkey % 90 * (20.0 + l_linenumber) / 30) AS BIGINT) AS r, l_partkey % 12 AS eta, l_extendedprice AS v, l_quantity AS var FROM lineitem WHERE l_partkey % 10 <> 3),
    c AS (SELECT energy, r, eta, avg(v) AS v, sum(var) / (count(*) * count(*)) AS var FROM p GROUP BY 1, 2, 3)
    SELECT energy, r, round(avg(v), 4) AS mean, round(sqrt(sum(var)) / count(*), 6) AS sigma, count(*) AS bins FROM c GROUP BY 1, 2""")
def energy_sweep(t: Tables) -> DataFrame:
    """Profiles of each energy with its own geometry: means over the azimuth bins that hold something, and their deviations."""
    p = t.lineitem.where("l_partkey % 10 <> 3").select(F.col("l_linenumber").alias("energy"), F.floor(F.col("l_suppkey") % 90 * (20.0 + F.col("l_linenumber")) / 30).alias("r"), (F.col("l_partkey") % 12).alias("eta"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("var"))
    c = p.groupBy("energy", "r", "eta").agg(F.avg("v").alias("v"), (F.sum("var") / (F.count("*") * F.count("*"))).alias("var"))
    return c.groupBy("energy", "r").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.sqrt(F.sum("var")) / F.count("*"), 6).alias("sigma"), F.count("*").alias("bins"))


@queries.add(f"SELECT CAST(floor(eta / 5) AS BIGINT) AS beta, round(avg(ii), 4) AS intensity FROM (SELECT *, sqrt(y * y + z * z) AS r FROM {SPOTS_SQL}) WHERE abs(r - 600) <= 80 GROUP BY 1")
def pole_stripe(t: Tables) -> DataFrame:
    """A ring's stripe of the cake as a line of a pole figure."""
    r = spots(t).withColumn("r", F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    return r.where(F.abs(F.col("r") - 600) <= 80).groupBy(F.floor(F.col("eta") / 5).alias("beta")).agg(F.round(F.avg("ii"), 4).alias("intensity"))


@queries.add(f"SELECT pixel, round(avg(v), 6) AS dark, round(sum(v), 6) AS total FROM ({_FRAMES}) WHERE frame < 3 GROUP BY pixel")
def dark_frames(t: Tables) -> DataFrame:
    """The mean and the sum of the dark frames, pixel by pixel."""
    f = t.lineitem.groupBy((F.col("l_orderkey") % 5).alias("frame"), (F.col("l_partkey") % 200).alias("pixel")).agg(F.sum("l_quantity").alias("v"))
    return f.where("frame < 3").groupBy("pixel").agg(F.round(F.avg("v"), 6).alias("dark"), F.round(F.sum("v"), 6).alias("total"))


@queries.add(f"""
    WITH q AS (SELECT * FROM {_Q}), f AS (SELECT layer, arg_min([q0, q1, q2, q3], [q0, q1, q2, q3]) AS f FROM q GROUP BY 1), s AS (SELECT q.*, CASE WHEN q0 * f[1] + q1 * f[2] + q2 * f[3] + q3 * f[4] < 0 THEN -1 ELSE 1 END AS s FROM q JOIN f USING (layer)),
    m AS (SELECT layer, count(*) AS n, avg(x) AS x, avg(confidence) AS confidence, sum(q0 * s) AS a, sum(q1 * s) AS b, sum(q2 * s) AS c, sum(q3 * s) AS d FROM s GROUP BY 1)
    SELECT layer, n, round(x, 6) AS x, round(confidence, 6) AS confidence, round(a / sqrt(a*a+b*b+c*c+d*d), 6) AS w, round(d / sqrt(a*a+b*b+c*c+d*d), 6) AS k FROM m""")
def grain_means(t: Tables) -> DataFrame:
    """Mean place, confidence and orientation of each grain's voxels, and how many there are."""
    g = _oriented(t)
    means = g.groupBy("layer").agg(F.avg("x").alias("x"), F.avg("confidence").alias("confidence"))
    turned = summaries.mean_orientation(g, "layer", "q")
    return turned.join(means, "layer").select("layer", "n", F.round("x", 6).alias("x"), F.round("confidence", 6).alias("confidence"), F.round(F.col("q")[0], 6).alias("w"), F.round(F.col("q")[3], 6).alias("k"))


@queries.add(f"""
    WITH RECURSIVE q AS (SELECT * FROM {_Q}), p AS (SELECT a.grain AS a, b.grain AS b, {_turned_sql('a', 'b')} AS r FROM q a JOIN q b ON a.grain < b.grain), {_components_sql(f"SELECT a, b FROM p WHERE {_angle_sql('r')} < 5")},
    n AS (SELECT q.*, coalesce(component, grain) AS c FROM q LEFT JOIN parts_ ON parts_.n = grain), s AS (SELECT *, count(*) OVER (PARTITION BY c) AS size, row_number() OVER (PARTITION BY c ORDER BY radius, grain) AS k FROM n)
    SELECT c AS cluster, grain AS representative, size FROM s WHERE k = 1 AND size >= 2""")
def seed_clusters(t: Tables) -> DataFrame:
    """Clusters of seeds of one orientation, small ones dropped, each with the seed of the least angle."""
    g = _oriented(t)
    found = matching.orientation_components(g, "grain", "q", "m-3m", 5.0)
    named = g.join(found.withColumnRenamed("node", "grain").hint("merge"), "grain", "left").withColumn("cluster", F.coalesce("component", "grain"))
    best = named.groupBy("cluster").agg(F.count("*").alias("size"), F.min(F.struct("radius", "grain")).alias("m")).where("size >= 2")
    return best.select("cluster", F.col("m.grain").alias("representative"), "size")


@queries.add(f"""
    WITH RECURSIVE q AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, grain) AS i FROM {_Q}), p AS (SELECT a.i AS a, b.i AS b, {_turned_sql('a', 'b')} AS r FROM q a JOIN q b ON a.i < b.i),
    l AS (SELECT b, list(a ORDER BY a) AS low FROM p WHERE {_angle_sql('r')} < 8 GROUP BY b), n AS (SELECT i, grain, coalesce(low, []) AS low FROM q LEFT JOIN l ON b = i),
    w(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.i, CASE WHEN list_has_any(w.kept, n.low) THEN w.kept ELSE list_append(w.kept, n.i) END FROM w JOIN n ON n.i = w.i + 1),
    k AS (SELECT kept FROM w ORDER BY i DESC LIMIT 1), o AS (SELECT n.i, n.grain, coalesce(list_min(list_intersect(n.low, kept)), n.i) AS lead FROM n, k)
    SELECT o.grain, q.grain AS leader FROM o JOIN q ON q.i = o.lead""")
def voxel_grains(t: Tables) -> DataFrame:
    """Grains of a voxel map: the most confident voxel leads, and takes all less confident ones of its orientation that no better one has taken."""
    g = windows.renumber(_oriented(t), "i", [F.desc("confidence"), "grain"])
    flat = [f"q{k}" for k in range(4)]
    leads = matching.first_leads(
        g.select("i", *[F.col("q")[k].alias(n) for k, n in enumerate(flat)]), "i", flat, lambda a, b: matching.misoriented(a, b, "m-3m") < 8,
        lambda rest: matching.orientation_pairs(rest.withColumn("q", F.array(*flat)), "i", "q", "m-3m", 8.0))
    named = g.select("grain", "i").join(leads, "i")
    return named.join(g.select(F.col("grain").alias("leader"), F.col("i").alias("lead")), "lead").select("grain", "leader")


@queries.add(f"""
    WITH k AS (SELECT *, row_number() OVER (ORDER BY confidence, grain) AS i FROM {GRAINS_SQL} WHERE radius * 2 >= 30), s AS (SELECT *, sum(radius) OVER () - coalesce(sum(radius) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining, sum(radius) OVER () * 0.6 AS budget FROM k)
    SELECT grain FROM s WHERE remaining > budget UNION ALL SELECT grain FROM {GRAINS_SQL} WHERE radius * 2 < 30""")
def budget_drops(t: Tables) -> DataFrame:
    """Grains dropped because too little of them is recovered, then the worst ones while the rest exceeds the sample."""
    g = grains(t)
    fine = g.where("radius * 2 >= 30").withColumn("whole", F.lit(1))
    total = fine.groupBy("whole").agg((F.sum("radius") * 0.6).alias("budget"))
    marked = aggregates.worst_first_budget(fine.join(F.broadcast(total), "whole"), ["whole"], "radius", "confidence", "grain", F.col("budget"))
    return marked.where("dropped").select("grain").unionByName(g.where("radius * 2 < 30").select("grain"))


@queries.add("""
    WITH d AS (SELECT o_custkey % 20 AS g, i, substr(md5(concat(o_orderkey, '-', i)), 1, 1) < '8' AS half, o_totalprice AS y, CAST(o_orderkey % 100 AS DOUBLE) AS x FROM orders, range(4) r(i)), f AS (SELECT g, i, half, regr_slope(y, x) AS slope FROM d GROUP BY 1, 2, 3)
    SELECT g, round(avg(abs(a.slope - b.slope)), 4) AS difference, count(*) AS splits FROM f a JOIN f b USING (g, i) WHERE a.half AND NOT b.half GROUP BY g""")
def half_differences(t: Tables) -> DataFrame:
    """How much a fitted slope differs between random halves of the data, over four seeded splits."""
    d = t.orders.select((F.col("o_custkey") % 20).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), "o_orderkey", F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 100).cast("double").alias("x"))
    half = F.substring(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.col("i").cast("string"))), 1, 1) < "8"
    f = d.groupBy("g", "i").agg(F.regr_slope(F.when(half, F.col("y")), F.when(half, F.col("x"))).alias("a"), F.regr_slope(F.when(~half, F.col("y")), F.when(~half, F.col("x"))).alias("b"))
    return f.where("a IS NOT NULL AND b IS NOT NULL").groupBy("g").agg(F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 4).alias("difference"), F.count("*").alias("splits"))


@queries.add("""
    WITH s AS (SELECT p_brand, count(*) AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM (SELECT p_brand, CAST(p_size AS DOUBLE) / 10 AS x, p_retailprice / 1000 AS y, 1.0 + p_partkey % 4 AS w FROM part) GROUP BY 1),
    f AS (SELECT p_brand, n, (wxy / w - wx / w * wy / w) / (wxx / w - wx / w * wx / w) AS slope, wx / w AS mx, wy / w AS my FROM s WHERE n >= 4)
    SELECT p_brand, n, round(slope, 6) AS strain, round(my - slope * mx, 6) AS size_term, round(2 * pi() / greatest(my - slope * mx, 1e-12), 4) AS domain, round(2 * slope * slope / pow(2.55, 2), 8) AS density FROM f""")
def broadening_fits(t: Tables) -> DataFrame:
    """Size and strain from the widths of reflections: a weighted line of width on scattering vector for each group of four or more."""
    p = t.part.select("p_brand", (F.col("p_size").cast("double") / 10).alias("x"), (F.col("p_retailprice") / 1000).alias("y"), (1.0 + F.col("p_partkey") % 4).alias("w"))
    f = summaries.weighted_line(p, ["p_brand"], "x", "y", "w").where("n >= 4")
    return f.select("p_brand", "n", F.round("slope", 6).alias("strain"), F.round("intercept", 6).alias("size_term"), F.round(2 * F.pi() / F.greatest("intercept", F.lit(1e-12)), 4).alias("domain"), F.round(2 * F.col("slope") * F.col("slope") / F.pow(F.lit(2.55), 2), 8).alias("density"))


@queries.add("""
    WITH s AS (SELECT vec_id, label, 1.0 + vec_id % 5 AS v, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 7)] AS s FROM embeddings), m AS (SELECT label, sum(s[1] * v) / sum(v) AS a, sum(s[2] * v) / sum(v) AS b, sum(s[3] * v) / sum(v) AS c, sum(s[4] * v) / sum(v) AS d FROM s GROUP BY 1)
    SELECT vec_id, round(s[4] - d, 6) AS s23, round((s[1] - a + s[2] - b + s[3] - c + 0.3) / 3, 6) AS hydrostatic, round(s[1] - a + 0.3 - (s[1] - a + s[2] - b + s[3] - c + 0.3) / 3, 6) AS d11 FROM s JOIN m USING (label)""")
def balanced_stresses(t: Tables) -> DataFrame:
    """Stresses of grains shifted so that their mean by volume is the applied one, and their parts."""
    s = t.embeddings.select("vec_id", "label", (1.0 + F.col("vec_id") % 5).alias("v"), F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("s"))
    b = summaries.balanced_stress(s, ["label"], "s", "v", (0.3, 0.0, 0.0, 0.0, 0.0, 0.0))
    return b.select("vec_id", F.round(F.col("balanced")[3], 6).alias("s23"), F.round("hydrostatic", 6).alias("hydrostatic"), F.round(F.col("deviatoric")[0], 6).alias("d11"))


@queries.add(f"""
    WITH c AS (SELECT DISTINCT CAST(a.i * 60 + 20 AS DOUBLE) AS x, CAST(b.i * 60 + 20 AS DOUBLE) AS y, a.i * 6 + b.i AS k FROM range(6) a(i), range(6) b(i)), m AS (SELECT k, sqrt((g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y)) AS d, g.radius AS w FROM c JOIN {GRAINS_SQL} g ON sqrt((g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y)) < 28),
    s AS (SELECT k, count(*) AS n, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * d * d * d) AS s3 FROM m GROUP BY 1 HAVING count(*) >= 3)
    SELECT k, n, round(s1 / s0, 6) AS centre, round(2.3548200450309493 * sqrt(greatest(s2 / s0 - s1 / s0 * s1 / s0, 0)), 5) AS fwhm, round(s0, 6) AS total FROM s""")
def reflection_voxels(t: Tables) -> DataFrame:
    """Voxels within a radius of each predicted place: their centre, width and total; places with too few are left out."""
    axis = lambda c: t.spark.range(6).select(F.col("id").alias(c))
    c = axis("i").crossJoin(axis("j")).select((F.col("i") * 6 + F.col("j")).alias("k"), (F.col("i") * 60.0 + 20).alias("x"), (F.col("j") * 60.0 + 20).alias("y"))
    near = matching.spatial_neighbours(c, grains(t).select("grain", "x", "y"), "k", "grain", ["x", "y"], 28.0, 1 << 30)
    met = near.join(grains(t).select("grain", "radius"), "grain")
    return images.moments(met, ["k"], "distance", "radius", 3).select("k", "n", F.round("centre", 6).alias("centre"), F.round("fwhm", 5).alias("fwhm"), F.round("total", 6).alias("total"))


def _systems_sql() -> str:
    rows = []
    for k, (n, b) in enumerate(tensors.slip_systems("fcc")):
        rows.append(f"SELECT vec_id, {k} AS system, round(abs(({'+'.join(f'{n[i]}*v[{i + 1}]' for i in range(3))}) * ({'+'.join(f'{b[i]}*v[{i + 1}]' for i in range(3))})) / ((v[1]*v[1]+v[2]*v[2]+v[3]*v[3]) * sqrt(6.0)), 8) AS schmid FROM v")
    return "WITH v AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 4)] AS v FROM embeddings), s AS (" + " UNION ALL ".join(rows) + "), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY schmid DESC, system) AS place FROM s) SELECT vec_id, CAST(system AS INTEGER) AS system, schmid, place FROM r WHERE place <= 3"


@queries.add(_systems_sql())
def slip_ranking(t: Tables) -> DataFrame:
    """Schmid factors of every slip system, and the three highest of each grain."""
    v = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    each = v.select("vec_id", F.posexplode(tensors.schmid_factors(F.col("v"))).alias("system", "s")).withColumn("schmid", F.round("s", 8))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("schmid"), "system"))).where("place <= 3").select("vec_id", "system", "schmid", "place")


@queries.add(f"""
    WITH g AS (SELECT quantile_cont(ii, 0.5) AS g FROM {SPOTS_SQL}) SELECT ring, CAST(floor((eta + 180) / 45) AS BIGINT) AS bucket, scan AS panel, count(*) AS n, round(quantile_cont(ii, 0.5), 4) AS median, quantile_cont(ii, 0.5) > 1.15 * any_value(g) AS flagged FROM {SPOTS_SQL}, g GROUP BY 1, 2, 3""")
def residual_cells(t: Tables) -> DataFrame:
    """Median residual of each cell of ring, azimuth and panel, flagged where it stands out from all."""
    s = spots(t).select("ring", F.floor((F.col("eta") + 180) / 45).alias("bucket"), F.col("scan").alias("panel"), "ii")
    return summaries.cell_report(s, ["ring", "bucket", "panel"], "ii", 1.15).withColumn("median", F.round("median", 4))


@queries.add(f"""
    WITH c AS (SELECT sqrt(y * y + z * z) AS r, CAST(floor(eta / 10) AS BIGINT) AS e, ii / 1000 AS v FROM {SPOTS_SQL}), s AS (SELECT k AS ring, e, sum(v) AS i FROM c JOIN (VALUES (1, 300.0), (2, 500.0), (3, 700.0), (4, 5000.0)) AS g(k, o) ON abs(r - o) <= 60 GROUP BY 1, 2), m AS (SELECT *, avg(i) OVER (PARTITION BY ring) AS m FROM s)
    SELECT ring, count(*) AS n, round(sum(pow(i - m, 2) / greatest(i, 1)) / nullif(count(*) - 1, 0), 6) AS chi FROM m GROUP BY ring""")
def ring_chi(t: Tables) -> DataFrame:
    """Chi squared of each ring's azimuthal intensity within a capture radius."""
    c = spots(t).select(F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("r"), F.floor(F.col("eta") / 10).alias("e"), (F.col("ii") / 1000).alias("v"))
    rings = t.spark.createDataFrame([(1, 300.0), (2, 500.0), (3, 700.0), (4, 5000.0)], "ring int, centre double")
    return summaries.ring_chi_squared(c, rings, "r", "e", "v", 60.0).withColumn("chi", F.round("chi", 6))


@queries.add(f"WITH g AS (SELECT * FROM {GRAINS_SQL}), d AS (SELECT {_gap_sql('a', 'b')} AS d FROM g a JOIN g b ON a.grain < b.grain) SELECT CAST(floor(d / 5) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (4.0 / 3 * pi() * (pow(5 * (floor(d / 5) + 1), 3) - pow(5 * floor(d / 5), 3))), 8) AS density FROM d WHERE d < 60 GROUP BY floor(d / 5)")
def pair_distances(t: Tables) -> DataFrame:
    """Pairs of grains by distance, over the volume of each shell."""
    h = summaries.pair_histogram(grains(t), "grain", ["x", "y", "z"], 60.0, 5.0)
    shell = 4.0 / 3 * F.pi() * (F.pow(5.0 * (F.col("bin") + 1), F.lit(3)) - F.pow(5.0 * F.col("bin"), F.lit(3)))
    return h.select("bin", "n", F.round(F.col("n") / shell, 8).alias("density"))


_CELLS = "SELECT l_linenumber AS translation, l_suppkey % 10 AS frame, sum(l_quantity) AS v, sum(l_tax) AS var FROM lineitem GROUP BY 1, 2"


@queries.add(f"SELECT CAST(translation AS INTEGER) AS translation, CASE WHEN translation % 2 = 1 THEN 9 - frame ELSE frame END AS frame, round(v, 6) AS v, round(var, 6) AS var FROM ({_CELLS})")
def sinogram_rows(t: Tables) -> DataFrame:
    """Scans to and fro as one sinogram: odd translations turned, values and variances together."""
    c = t.lineitem.groupBy(F.col("l_linenumber").alias("translation"), (F.col("l_suppkey") % 10).alias("frame")).agg(F.sum("l_quantity").alias("v"), F.sum("l_tax").alias("var"))
    return rounded(summaries.sinograms(c, "translation", "frame", ["v", "var"], 9))


@queries.add(f"""
    WITH c AS ({_CELLS}), u AS (SELECT translation, CASE WHEN translation % 2 = 1 THEN 9 - frame ELSE frame END AS frame, v FROM c),
    a AS (SELECT avg(r) AS r FROM (SELECT corr(x.v, y.v) AS r FROM c x JOIN c y ON y.translation = x.translation + 1 AND x.frame = y.frame GROUP BY x.translation)), b AS (SELECT avg(r) AS r FROM (SELECT corr(x.v, y.v) AS r FROM u x JOIN u y ON y.translation = x.translation + 1 AND x.frame = y.frame GROUP BY x.translation))
    SELECT round(a.r, 6) AS as_is, round(b.r, 6) AS turned, b.r > 1.05 * a.r AS snake FROM a, b""")
def snake_decision(t: Tables) -> DataFrame:
    """Whether a scan ran to and fro, by how much better neighbouring rows agree when odd ones are turned."""
    c = t.lineitem.groupBy(F.col("l_linenumber").alias("translation"), (F.col("l_suppkey") % 10).alias("frame")).agg(F.sum("l_quantity").alias("v"))
    return rounded(summaries.is_snake(c, "translation", "frame", "v", 9))


_SINO = "SELECT l_suppkey % 10 AS grain, CAST(l_partkey % 18 * 10 AS DOUBLE) AS omega, CAST(l_orderkey % 21 - 10 AS DOUBLE) AS s, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"


@queries.add(f"""
    WITH i AS ({_SINO}), r AS (SELECT grain, omega, sum(v) AS w, sum(v * s) / sum(v) AS c, greatest(sum(v * s * s) / sum(v) - pow(sum(v * s) / sum(v), 2), 0) AS var FROM i WHERE v > 0 GROUP BY 1, 2),
    p AS (SELECT grain, sum(pow(sin(radians(omega)), 2)) AS ss, sum(pow(cos(radians(omega)), 2)) AS kk, sum(sin(radians(omega)) * cos(radians(omega))) AS sk, sum(sin(radians(omega)) * c) AS sc, sum(cos(radians(omega)) * c) AS kc, quantile_cont(sqrt(12 * var), 0.5) AS spread FROM r GROUP BY 1),
    f AS (SELECT grain, (sc * kk - kc * sk) / (ss * kk - sk * sk) AS a, (kc * ss - sc * sk) / (ss * kk - sk * sk) AS b, greatest(spread, 4) / 2 AS band FROM p)
    SELECT grain, round(a, 5) AS a, round(b, 5) AS b, round(band, 5) AS band, round(sum(v) FILTER (WHERE abs(s - a * sin(radians(omega)) - b * cos(radians(omega))) <= band) / sum(v), 6) AS share FROM i JOIN f USING (grain) GROUP BY 1, a, b, band""")
def sinogram_concentration(t: Tables) -> DataFrame:
    """How much of each grain's sinogram lies in a band about its centroid's curve."""
    i = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("grain"), (F.col("l_partkey") % 18 * 10).cast("double").alias("omega"), (F.col("l_orderkey") % 21 - 10).cast("double").alias("s")).agg(F.sum("l_quantity").alias("v"))
    c = summaries.concentration(i, "grain", "omega", "s", "v", 4.0)
    return c.select("grain", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), F.round("band", 5).alias("band"), F.round("share", 6).alias("share"))


@queries.add(f"""
    WITH c AS (SELECT DISTINCT l_suppkey % 10 AS grain, CAST(l_partkey % 18 * 10 AS DOUBLE) AS omega, CAST(l_orderkey % 41 * 10 - 200 AS DOUBLE) AS s FROM lineitem), v AS (SELECT layer % 10 AS grain, x - 150 AS x, y - 150 AS y FROM {GRAINS_SQL} WHERE grain % 7 = 0)
    SELECT grain, omega, s FROM c WHERE EXISTS (SELECT 1 FROM v WHERE v.grain = c.grain AND (abs(s - (x * sin(radians(omega)) + y * cos(radians(omega)))) <= 6 OR abs(s + (x * sin(radians(omega)) + y * cos(radians(omega)))) <= 6))""")
def projected_cells(t: Tables) -> DataFrame:
    """Cells of grains' sinograms that some voxel of the grain projects on, or on their mirror image."""
    c = t.lineitem.select((F.col("l_suppkey") % 10).alias("grain"), (F.col("l_partkey") % 18 * 10).cast("double").alias("omega"), (F.col("l_orderkey") % 41 * 10 - 200).cast("double").alias("s")).distinct()
    v = grains(t).where("grain % 7 = 0").select((F.col("layer") % 10).cast("long").alias("grain"), (F.col("x") - 150).alias("x"), (F.col("y") - 150).alias("y"))
    return summaries.projected_mask(c, v, "grain", "omega", "s", "x", "y", 6.0)


@queries.add(f"""
    WITH p AS (SELECT spot, ring, scan AS panel, ii FROM {SPOTS_SQL}), m AS (SELECT ring, panel, quantile_cont(ii, 0.5) AS m, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT ring, panel, any_value(m) AS m, any_value(n) AS n, 1.4826 * quantile_cont(abs(ii - m), 0.5) AS s FROM p JOIN m USING (ring, panel) GROUP BY 1, 2)
    SELECT spot, n >= 16 AND s > 0 AND ii > m + 1.2 * s AS outlier, round(CASE WHEN n >= 16 AND s > 0 AND ii > m + 1.2 * s THEN m ELSE ii END, 4) AS clean FROM p JOIN s USING (ring, panel)""")
def clipped_rings(t: Tables) -> DataFrame:
    """Pixels that stand out from their ring on their panel, with the ring's median in their place."""
    p = spots(t).select("spot", "ring", F.col("scan").alias("panel"), "ii")
    return summaries.clipped_rings(p, ["ring", "panel"], "ii", 1.2).select("spot", "outlier", F.round("clean", 4).alias("clean"))


_DENSE = "SELECT a.i AS y, b.i AS x, CAST((a.i * 37 + b.i * 91 + a.i * b.i) % 53 + CASE WHEN (a.i * 30 + b.i) % 97 = 5 THEN 900 ELSE 0 END AS DOUBLE) AS v FROM range(30) a(i), range(30) b(i)"


def _dense(t: Tables) -> DataFrame:
    p = t.spark.range(900).select(F.floor(F.col("id") / 30).alias("y"), (F.col("id") % 30).alias("x"))
    v = (F.col("y") * 37 + F.col("x") * 91 + F.col("y") * F.col("x")) % 53 + F.when((F.col("y") * 30 + F.col("x")) % 97 == 5, 900).otherwise(0)
    return p.withColumn("v", v.cast("double"))


@queries.add(f"""
    WITH i AS ({_DENSE}), steps(di, dj, w) AS (VALUES (-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)),
    asked AS (SELECT i.y, i.x, i.v, w, least(greatest(i.y + di, 0), 29) AS ny, least(greatest(i.x + dj, 0), 29) AS nx FROM i CROSS JOIN steps), lap AS (SELECT asked.y, asked.x, any_value(asked.v) AS v, sum(w * b.v) AS lv FROM asked JOIN i b ON b.y = ny AND b.x = nx GROUP BY 1, 2),
    med AS (SELECT quantile_cont(lv, 0.5) AS mv FROM lap), spread AS (SELECT max(mv) AS mv, CASE WHEN quantile_cont(abs(lv - mv), 0.5) > 0 THEN 1.4826 * quantile_cont(abs(lv - mv), 0.5) WHEN stddev_pop(lv) > 0 THEN stddev_pop(lv) ELSE 1 END AS sv FROM lap CROSS JOIN med),
    near AS (SELECT i.y, i.x, (i.y + p.di + 30) % 30 AS ny, (i.x + q.dj + 30) % 30 AS nx FROM i CROSS JOIN range(-1, 2) p(di) CROSS JOIN range(-1, 2) q(dj)), mean AS (SELECT near.y, near.x, sum(b.v) / 9 AS av FROM near JOIN i b ON b.y = ny AND b.x = nx GROUP BY 1, 2)
    SELECT y, x, abs(lv - mv) > 5 * sv AS outlier, round(CASE WHEN abs(lv - mv) > 5 * sv THEN av ELSE v END, 6) AS clean FROM lap JOIN mean USING (y, x) CROSS JOIN spread""")
def despiked_image(t: Tables) -> DataFrame:
    """Pixels that a Laplacian marks as spikes, with the mean of their neighbourhood in their place."""
    return summaries.despiked(_dense(t), 30, 30).select("y", "x", "outlier", F.round("clean", 6).alias("clean"))


@queries.add(f"""
    WITH i AS ({_DENSE}), p AS (SELECT a.x AS r, a.y AS e, quantile_cont(b.v, 0.5) AS m FROM i a, range(-2, 3) k(k) JOIN i b ON b.x = a.x AND b.y = (a.y + k + 30) % 30 GROUP BY 1, 2),
    f AS (SELECT a.x AS r, a.y AS e, quantile_cont(b.v, 0.5) AS m FROM i a, range(-2, 3) k(k) JOIN i b ON b.x = a.x AND b.y = CASE WHEN a.y + k < 0 THEN -(a.y + k) - 1 WHEN a.y + k >= 30 THEN 59 - (a.y + k) ELSE a.y + k END GROUP BY 1, 2)
    SELECT r, e, p.m AS periodic, f.m AS mirrored FROM p JOIN f USING (r, e)""")
def azimuth_medians(t: Tables) -> DataFrame:
    """Medians along the azimuth, over the turn's end and mirrored at it."""
    c = _dense(t).select(F.col("x").alias("r"), F.col("y").alias("e"), "v")
    return summaries.smoothed_azimuth(c, ["r"], "e", "v", 30, 2).withColumnRenamed("median", "periodic").join(summaries.smoothed_azimuth(c, ["r"], "e", "v", 30, 2, False).withColumnRenamed("median", "mirrored"), ["r", "e"])


@queries.add("""
    WITH d AS (SELECT a.s_suppkey AS a, b.c_custkey AS b, abs(s_acctbal - c_acctbal) AS angle, abs(s_nationkey - c_nationkey) AS gap FROM supplier a JOIN customer b ON abs(s_acctbal - c_acctbal) < 400),
    r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY gap, angle, a) AS n FROM d) SELECT b, a, round(angle, 4) AS angle FROM r WHERE n = 1""")
def map_comparison(t: Tables) -> DataFrame:
    """Two maps compared: for each voxel of one the nearest of the other, and by how much they differ."""
    met = joins.tolerance_join(t.customer.select("c_custkey", F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("n")), t.supplier.select("s_suppkey", F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("n")), [], {"v": 400.0})
    best = met.groupBy(F.col("c_custkey").alias("b")).agg(F.min(F.struct(F.abs(F.col("n") - F.col("r_n")).alias("gap"), F.abs(F.col("v") - F.col("r_v")).alias("angle"), F.col("r_s_suppkey").alias("a"))).alias("m"))
    return best.select("b", "m.a", F.round("m.angle", 4).alias("angle"))


@queries.add(f"SELECT spot, row_number() OVER (ORDER BY ring, eta, spot) AS place FROM {SPOTS_SQL}")
def ring_ordered(t: Tables) -> DataFrame:
    """The table of spots numbered by ring and azimuth."""
    return windows.renumber(spots(t).select("spot", "ring", "eta"), "place", ["ring", "eta", "spot"]).select("spot", "place")


@queries.add("WITH s AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS rank FROM s), c AS (SELECT count(*) AS n FROM s) SELECT CAST(d AS VARCHAR) AS day, rank, rank // 7 AS grp FROM r, c WHERE rank // 7 < n // 7")
def scan_groups(t: Tables) -> DataFrame:
    """Scans by position in groups of seven, the last, partial group dropped."""
    s = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    n = s.count()
    ranked = windows.renumber(s, "rank", ["day"], start=0).withColumn("rank", F.col("rank").cast("long"))
    return ranked.withColumn("grp", F.floor(F.col("rank") / 7)).where(F.col("grp") < n // 7).withColumn("day", F.col("day").cast("string"))


@queries.add("WITH r AS (SELECT h * h + k * k + l * l AS n, count(*) AS multiplicity FROM (SELECT a.i AS h, b.i AS k, c.i AS l FROM range(-5, 6) a(i), range(-5, 6) b(i), range(-5, 6) c(i)) WHERE h <> 0 OR k <> 0 OR l <> 0 GROUP BY 1) SELECT n, multiplicity, round(1000000 * tan(2 * asin(0.2 * sqrt(n) / (2 * 4.05))), 4) AS radius FROM r WHERE 1000000 * tan(2 * asin(0.2 * sqrt(n) / (2 * 4.05))) < 200000 ORDER BY n LIMIT 6")
def detector_rings(t: Tables) -> DataFrame:
    """The first six rings that fall on the detector, with their multiplicities."""
    axis = F.explode(F.sequence(F.lit(-5), F.lit(5)))
    hkl = t.spark.range(1).select(axis.alias("h")).select("h", axis.alias("k")).select("h", "k", axis.alias("l")).where("h <> 0 OR k <> 0 OR l <> 0")
    n = (F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")).cast("long")
    rings = hkl.groupBy(n.alias("n")).agg(F.count("*").alias("multiplicity"))
    radius = 1000000 * F.tan(2 * F.asin(0.2 * F.sqrt("n") / (2 * 4.05)))
    return rings.withColumn("radius", F.round(radius, 4)).where(radius < 200000).orderBy("n").limit(6)


@queries.add("""
    WITH r AS (SELECT DISTINCT p_size AS k, p_size % 7 AS cone, p_size % 11 AS strength FROM part WHERE p_size <= 14)
    SELECT a.k AS a, b.k AS b, c.k AS c, CAST(a.cone + b.cone + c.cone AS BIGINT) AS cone, CAST(least(a.strength, b.strength, c.strength) AS BIGINT) AS weakest FROM r a JOIN r b ON a.k < b.k JOIN r c ON b.k < c.k ORDER BY cone DESC, weakest DESC, a, b, c LIMIT 10""")
def reflection_sets(t: Tables) -> DataFrame:
    """The ten best sets of three reflections of a short list by a composite key."""
    r = t.part.where("p_size <= 14").select(F.col("p_size").alias("k"), (F.col("p_size") % 7).alias("cone"), (F.col("p_size") % 11).alias("strength")).distinct()
    if r.count() > 100:
        raise ValueError("sets are ranked of a short list only")
    one, two, three = (r.select(*[F.col(c).alias(f"{c}{x}") for c in r.columns]) for x in "abc")
    sets = one.join(F.broadcast(two), F.col("ka") < F.col("kb")).join(F.broadcast(three), F.col("kb") < F.col("kc"))
    out = sets.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.col("kc").alias("c"), (F.col("conea") + F.col("coneb") + F.col("conec")).cast("long").alias("cone"), F.least("strengtha", "strengthb", "strengthc").cast("long").alias("weakest"))
    return out.orderBy(F.desc("cone"), F.desc("weakest"), "a", "b", "c").limit(10)


@queries.add(f"""
    WITH RECURSIVE p AS (SELECT spot, y, z, row_number() OVER (ORDER BY spot) AS i FROM {SPOTS_SQL} WHERE scan < 2), e AS (SELECT a.spot AS a, b.spot AS b FROM p a JOIN p b ON a.spot < b.spot AND sqrt((a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 25),
    l AS (SELECT b, list(a) AS low FROM e GROUP BY b), n AS (SELECT i, spot, coalesce(low, []) AS low FROM p LEFT JOIN l ON b = spot),
    w(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.i, CASE WHEN list_has_any(w.kept, n.low) THEN w.kept ELSE list_append(w.kept, n.spot) END FROM w JOIN n ON n.i = w.i + 1)
    SELECT unnest(kept) AS spot FROM (SELECT kept FROM w ORDER BY i DESC LIMIT 1)""")
def merged_files(t: Tables) -> DataFrame:
    """Peaks of two files as one table; a later peak near an earlier kept one is the same."""
    every = spots(t).where("scan = 0").unionByName(spots(t).where("scan = 1")).select("spot", "y", "z")
    leads = matching.first_leads(every, "spot", ["y", "z"], lambda a, b: matching.gaps(a, b) < 25, lambda rest: joins.pairs_within(rest, "spot", ["y", "z"], 25.0))
    return leads.where("lead = spot").select("spot")
