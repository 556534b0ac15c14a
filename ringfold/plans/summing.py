"""Queries that show the aggregate operators on the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions.columns import micros
from ringfold.operators import aggregates as agg
from ringfold.operators import joins
from ringfold.plans.registry import Registry, Tables

queries = Registry()


@queries.add("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean,
        round(sum(l_quantity * l_quantity * l_tax) / (sum(l_quantity) * sum(l_quantity)), 10) AS variance, round(avg(l_extendedprice), 4) AS plain FROM lineitem GROUP BY 1, 2""")
def weighted_means(t: Tables) -> DataFrame:
    """Weighted mean with its variance, beside the plain mean."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(agg.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("mean"), F.round(agg.weighted_variance("l_tax", "l_quantity"), 10).alias("variance"), F.round(F.avg("l_extendedprice"), 4).alias("plain"))


@queries.add("""
    WITH map AS (SELECT p_partkey AS l_partkey, p_size % 10 AS bin, p_size / 50.0 AS frac FROM part)
    SELECT l_linenumber AS frame, CAST(bin AS INTEGER) AS bin, round(sum(l_extendedprice * frac) / sum(frac), 4) AS mean, round(sum(frac), 4) AS area, round(sum(frac * frac * l_tax) / (sum(frac) * sum(frac)), 10) AS variance
    FROM lineitem JOIN map USING (l_partkey) GROUP BY 1, 2""")
def sparse_integration(t: Tables) -> DataFrame:
    """A sparse map applied to frames: area-weighted means of bins, with variances (radial integration of a stack)."""
    bins = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 10).alias("bin"), (F.col("p_size") / 50.0).alias("frac"))
    frames = t.lineitem.select(F.col("l_linenumber").alias("frame"), "l_partkey", "l_extendedprice", "l_tax")
    out = agg.integrate(frames, bins, "frame", "l_partkey", "l_extendedprice", "bin", "frac", "l_tax")
    return out.select("frame", "bin", F.round("mean", 4).alias("mean"), F.round("area", 4).alias("area"), F.round("variance", 10).alias("variance"))


@queries.add("""
    WITH b AS (SELECT l_linenumber, p_size % 10 AS bin, sum(l_extendedprice * p_size) / sum(p_size) AS i, sum(p_size) AS a FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT CAST(bin AS INTEGER) AS bin, round(sum(i * a) / sum(a), 4) AS weighted, round(avg(i), 4) AS simple FROM b WHERE a > 100 GROUP BY 1""")
def profile_means(t: Tables) -> DataFrame:
    """A profile from a cake: area-weighted and simple means over valid bins."""
    bins = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 10).alias("bin"), F.col("p_size").alias("frac"))
    cake = agg.integrate(t.lineitem, bins, "l_linenumber", "l_partkey", "l_extendedprice", "bin", "frac").where("area > 100")
    return cake.groupBy("bin").agg(F.round(agg.weighted_mean("mean", "area"), 4).alias("weighted"), F.round(F.avg("mean"), 4).alias("simple"))


@queries.add("""
    SELECT p_brand, round(quantile_disc(p_retailprice, 0.5), 6) AS lower_median, round(median(p_retailprice), 6) AS middle FROM part GROUP BY p_brand""")
def lower_medians(t: Tables) -> DataFrame:
    """The lower middle value beside the interpolated median (temporal median of frames)."""
    return t.part.groupBy("p_brand").agg(F.round(agg.lower_median("p_retailprice"), 6).alias("lower_median"), F.round(F.median("p_retailprice"), 6).alias("middle"))


_SPREAD = """
    WITH m AS (SELECT event_type, median(value) AS c, stddev_pop(value) AS s FROM events GROUP BY 1),
    d AS (SELECT event_type, 1.4826 * median(abs(value - c)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1),
    r AS (SELECT m.event_type, c, CASE WHEN mad > 0 THEN mad ELSE s END AS spread FROM m JOIN d USING (event_type))"""


@queries.add(_SPREAD + "SELECT event_type, round(c, 6) AS centre, round(spread, 6) AS spread FROM r")
def robust_spread(t: Tables) -> DataFrame:
    """Median and scaled median absolute deviation of each type."""
    return agg.robust_spread(t.events, ["event_type"], "value").select("event_type", F.round("centre", 6).alias("centre"), F.round("spread", 6).alias("spread"))


@queries.add(_SPREAD + "SELECT event_id, abs(value - c) > 2 * spread AS clipped, round(CASE WHEN abs(value - c) > 2 * spread THEN c ELSE value END, 6) AS value FROM events JOIN r USING (event_type)")
def sigma_clipped(t: Tables) -> DataFrame:
    """Values beyond two spreads replaced by their group's median (cosmic ray rejection)."""
    return agg.sigma_clip(t.events, ["event_type"], "value", 2.0, "replace").select("event_id", "clipped", F.round("value", 6).alias("value"))


@queries.add("""
    SELECT l_returnflag, l_linestatus, CAST(floor(l_discount * 20) AS BIGINT) AS bucket, round(median(l_extendedprice), 4) AS middle, count(*) AS n, round(max(l_tax), 6) AS top
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (CAST(floor(l_discount * 20) AS BIGINT)), ())""")
def residual_decomposition(t: Tables) -> DataFrame:
    """One table summed by three groupings and in total."""
    t.lineitem.withColumn("bucket", F.floor(F.col("l_discount") * 20)).createOrReplaceTempView("__residuals")
    return t.spark.sql("""SELECT l_returnflag, l_linestatus, bucket, round(median(l_extendedprice), 4) AS middle, count(*) AS n, round(max(l_tax), 6) AS top
        FROM __residuals GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (bucket), ())""")


@queries.add("""
    WITH c AS (SELECT l_suppkey AS s, l_orderkey AS o, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, count(*) OVER (PARTITION BY o) AS n, row_number() OVER (PARTITION BY o ORDER BY q DESC, s) AS k FROM c)
    SELECT s AS l_suppkey, count(*) FILTER (WHERE k = 1) AS owned, count(*) AS claimed, count(*) FILTER (WHERE n > 1) AS shared, count(*) FILTER (WHERE n > 1 AND k > 1) AS contested FROM r GROUP BY s""")
def spot_budget(t: Tables) -> DataFrame:
    """Orders owned, claimed, shared and lost by each supplier; a contested one goes to the largest quantity."""
    return agg.shared_budget(t.lineitem, "l_suppkey", "l_orderkey", "l_quantity")


@queries.add()
def greedy_coverage(t: Tables) -> DataFrame:
    """Suppliers of each return flag that add most parts, one after the other."""
    return agg.coverage_budget(t.lineitem, "l_returnflag", "l_suppkey", "l_partkey", most=1, least_new=3)


@queries.add("""
    WITH r AS (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) - coalesce(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY q, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
        FROM (SELECT *, o_custkey % 97 AS q FROM orders))
    SELECT o_orderpriority, count(*) FILTER (WHERE rest > 100000000) AS dropped, count(*) FILTER (WHERE rest <= 100000000) AS kept FROM r GROUP BY 1""")
def volume_budget(t: Tables) -> DataFrame:
    """Worst quality goes first until the rest fits the budget."""
    graded = agg.worst_first_budget(t.orders.withColumn("q", F.col("o_custkey") % 97), ["o_orderpriority"], "o_totalprice", "q", "o_orderkey", F.lit(1e8))
    return graded.groupBy("o_orderpriority").agg(F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("kept"))


@queries.add("""
    WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS votes, median(o_totalprice) AS r, min(o_orderkey) AS f FROM orders GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, r, f) AS n FROM v) SELECT o_custkey, o_orderpriority, votes FROM k WHERE n = 1""")
def plurality_votes(t: Tables) -> DataFrame:
    """Each customer's most frequent priority; ties to the smaller median price, then the first order."""
    return agg.plurality(t.orders, ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey")


_HISTOGRAM = "SELECT CAST(floor((log10(o_totalprice) - 2.0) / 0.05) AS BIGINT) AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 AND floor((log10(o_totalprice) - 2.0) / 0.05) BETWEEN 0 AND 79 GROUP BY 1"


@queries.add(f"""
    WITH h AS ({_HISTOGRAM}), g AS (SELECT r.i AS bin, coalesce(h.n, 0) AS n FROM range(80) r(i) LEFT JOIN h ON h.bin = r.i),
    w AS (SELECT *, lag(n) OVER (ORDER BY bin) AS a, lead(n) OVER (ORDER BY bin) AS b FROM g) SELECT bin, n FROM w WHERE n < a AND n < b""")
def histogram_antimodes(t: Tables) -> DataFrame:
    """Valleys of a logarithmic histogram."""
    return agg.antimodes(agg.log_histogram(t.orders, "o_totalprice", 2.0, 6.0, 80), 80)


@queries.add("""
    WITH h AS (SELECT CAST(l_discount * 100 AS INTEGER) AS b, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
    s AS (SELECT greatest(a / CAST(sum(a) OVER () AS DOUBLE), 1e-12) AS p, greatest(r / CAST(sum(r) OVER () AS DOUBLE), 1e-12) AS q FROM h)
    SELECT round(sum(p * ln(p / q)), 8) AS kl, round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 8) AS js FROM s""")
def divergences(t: Tables) -> DataFrame:
    """Kullback-Leibler and Jensen-Shannon divergence of two groups' histograms."""
    d = t.lineitem.withColumn("bucket", F.round(F.col("l_discount") * 100).cast("int"))
    return agg.divergence(d, "l_returnflag", "bucket", "A", "R").select(F.round("kl", 8).alias("kl"), F.round("js", 8).alias("js"))


@queries.add("""
    WITH a AS (SELECT *, abs(value - 50) AS r FROM events), m AS (SELECT event_type, median(r) AS md FROM a GROUP BY 1),
    d AS (SELECT event_type, md, median(abs(r - md)) AS mad FROM a JOIN m USING (event_type) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY r, event_id) AS n FROM a JOIN d USING (event_type))
    SELECT event_id FROM k WHERE r <= md + 1.0 * mad OR n <= 10""")
def stratified_trim(t: Tables) -> DataFrame:
    """Residuals beyond median and deviation of their cell go, the ten smallest of a cell stay."""
    return agg.stratified_trim(t.events.withColumn("res", F.col("value") - 50), ["event_type"], "res", "event_id", 1.0, 10).select("event_id")


@queries.add("""
    WITH RECURSIVE r(k, lim, done) AS (SELECT 0, CAST(1e300 AS DOUBLE), FALSE UNION ALL SELECT k + 1, least(n.m, r.lim), n.m >= r.lim FROM r, LATERAL (SELECT 2 * avg(abs(value)) AS m FROM events WHERE abs(value) <= r.lim) n WHERE k < 100 AND NOT done)
    SELECT event_id FROM events WHERE abs(value) <= (SELECT min(lim) FROM r)""")
def multiple_cut(t: Tables) -> DataFrame:
    """Rows within a multiple of the mean of those kept, cut until stable."""
    return agg.multiple_of_mean_cut(t.events, "value", 2.0).select("event_id")


@queries.add()
def bootstrap_percentiles(t: Tables) -> DataFrame:
    """Percentiles of the mean over hash-drawn resamples."""
    return agg.bootstrap(t.events, "event_id", "value", 50)


@queries.add("""
    SELECT o_orderkey, round((sum(o_totalprice) OVER w - o_totalprice) / nullif(count(*) OVER w - 1, 0), 4) AS jackknife FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def leave_one_out(t: Tables) -> DataFrame:
    """The mean of the other rows of each group."""
    return agg.leave_one_out(t.orders, ["o_custkey"], "o_totalprice").select("o_orderkey", F.round("jackknife", 4).alias("jackknife"))


@queries.add("""
    SELECT p_brand, round(coalesce(exp(avg(ln(l_extendedprice / (l_quantity * p_retailprice)))), 1), 8) AS scale FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_extendedprice > 0 GROUP BY 1""")
def geometric_scale(t: Tables) -> DataFrame:
    """Geometric mean of observed over predicted."""
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("pred", F.col("l_quantity") * F.col("p_retailprice"))
    return agg.geometric_scale(d, ["p_brand"], "l_extendedprice", "pred").select("p_brand", F.round("scale", 8).alias("scale"))


@queries.add("""
    WITH p AS (SELECT floor(sqrt(pow(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1], 2) + pow(CAST(a.embedding[2] AS DOUBLE) - b.embedding[2], 2)) / 0.05) AS bin, CAST(a.embedding[3] AS DOUBLE) AS x, CAST(b.embedding[3] AS DOUBLE) AS y
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label AND sqrt(pow(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1], 2) + pow(CAST(a.embedding[2] AS DOUBLE) - b.embedding[2], 2)) < 0.2)
    SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 6) AS r FROM p GROUP BY 1""")
def distance_binned_correlation(t: Tables) -> DataFrame:
    """Correlation of a property over pairs, by the pairs' distance; null for fewer than three pairs."""
    e = t.embeddings.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")])
    pairs = joins.pairs_within(e, "vec_id", ["x", "y"], 0.2, ["label"])
    met = pairs.join(e.select(F.col("vec_id").alias("a"), F.col("z").alias("za")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("z").alias("zb")), "b")
    return met.groupBy(F.floor(F.col("distance") / 0.05).alias("bin")).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 3, F.corr("za", "zb")), 6).alias("r"))


@queries.add("""
    SELECT p_brand, CASE WHEN count(*) >= 3 THEN round(regr_intercept(p_retailprice, 1 / sqrt(2.0 * p_size)), 4) END AS sigma0, CASE WHEN count(*) >= 3 THEN round(regr_slope(p_retailprice, 1 / sqrt(2.0 * p_size)), 4) END AS k,
        CASE WHEN count(*) >= 3 THEN round(regr_r2(p_retailprice, 1 / sqrt(2.0 * p_size)), 6) END AS r2, count(*) AS n FROM part GROUP BY 1""")
def size_regression(t: Tables) -> DataFrame:
    """Regression on the inverse root of a size, for each variant."""
    x = t.part.withColumn("x", 1 / F.sqrt(2.0 * F.col("p_size")))
    fine = F.count("*") >= 3
    return x.groupBy("p_brand").agg(F.when(fine, F.round(F.regr_intercept("p_retailprice", "x"), 4)).alias("sigma0"), F.when(fine, F.round(F.regr_slope("p_retailprice", "x"), 4)).alias("k"), F.when(fine, F.round(F.regr_r2("p_retailprice", "x"), 6)).alias("r2"), F.count("*").alias("n"))


@queries.add("""
    WITH d AS (SELECT p_brand, count(*) AS n, sum(pow(p_size, 3) * p_retailprice) / sum(pow(p_size, 3)) AS m FROM part GROUP BY 1)
    SELECT a.p_brand AS one, b.p_brand AS two, round(a.m / b.m, 8) AS ratio FROM d a JOIN d b ON a.p_brand < b.p_brand""")
def volume_weighted_ratios(t: Tables) -> DataFrame:
    """Volume-weighted means of the variants, and the ratio of each two."""
    m = t.part.groupBy("p_brand").agg(agg.weighted_mean("p_retailprice", F.pow("p_size", F.lit(3))).alias("m"))
    two = m.select(F.col("p_brand").alias("two"), F.col("m").alias("m2"))
    return m.join(F.broadcast(two), F.col("p_brand") < F.col("two")).select(F.col("p_brand").alias("one"), "two", F.round(F.col("m") / F.col("m2"), 8).alias("ratio"))


@queries.add("""
    WITH c AS (SELECT CASE WHEN l_quantity < 5 THEN 'low' WHEN l_discount >= 0.08 THEN 'bragg' WHEN l_tax >= 0.06 THEN 'asterism' ELSE 'between' END AS class, l_extendedprice AS i FROM lineitem)
    SELECT class, round(sum(i) / sum(sum(i)) OVER (), 8) AS share FROM c GROUP BY class""")
def intensity_shares(t: Tables) -> DataFrame:
    """A partition of the whole into classes whose shares sum to one."""
    label = F.when(F.col("l_quantity") < 5, "low").when(F.col("l_discount") >= 0.08, "bragg").when(F.col("l_tax") >= 0.06, "asterism").otherwise("between")
    sums = t.lineitem.groupBy(label.alias("class")).agg(F.sum("l_extendedprice").alias("s"))
    return sums.select("class", F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 8).alias("share"))


@queries.add("""
    WITH m AS (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS mu, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2),
    c AS (SELECT l_returnflag, avg(s) AS mean FROM m GROUP BY 1)
    SELECT l_returnflag, round(sum((s - mean) * (s - mean) / greatest(s, 1)) / (count(*) - 1), 4) AS chi2, count(*) AS n FROM m JOIN c USING (l_returnflag) GROUP BY 1""")
def ring_chi_square(t: Tables) -> DataFrame:
    """Scatter of the bins' sums about their ring's mean over Poisson variances, for each degree of freedom."""
    bins = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_extendedprice").alias("s"))
    mean = bins.withColumn("mean", F.avg("s").over(Window.partitionBy("l_returnflag")))
    return mean.groupBy("l_returnflag").agg(F.round(F.sum((F.col("s") - F.col("mean")) * (F.col("s") - F.col("mean")) / F.greatest("s", F.lit(1.0))) / (F.count("*") - 1), 4).alias("chi2"), F.count("*").alias("n"))


@queries.add("""
    WITH p AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem),
    n AS (SELECT p_partkey, count(supp) AS k FROM part LEFT JOIN p ON part = p_partkey GROUP BY 1)
    SELECT round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS spread, count(*) AS centres FROM n""")
def coordination_number(t: Tables) -> DataFrame:
    """Neighbours of each centre, those without any included: mean and population deviation."""
    near = t.lineitem.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("k"))
    counts = t.part.join(near, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    return counts.agg(F.round(F.avg("k"), 6).alias("mean"), F.round(F.stddev_pop("k"), 6).alias("spread"), F.count("*").alias("centres"))


@queries.add("""
    WITH n AS (SELECT 31 AS n), s AS (SELECT CAST(year(o_orderdate) AS BIGINT) * 12 + month(o_orderdate) AS t, day(o_orderdate) AS f, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
    SELECT t AS translation, CAST(CASE WHEN t % 2 = 1 THEN 31 - f ELSE f - 1 END AS BIGINT) AS frame, round(v, 4) AS value FROM s""")
def sinogram_assembly(t: Tables) -> DataFrame:
    """Frames re-keyed to a sinogram, odd translations reversed."""
    s = t.orders.groupBy((F.year("o_orderdate").cast("long") * 12 + F.month("o_orderdate")).alias("translation"), F.day("o_orderdate").alias("f")).agg(F.sum("o_totalprice").alias("v"))
    return s.select("translation", F.when(F.col("translation") % 2 == 1, 31 - F.col("f")).otherwise(F.col("f") - 1).cast("long").alias("frame"), F.round("v", 4).alias("value"))


@queries.add("""
    WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, max(n) AS top FROM g GROUP BY 1),
    o AS (SELECT user_id, avg(CASE WHEN n > 0.5 * top THEN 1.0 ELSE 0.0 END) AS share FROM g JOIN m USING (user_id) GROUP BY 1) SELECT round(median(share), 6) AS occupancy, count(*) AS rows_ FROM o""")
def occupancy(t: Tables) -> DataFrame:
    """The median over rows of the share of scans above half the row's peak."""
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("top", F.max("n").over(Window.partitionBy("user_id")))
    share = g.groupBy("user_id").agg(F.avg(F.when(F.col("n") > 0.5 * F.col("top"), 1.0).otherwise(0.0)).alias("share"))
    return share.agg(F.round(F.median("share"), 6).alias("occupancy"), F.count("*").alias("rows_"))


@queries.add("""
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k, event_type FROM events),
    n AS (SELECT event_type, k, v, lead(v) OVER (PARTITION BY event_type ORDER BY k) AS w FROM e)
    SELECT event_type, round(corr(v, w), 6) AS r, count(w) AS n FROM n GROUP BY 1""")
def neighbour_correlation(t: Tables) -> DataFrame:
    """Correlation of consecutive rows (snake detection)."""
    w = Window.partitionBy("event_type").orderBy(micros("ts"))
    return t.events.withColumn("w", F.lead("value").over(w)).groupBy("event_type").agg(F.round(F.corr("value", "w"), 6).alias("r"), F.count("w").alias("n"))


@queries.add("""
    WITH b AS (SELECT p_partkey, greatest(p_size / 50.0, (p_retailprice - 900) / 1200.0) AS f FROM part),
    q AS (SELECT quantile_cont(f, 0.33) AS a, quantile_cont(f, 0.67) AS b FROM b)
    SELECT CAST(CASE WHEN f >= q.b THEN 2 WHEN f >= q.a THEN 1 ELSE 0 END AS INTEGER) AS stratum, count(*) AS n, round(avg(f), 6) AS mean FROM b, q GROUP BY 1""")
def stratified_pairs(t: Tables) -> DataFrame:
    """Rows by the larger of two factors, cut at percentiles of the population."""
    f = t.part.select(F.greatest(F.col("p_size") / 50.0, (F.col("p_retailprice") - 900) / 1200.0).alias("f"))
    cut = f.agg(F.percentile("f", 0.33).alias("a"), F.percentile("f", 0.67).alias("b"))
    return f.join(F.broadcast(cut), F.lit(True)).groupBy(F.when(F.col("f") >= F.col("b"), 2).when(F.col("f") >= F.col("a"), 1).otherwise(0).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean"))


@queries.add("""
    SELECT l_returnflag, count(DISTINCT l_suppkey) AS owners, bool_or(l_tax > 0.07) AS masked, round(sum(l_quantity), 2) AS volume, round(sign(sum(l_tax - 0.04)) * pow(abs(sum(l_tax - 0.04)), 1.0 / 3), 6) AS radius, round(max_by(l_extendedprice, l_orderkey * 1000000 + l_partkey), 4) AS last_price FROM lineitem GROUP BY 1""")
def mixed_totals(t: Tables) -> DataFrame:
    """Distinct counts, any-of flags, guarded cube roots and last values together."""
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("owners"), F.bool_or(F.col("l_tax") > 0.07).alias("masked"), F.round(F.sum("l_quantity"), 2).alias("volume"),
        F.round(agg.signed_cube_root(F.sum(F.col("l_tax") - 0.04)), 6).alias("radius"), F.round(F.max_by("l_extendedprice", F.col("l_orderkey") * 1000000 + F.col("l_partkey")), 4).alias("last_price"))
