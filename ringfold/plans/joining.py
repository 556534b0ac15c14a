"""Queries that show the join operators on the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.functions.columns import micros
from ringfold.operators import joins
from ringfold.plans.registry import Registry, Tables

queries = Registry()

_BANDS = [(1, 905.0), (2, 1000.0), (3, 1100.0), (4, 1205.0), (5, 1300.0), (6, 1408.0), (7, 1500.0)]
_BANDS_SQL = "(VALUES " + ", ".join(f"({k}, CAST({c} AS DOUBLE))" for k, c in _BANDS) + ") AS bands(band, centre)"


def _bands(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_BANDS, "band int, centre double")


@queries.add(f"""
    SELECT p_partkey, band, round(abs(p_retailprice - centre), 6) AS gap FROM part JOIN {_BANDS_SQL} ON abs(p_retailprice - centre) < 60""")
def band_membership(t: Tables) -> DataFrame:
    """One row for each price band that a part lies in (spot to ring)."""
    return joins.band_join(t.part, _bands(t), "p_retailprice", "centre", 60.0).select("p_partkey", "band", F.round(F.abs(F.col("p_retailprice") - F.col("centre")), 6).alias("gap"))


@queries.add(f"""
    WITH m AS (SELECT * FROM part JOIN {_BANDS_SQL} ON abs(p_retailprice - centre) < 60)
    SELECT band, count(*) AS n_parts, round(sum(l_extendedprice) / count(DISTINCT p_partkey), 4) AS mean_revenue,
        round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted_price, max(p_size) AS largest
    FROM m JOIN lineitem ON l_partkey = p_partkey GROUP BY band""")
def band_statistics(t: Tables) -> DataFrame:
    """Price bands with half-widths, and weighted statistics of the parts' line items in each (mean intensity for each ring)."""
    # line items are summed by part first, so that what is joined with the bands is a row for each part
    by_part = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("both"))
    met = joins.band_join(t.part.join(by_part, F.col("p_partkey") == F.col("l_partkey")), _bands(t), "p_retailprice", "centre", 60.0)
    return met.groupBy("band").agg(
        F.sum("n").alias("n_parts"), F.round(F.sum("price") / F.count("*"), 4).alias("mean_revenue"), F.round(F.sum("both") / F.sum("quantity"), 4).alias("weighted_price"), F.max("p_size").alias("largest"))


@queries.add("""
    SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id < b.event_id
    AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 60000000 AND abs(a.value - b.value) < 5""")
def tolerance_pairs(t: Tables) -> DataFrame:
    """Events of one type within a minute and five units of value (a bin probe with a box of tolerances)."""
    e = t.events.select("event_id", "event_type", micros("ts").cast("double").alias("t"), "value")
    met = joins.tolerance_join(e, e, ["event_type"], {"t": 60e6, "value": 5.0})
    return met.where("event_id < r_event_id").select("event_id", F.col("r_event_id").alias("other"))


@queries.add("""
    WITH p AS (SELECT a.event_id, b.event_id AS other, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap FROM events a JOIN events b
        ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 600000000000),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, other) AS k FROM p)
    SELECT event_id, other, gap FROM r WHERE k = 1""")
def nearest_in_window(t: Tables) -> DataFrame:
    """For each view the user's purchase nearest in time within a window (predicted to observed, least difference)."""
    e = t.events.select("event_id", "user_id", "event_type", micros("ts").alias("t"))
    met = joins.tolerance_join(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], {"t": 600e9})
    best = met.groupBy("event_id").agg(F.min(F.struct(F.abs(F.col("t") - F.col("r_t")).alias("gap"), F.col("r_event_id").alias("other"))).alias("m"))
    return best.select("event_id", "m.other", "m.gap")


_AS_OF = """
    WITH s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'error'),
    f AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'),
    j AS (SELECT event_id, f.ts AS t,
        (SELECT struct_pack(ts := s.ts, v := s.value) FROM s WHERE s.user_id = f.user_id AND s.ts <= f.ts ORDER BY s.ts DESC LIMIT 1) AS a,
        (SELECT struct_pack(ts := s.ts, v := s.value) FROM s WHERE s.user_id = f.user_id AND s.ts > f.ts ORDER BY s.ts LIMIT 1) AS b FROM f)
    SELECT event_id, {} AS value FROM j"""


def _as_of(t: Tables, mode: str, digits: int = 6) -> DataFrame:
    samples = t.events.where("event_type = 'error'").select("user_id", micros("ts").alias("t"), "value")
    frames = t.events.where("event_type <> 'error'").select("event_id", "user_id", micros("ts").alias("t"))
    return joins.as_of(frames, samples, "t", "value", ["user_id"], mode).select("event_id", F.round("value", digits).alias("value"))


@queries.add(_AS_OF.format("round(coalesce(a.v, b.v), 6)"))
def as_of_previous(t: Tables) -> DataFrame:
    """The user's last error value as of each event, the first one before any."""
    return _as_of(t, "previous")


@queries.add(_AS_OF.format("round(CASE WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v WHEN epoch_us(t) - epoch_us(a.ts) <= epoch_us(b.ts) - epoch_us(t) THEN a.v ELSE b.v END, 6)"))
def as_of_nearest(t: Tables) -> DataFrame:
    """The user's error value nearest in time, the earlier one on a tie."""
    return _as_of(t, "nearest")


@queries.add(_AS_OF.format("round(CASE WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v ELSE a.v + (b.v - a.v) * CAST(epoch_us(t) - epoch_us(a.ts) AS DOUBLE) / CAST(epoch_us(b.ts) - epoch_us(a.ts) AS DOUBLE) END, 8)"))
def as_of_linear(t: Tables) -> DataFrame:
    """The user's error value between the two around each event."""
    return _as_of(t, "linear", 8)


@queries.add("""
    SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 1 WHEN o_totalprice >= 50000 AND o_totalprice < 150000 THEN 2
        WHEN o_totalprice >= 200000 AND o_totalprice < 300000 THEN 3 ELSE -1 END AS ring FROM orders""")
def interval_ring(t: Tables) -> DataFrame:
    """The half-open interval that holds a value, -1 for none."""
    rings = t.spark.createDataFrame([(1, 0.0, 50000.0), (2, 50000.0, 150000.0), (3, 200000.0, 300000.0)], "ring int, lo double, hi double")
    return joins.interval_lookup(t.orders.select("o_orderkey", "o_totalprice"), rings, "o_totalprice", "lo", "hi", "ring").select("o_orderkey", "ring")


@queries.add("""
    WITH p AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS g FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY g, c_custkey) AS k FROM p)
    SELECT s.s_suppkey, r.c_custkey, round(r.g, 6) AS gap FROM supplier s LEFT JOIN r ON r.s_suppkey = s.s_suppkey AND r.k = 1""")
def nearest_or_null(t: Tables) -> DataFrame:
    """The nearest reflection within a tolerance, null where there is none."""
    return joins.nearest_within(t.supplier, t.customer, "s_suppkey", "c_custkey", "s_acctbal", "c_acctbal", 3.0).select("s_suppkey", "c_custkey", F.round("gap", 6).alias("gap"))


@queries.add("""
    WITH p AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS g FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) < 200),
    a AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY g, c_custkey) AS ka, row_number() OVER (PARTITION BY c_custkey ORDER BY g, s_suppkey) AS kb FROM p)
    SELECT s_suppkey, c_custkey, round(g, 6) AS gap FROM a WHERE ka = 1 AND kb = 1""")
def mutual_pairs(t: Tables) -> DataFrame:
    """Suppliers and customers of a nation that are each other's nearest in balance."""
    met = joins.tolerance_join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("x")), t.customer.select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("x")), ["n"], {"x": 200.0})
    pairs = met.select("s_suppkey", F.col("r_c_custkey").alias("c_custkey"), F.abs(F.col("x") - F.col("r_x")).alias("gap"))
    return joins.mutual_nearest(pairs, "s_suppkey", "c_custkey", "gap").withColumn("gap", F.round("gap", 6))


@queries.add("""
    WITH s AS (SELECT a.l_suppkey AS a, b.o_custkey AS b, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a
        JOIN (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) b USING (l_partkey) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS ka, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS kb FROM s)
    SELECT a, b, n AS shared FROM r WHERE ka = 1 AND kb = 1""")
def overlap_pairs(t: Tables) -> DataFrame:
    """Suppliers and customers that share most parts, each the other's best (pixel overlap of consecutive frames)."""
    left = t.lineitem.select(F.col("l_suppkey").alias("a"), "l_partkey").distinct()
    right = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("b"), "l_partkey").distinct()
    return joins.overlap_match(left, right, ["l_partkey"], "a", "b")


@queries.add("""
    WITH m AS (SELECT DISTINCT o_custkey AS g, l_partkey AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'),
    z AS (SELECT g, count(*) AS n FROM m GROUP BY g),
    p AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM m x JOIN m y ON x.m = y.m AND x.g < y.g GROUP BY 1, 2)
    SELECT a, b, shared, round(shared / CAST(za.n + zb.n - shared AS DOUBLE), 6) AS jaccard FROM p JOIN z za ON za.g = a JOIN z zb ON zb.g = b
    WHERE shared / CAST(za.n + zb.n - shared AS DOUBLE) >= 0.1""")
def shared_parts(t: Tables) -> DataFrame:
    """Customers whose urgent orders share parts, by Jaccard similarity (clusters that share spots)."""
    m = t.orders.where("o_orderpriority = '1-URGENT'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return joins.shared_member_pairs(m, "o_custkey", "l_partkey", 0.1).withColumn("jaccard", F.round("jaccard", 6))


@queries.add("""
    SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS rich_customers, coalesce(b.n, 0) AS rich_suppliers FROM
    (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) b ON a.k = b.k""")
def outer_fill(t: Tables) -> DataFrame:
    """Matched and unmatched rows of two states, zeros for a missing side."""
    a = t.customer.where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("rich_customers"))
    b = t.supplier.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("rich_suppliers"))
    return joins.outer_report(a, b, "nation", {"rich_customers": 0, "rich_suppliers": 0})


@queries.add("""
    SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(pow(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1], 2) + pow(CAST(a.embedding[2] AS DOUBLE) - b.embedding[2], 2)), 5) AS distance
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE sqrt(pow(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1], 2) + pow(CAST(a.embedding[2] AS DOUBLE) - b.embedding[2], 2)) < 0.1""")
def neighbours_in_plane(t: Tables) -> DataFrame:
    """Points of a label nearer than a radius, by grid cells."""
    p = t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return joins.pairs_within(p, "vec_id", ["x", "y"], 0.1, ["label"]).select("a", "b", F.round("distance", 5).alias("distance"))


@queries.add("""
    SELECT e.event_id, round(e.value / greatest(coalesce(m.w, 1.0), 1e-30), 6) AS normalised FROM events e
    LEFT JOIN (SELECT user_id, avg(value) AS w FROM events WHERE event_type = 'purchase' GROUP BY 1) m ON m.user_id = e.user_id""")
def normalised_values(t: Tables) -> DataFrame:
    """Values over their user's monitor, 1 where there is none (frame normaliser)."""
    monitor = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.avg("value").alias("w"))
    met = joins.with_default(t.events, monitor, "user_id", "w", 1.0)
    return met.select("event_id", F.round(F.col("value") / F.greatest("w", F.lit(1e-30)), 6).alias("normalised"))


@queries.add("""
    WITH c AS (SELECT p_partkey, ref, abs(p_retailprice - place) AS cost FROM part, (VALUES (1, CAST(950 AS DOUBLE)), (2, 1180.0), (3, 1390.0)) AS r(ref, place)),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY cost, ref) AS n FROM c)
    SELECT p_partkey, ref, round(cost, 6) AS cost FROM k WHERE n = 1""")
def nearest_reference(t: Tables) -> DataFrame:
    """Each row's nearest fixed reference (variant assignment)."""
    refs = t.spark.createDataFrame([(1, 950.0), (2, 1180.0), (3, 1390.0)], "ref int, place double")
    return joins.nearest_reference(t.part.select("p_partkey", "p_retailprice"), refs, "p_partkey", F.abs(F.col("p_retailprice") - F.col("place")), "ref").withColumn("cost", F.round("cost", 6))


@queries.add("""
    WITH RECURSIVE p AS (SELECT s_nationkey AS n, s_suppkey AS a, c_custkey AS b, abs(s_acctbal - c_acctbal) AS g FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) < 500), o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY g, a, b) AS i FROM p),
    w(n, i, used_a, used_b, hit) AS (SELECT DISTINCT n, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), FALSE FROM o UNION ALL
        SELECT o.n, o.i, CASE WHEN list_contains(w.used_a, o.a) OR list_contains(w.used_b, o.b) THEN w.used_a ELSE list_append(w.used_a, o.a) END, CASE WHEN list_contains(w.used_a, o.a) OR list_contains(w.used_b, o.b) THEN w.used_b ELSE list_append(w.used_b, o.b) END, NOT (list_contains(w.used_a, o.a) OR list_contains(w.used_b, o.b)) FROM w JOIN o ON o.n = w.n AND o.i = w.i + 1)
    SELECT o.n, o.a AS s_suppkey, o.b AS c_custkey, o.g AS gap FROM w JOIN o USING (n, i) WHERE hit""")
def greedy_pairs(t: Tables) -> DataFrame:
    """Suppliers and customers of a nation paired cheapest first, each once."""
    return joins.greedy_assignment(_balance_pairs(t), "n", "s_suppkey", "c_custkey", "gap")


@queries.add()
def optimal_pairs(t: Tables) -> DataFrame:
    """Suppliers and customers of a nation paired one to one at least total cost."""
    return joins.optimal_assignment(_balance_pairs(t), "n", "s_suppkey", "c_custkey", "gap")


def _balance_pairs(t: Tables) -> DataFrame:
    met = joins.tolerance_join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("x")), t.customer.select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("x")), ["n"], {"x": 500.0})
    return met.select("n", "s_suppkey", F.col("r_c_custkey").alias("c_custkey"), F.abs(F.col("x") - F.col("r_x")).alias("gap"))


@queries.add("""
    WITH d AS (SELECT DISTINCT e.event_id FROM events e JOIN events f ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.event_id <> f.event_id
        AND abs(epoch_us(e.ts) - epoch_us(f.ts)) < 3600000000 AND abs(e.value - f.value) < 20)
    SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM d)""")
def without_near_repeats(t: Tables) -> DataFrame:
    """Events with no other of their user and type within an hour and twenty units: both of a pair go (spot dedup within a grain)."""
    e = t.events.select("event_id", "user_id", "event_type", micros("ts").cast("double").alias("t"), "value")
    met = joins.tolerance_join(e, e, ["user_id", "event_type"], {"t": 3600e6, "value": 20.0}).where("event_id <> r_event_id")
    return t.events.select("event_id").join(met.select("event_id").distinct(), "event_id", "left_anti")


@queries.add("""
    WITH m AS (SELECT s_suppkey AS material, b.band, min(abs(p_retailprice - centre)) AS gap FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey
        JOIN """ + _BANDS_SQL.replace("AS bands", "AS b") + """ ON abs(p_retailprice - centre) <= 5 GROUP BY 1, 2)
    SELECT material, count(*) AS matched, round(sqrt(avg(gap * gap)), 6) AS rms, CAST(row_number() OVER (ORDER BY count(*) DESC, round(sqrt(avg(gap * gap)), 6), material) AS INTEGER) AS place FROM m GROUP BY material""")
def ranked_materials(t: Tables) -> DataFrame:
    """Candidates by how many bands they match within a tolerance, then by the root mean square of the gaps."""
    from pyspark.sql import Window

    parts = joins.band_join(t.part.select("p_partkey", "p_retailprice"), _bands(t), "p_retailprice", "centre", 5.0, strict=False)
    gaps = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("material")).join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("material", "band").agg(F.min(F.abs(F.col("p_retailprice") - F.col("centre"))).alias("gap"))
    scored = gaps.groupBy("material").agg(F.count("*").alias("matched"), F.round(F.sqrt(F.avg(F.col("gap") * F.col("gap"))), 6).alias("rms"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("matched"), "rms", "material")))


@queries.add("""
    SELECT coalesce(CAST(n_regionkey AS INTEGER), -1) AS region, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 GROUP BY 1""")
def lookup_or_default(t: Tables) -> DataFrame:
    """A label by equality, -1 where the lookup has none (offsets for each layer and grain)."""
    known = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    return t.customer.join(known, "c_nationkey", "left").groupBy(F.coalesce("region", F.lit(-1)).alias("region")).agg(F.count("*").alias("n"))
