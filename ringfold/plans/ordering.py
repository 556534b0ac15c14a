"""Queries that show the window, set and graph operators on the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.functions.columns import micros
from ringfold.operators import graph, joins, sets, summaries, windows
from ringfold.plans.registry import Registry, Tables

queries = Registry()

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@queries.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice > 100000")
def renumbered(t: Tables) -> DataFrame:
    """Rows numbered from 1 over the whole table, after a filter, without one task sorting it."""
    return windows.renumber(t.orders.where("o_totalprice > 100000").select("o_orderkey", "o_totalprice"), "n", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "n")


@queries.add("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS n FROM orders")
def numbered_in_group(t: Tables) -> DataFrame:
    """Numbers from 0 within each group."""
    return windows.renumber(t.orders, "n", ["o_orderdate", "o_orderkey"], ["o_custkey"], 0).select("o_orderkey", "n")


_SESSIONS = """
    WITH d AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM d)"""


@queries.add(_SESSIONS + """
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS rows, round(sum(value), 4) AS weight, round(sum(event_id * value) / sum(value), 4) AS place_mean, max_by(event_id, epoch_us(ts)) AS place_last,
        coalesce(arg_min(CAST(event_id % 3 AS INTEGER), epoch_us(ts)) FILTER (WHERE event_id % 3 <> 0), 0) AS first_code FROM s GROUP BY 1, 2""")
def merged_chains(t: Tables) -> DataFrame:
    """Chains of a user's events without a gap over two days: weighted means, last values, the first code that isn't 0."""
    e = t.events.select("user_id", "event_id", micros("ts").alias("at"), "value", F.col("event_id").alias("place"), (F.col("event_id") % 3).cast("int").alias("code"))
    chained = windows.sessions(e, ["user_id"], "at", "event_id", F.col("__dt") > 172800e6)
    out = windows.accumulate(chained, ["user_id", "session"], "value", ["place"], F.col("at"), "code")
    return out.select("user_id", "session", "rows", F.round("weight", 4).alias("weight"), F.round("place_mean", 4).alias("place_mean"), "place_last", "first_code")


@queries.add("""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT *, k - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM n WHERE value > 15)
    SELECT event_type, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last, count(*) AS length FROM f GROUP BY event_type, g HAVING count(*) >= 4""")
def long_runs(t: Tables) -> DataFrame:
    """Runs of at least four consecutive rows above a limit."""
    e = t.events.select("event_type", micros("ts").alias("at"), "value")
    return windows.runs(e, ["event_type"], "at", F.col("value") > 15, 4).select("event_type", "first", "last", "length")


@queries.add("SELECT event_id, round(quantile_cont(value, 0.1) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 6) AS background FROM events")
def rolling_background(t: Tables) -> DataFrame:
    """The tenth percentile of 51 rows around each."""
    e = t.events.withColumn("o", F.struct("ts", "event_id"))
    return windows.rolling_percentile(e, ["event_type"], "o", "value", 0.1, 25).select("event_id", F.round("background", 6).alias("background"))


_DAILY = "SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1"


def _daily(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("day")).agg(F.sum("o_totalprice").alias("v")).withColumn("one", F.lit(1))


@queries.add(f"""
    WITH d AS ({_DAILY}), n AS (SELECT *, row_number() OVER (ORDER BY day) AS k FROM d), m AS (SELECT max(k) AS hi FROM n),
    p AS (SELECT k, v, day FROM n UNION ALL SELECT 1 - i, (SELECT v FROM n WHERE k = 1), NULL FROM range(1, 4) r(i) UNION ALL SELECT hi + i, (SELECT v FROM n, m WHERE k = hi), NULL FROM m, range(1, 4) r(i)),
    w AS (SELECT day, median(v) OVER (ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS b FROM p) SELECT day, round(b, 4) AS background FROM w WHERE day IS NOT NULL""")
def padded_median(t: Tables) -> DataFrame:
    """A rolling median whose ends repeat the end values; a window of six counts as seven."""
    n = windows.renumber(_daily(t), "k", ["day"], ["one"])
    return windows.padded_median(n, ["one"], "k", "v", 6).select("day", F.round("background", 4).alias("background"))


@queries.add("""
    WITH h AS (SELECT CAST(hour(ts) AS BIGINT) AS h, sum(value) AS v FROM events GROUP BY 1)
    SELECT a.h AS hour, round((sum(CASE WHEN (b.h - a.h + 24) % 24 = 0 THEN 2 ELSE 1 END * b.v)) / 4, 4) AS smooth FROM h a JOIN h b ON (b.h - a.h + 24) % 24 IN (0, 1, 23) GROUP BY 1""")
def circular_smoothing(t: Tables) -> DataFrame:
    """Weighted neighbours on a ring of 24 places."""
    h = t.events.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.sum("value").alias("v"))
    return windows.circular_smooth(h, [], "hour", "v", 24, [1, 2, 1]).select("hour", F.round("smooth", 4).alias("smooth"))


@queries.add(f"""
    WITH d AS ({_DAILY}), w AS (SELECT day, v, lag(v) OVER (ORDER BY day) AS a, lead(v) OVER (ORDER BY day) AS b FROM d)
    SELECT day, round(2 * v - a - b, 4) AS bend FROM w WHERE v >= a AND v > b AND 2 * v - a - b >= 500000""")
def curvature_peaks(t: Tables) -> DataFrame:
    """Peaks by negative second difference."""
    return windows.second_difference_peaks(_daily(t), ["one"], "day", "v", 500000.0).select("day", F.round("bend", 4).alias("bend"))


@queries.add()
def snip_background(t: Tables) -> DataFrame:
    """Background of the daily series by peak clipping."""
    return windows.snip(_daily(t), ["one"], "day", "v", 20).select("day", F.round("background", 4).alias("background"))


@queries.add("""
    SELECT event_id, round(value - avg(value) OVER w, 6) AS delta, round(pow(1 - 1.0 / count(*) OVER w, 2) * value + (sum(value) OVER w - value) / pow(count(*) OVER w, 2), 6) AS delta_variance FROM events WINDOW w AS (PARTITION BY user_id)""")
def difference_to_mean(t: Tables) -> DataFrame:
    """Differences to the group's mean, with their variance (Poisson)."""
    return windows.difference_to_mean(t.events.withColumn("var", F.col("value")), ["user_id"], "value", "var").select("event_id", F.round("delta", 6).alias("delta"), F.round("delta_variance", 6).alias("delta_variance"))


@queries.add("""
    WITH r AS (SELECT *, row_number() OVER w AS n, lead(o_totalprice) OVER w AS x FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
    SELECT o_custkey, o_orderkey AS best, round(o_totalprice - coalesce(x, 0), 4) AS margin FROM r WHERE n = 1""")
def confidence_margin(t: Tables) -> DataFrame:
    """The best score's lead over the next."""
    return windows.margin(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey").withColumn("margin", F.round("margin", 4))


@queries.add("""
    WITH g AS (SELECT l_suppkey, l_partkey, avg(l_quantity) AS frac, min(l_discount) AS ia FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY frac DESC, ia, l_partkey) AS n FROM g) SELECT l_suppkey, l_partkey, round(frac, 6) AS frac FROM r WHERE n = 1""")
def best_tuple(t: Tables) -> DataFrame:
    """The largest fraction, then the smallest angle, as one maximum of a struct."""
    g = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.avg("l_quantity").alias("frac"), F.min("l_discount").alias("ia"))
    best = g.groupBy("l_suppkey").agg(F.max(F.struct("frac", (-F.col("ia")).alias("i"), (-F.col("l_partkey")).alias("p"))).alias("m"))
    return best.select("l_suppkey", (-F.col("m.p")).alias("l_partkey"), F.round("m.frac", 6).alias("frac"))


@queries.add("SELECT * FROM (SELECT l_returnflag, l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 7")
def capped_regions(t: Tables) -> DataFrame:
    """At most seven rows of each key, the brightest."""
    return windows.top_rows(t.lineitem, ["l_returnflag"], [F.desc("l_extendedprice"), *_LINE], 7).select("l_returnflag", "l_orderkey", "l_partkey", "rank")


@queries.add("SELECT CAST(block AS INTEGER) AS block, count(*) AS n, min(o_orderkey) AS first FROM (SELECT *, ntile(7) OVER (ORDER BY o_orderkey) AS block FROM orders) GROUP BY 1")
def seed_blocks(t: Tables) -> DataFrame:
    """Rows cut into seven blocks of equal size in their order."""
    total = t.orders.count()
    numbered = windows.renumber(t.orders.select("o_orderkey"), "k", ["o_orderkey"])
    size, more = divmod(total, 7)
    k, edge = F.col("k") - 1, more * (size + 1)
    block = F.when(k < edge, F.floor(k / (size + 1))).otherwise(more + F.floor((k - edge) / max(size, 1))) + 1
    return numbered.groupBy(block.cast("int").alias("block")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@queries.add("""
    WITH d AS (SELECT p_partkey, p_retailprice, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, dense_rank() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 0) DESC) AS ring FROM part)
    SELECT p_partkey, CAST(k AS INTEGER) AS k, CAST(ring AS INTEGER) AS ring FROM d""")
def ring_numbers(t: Tables) -> DataFrame:
    """Both ways to number rings: each row, and equal rounded spacings together."""
    w = Window.partitionBy("p_brand")
    return t.part.select("p_partkey", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("k"), F.dense_rank().over(w.orderBy(F.desc(F.round("p_retailprice", 0)))).alias("ring"))


@queries.add("""
    WITH s AS (SELECT user_id, sum(value) FILTER (WHERE event_type = 'view') AS on_, sum(value) FILTER (WHERE event_type = 'click') AS off_ FROM events GROUP BY 1)
    SELECT user_id, round(on_ - off_, 6) AS delta, round(sqrt(on_ + off_), 6) AS sigma FROM s""")
def pump_probe(t: Tables) -> DataFrame:
    """Difference of two states and its deviation in quadrature."""
    s = t.events.groupBy("user_id").agg(*[F.sum(F.when(F.col("event_type") == k, F.col("value"))).alias(n) for k, n in (("view", "a"), ("click", "b"))])
    return s.select("user_id", F.round(F.col("a") - F.col("b"), 6).alias("delta"), F.round(F.sqrt(F.col("a") + F.col("b")), 6).alias("sigma"))


@queries.add("""
    WITH g AS (SELECT s.i AS shift, sum(o_totalprice * cos((o_custkey + s.i) * 0.001)) AS score FROM orders, range(0, 50) s(i) GROUP BY 1)
    SELECT max_by(shift, score) AS shift, round(max(score), 2) AS score, max(score) - median(score) < 0.01 * abs(median(score)) AS poor FROM g""")
def grid_search(t: Tables) -> DataFrame:
    """The best of fifty shifts, flagged if hardly better than the median."""
    g = t.orders.select("o_custkey", "o_totalprice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("shift")).groupBy("shift").agg(F.sum(F.col("o_totalprice") * F.cos((F.col("o_custkey") + F.col("shift")) * 0.001)).alias("score"))
    return g.agg(F.max_by("shift", "score").alias("shift"), F.round(F.max("score"), 2).alias("score"), ((F.max("score") - F.median("score")) < 0.01 * F.abs(F.median("score"))).alias("poor"))


@queries.add("""
    WITH u AS (SELECT 1 AS detector, s_suppkey AS id, s_acctbal AS v FROM supplier UNION ALL SELECT 2, c_custkey, c_acctbal FROM customer) SELECT detector, id, row_number() OVER (ORDER BY detector, id) AS number FROM u""")
def joined_detectors(t: Tables) -> DataFrame:
    """Two tables under their labels, renumbered."""
    parts = {1: t.supplier.select(F.col("s_suppkey").alias("id")), 2: t.customer.select(F.col("c_custkey").alias("id"))}
    return sets.concatenated(parts, "detector", ["id"], "number").select("detector", "id", "number")


@queries.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def orphan_rows(t: Tables) -> DataFrame:
    """Observed rows that nothing covers."""
    return sets.orphans(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@queries.add("""
    SELECT k, a.v AS first, b.v AS second FROM (SELECT c_nationkey AS k, count(*) AS v FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS v FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def differing_values(t: Tables) -> DataFrame:
    """Keys whose values differ between two tables, or are missing in one."""
    def of(segment: str) -> DataFrame:
        return t.customer.where(F.col("c_mktsegment") == segment).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))

    return sets.differences(of("BUILDING"), of("MACHINERY"), "k", "v")


@queries.add("""
    SELECT nation, coalesce(a.v, b.v) AS v FROM (SELECT c_nationkey AS nation, count(*) AS v FROM customer WHERE c_acctbal > 9950 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS nation, -count(*) AS v FROM supplier GROUP BY 1) b USING (nation)""")
def earlier_wins(t: Tables) -> DataFrame:
    """Two results by key, the earlier one first."""
    a = t.customer.where("c_acctbal > 9950").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("v"))
    return sets.earlier_wins(a, t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg((-F.count("*")).alias("v")), "nation")


@queries.add("""
    WITH f AS (SELECT *, least(p_size, 51 - p_size) AS a, p_brand AS b FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY p_partkey) AS n FROM f) SELECT p_partkey, p_size FROM r WHERE n = 1""")
def canonical_rows(t: Tables) -> DataFrame:
    """One row of each canonical form."""
    return sets.canonical_unique(t.part.select("p_partkey", "p_size", "p_brand"), [F.least(F.col("p_size"), 51 - F.col("p_size")), F.col("p_brand")], "p_partkey").select("p_partkey", "p_size")


@queries.add("""
    WITH q AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 4) AS w, round(abs(CAST(embedding[2] AS DOUBLE)) * 4) AS x FROM embeddings) SELECT min(vec_id) AS vec_id, count(*) AS n FROM q GROUP BY w, x""")
def quantised_dedup(t: Tables) -> DataFrame:
    """The first row of each quantised bucket."""
    q = t.embeddings.select("vec_id", F.round(F.col("embedding")[0].cast("double") * 4).alias("w"), F.round(F.abs(F.col("embedding")[1].cast("double")) * 4).alias("x"))
    return q.groupBy("w", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "n")


_NEAR = """
    SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE sqrt(pow(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1], 2) + pow(CAST(a.embedding[2] AS DOUBLE) - b.embedding[2], 2)) < 0.02"""


def _near_links(t: Tables) -> DataFrame:
    p = t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return joins.pairs_within(p, "vec_id", ["x", "y"], 0.02, ["label"])


@queries.add(f"""
    WITH RECURSIVE l AS ({_NEAR}), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(n, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n)
    SELECT n AS node, min(c) AS component FROM r GROUP BY n""")
def clusters(t: Tables) -> DataFrame:
    """Connected components of points nearer than a radius."""
    return graph.connected(_near_links(t), "a", "b")


@queries.add(f"""
    WITH RECURSIVE g AS ({_NEAR}), l AS (SELECT b, list(a ORDER BY a) AS low FROM g GROUP BY b), n AS (SELECT label, vec_id, coalesce(low, []) AS low, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings LEFT JOIN l ON b = vec_id),
    w(label, i, vec_id, kept, leader) AS (SELECT DISTINCT label, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM embeddings UNION ALL
        SELECT n.label, n.i, n.vec_id, CASE WHEN list_has_any(w.kept, n.low) THEN w.kept ELSE list_append(w.kept, n.vec_id) END, coalesce(list_min(list_intersect(w.kept, n.low)), n.vec_id) FROM w JOIN n ON n.label = w.label AND n.i = w.i + 1)
    SELECT vec_id, leader FROM w WHERE i > 0""")
def leader_clusters(t: Tables) -> DataFrame:
    """Greedy leaders within each label, by id: one not yet taken takes all later ones near it."""
    return summaries.first_leader(t.embeddings.select("vec_id"), _near_links(t).select("a", "b"), "vec_id", "vec_id")


@queries.add(f"""
    WITH RECURSIVE g AS (SELECT DISTINCT k.label, a, b FROM ({_NEAR}) JOIN embeddings k ON k.vec_id = a), e AS (SELECT label, a AS n, b AS m FROM g UNION SELECT label, b, a FROM g), d AS (SELECT label, n, list(m) AS near, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, n) AS i FROM e GROUP BY label, n),
    w(label, i, taken, mine, anchor) AS (SELECT DISTINCT label, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM d UNION ALL
        SELECT d.label, d.i, CASE WHEN list_contains(w.taken, d.n) THEN w.taken ELSE list_concat(w.taken, [x FOR x IN list_append(d.near, d.n) IF NOT list_contains(w.taken, x)]) END, CASE WHEN list_contains(w.taken, d.n) THEN [] ELSE [x FOR x IN list_append(d.near, d.n) IF NOT list_contains(w.taken, x)] END, d.n FROM w JOIN d ON d.label = w.label AND d.i = w.i + 1)
    SELECT label, unnest(mine) AS node, anchor AS family FROM w""")
def anchor_families(t: Tables) -> DataFrame:
    """Families of an anchor and its direct neighbours."""
    return graph.anchor_families(_near_links(t).select("label", "a", "b"), "label", "a", "b")


_GRID = "SELECT DISTINCT CAST(l_orderkey // 4 % 60 AS BIGINT) AS y, CAST(l_partkey % 60 AS BIGINT) AS x, CAST((l_orderkey // 4 % 60) * 60 + l_partkey % 60 AS BIGINT) AS id FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.05"


def _grid(t: Tables) -> DataFrame:
    y, x = F.floor(F.col("l_orderkey") / 4) % 60, F.col("l_partkey") % 60
    return t.lineitem.where("l_quantity > 49 AND l_tax > 0.05").select(y.alias("y"), x.alias("x"), (y * 60 + x).alias("id"), F.lit(1).alias("g")).distinct()


@queries.add(f"""
    WITH RECURSIVE c AS ({_GRID}), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), r(n, k) AS (SELECT id, id FROM c UNION SELECT e.b, r.k FROM r JOIN e ON e.a = r.n),
    m AS (SELECT n, min(k) AS k FROM r GROUP BY n), s AS (SELECT k FROM m GROUP BY k HAVING count(*) >= 3) SELECT n AS id FROM m WHERE k IN (SELECT k FROM s)""")
def large_blobs(t: Tables) -> DataFrame:
    """Cells in 8-connected components of at least three."""
    return graph.drop_small(_grid(t), ["g"], "id", "y", "x", 3).select("id")


@queries.add("""
    WITH c AS (SELECT CAST(l_orderkey // 4 % 40 AS BIGINT) AS y, CAST(l_partkey % 40 AS BIGINT) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    m AS (SELECT a.y, a.x, a.v FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.v > a.v)) SELECT y, x, v FROM (SELECT *, row_number() OVER (ORDER BY v DESC, y * 40 + x) AS n FROM m) WHERE n <= 20""")
def regional_maxima(t: Tables) -> DataFrame:
    """Cells with no higher 8-neighbour, the brightest twenty."""
    y, x = F.floor(F.col("l_orderkey") / 4) % 40, F.col("l_partkey") % 40
    c = t.lineitem.groupBy(y.alias("y"), x.alias("x")).agg(F.sum("l_quantity").alias("v")).withColumns({"g": F.lit(1), "id": F.col("y") * 40 + F.col("x")})
    return graph.regional_maxima(c, ["g"], "y", "x", "v", 20, "id").select("y", "x", "v")


@queries.add()
def cleaned_voxels(t: Tables) -> DataFrame:
    """Voxels with no neighbour of their own label take the label around them."""
    y, x = F.floor(F.col("l_orderkey") / 4) % 30, F.col("l_partkey") % 30
    v = t.lineitem.groupBy(y.alias("y"), x.alias("x")).agg((F.count("*") % 3).alias("label"))
    return graph.clean_voxels(v, "y", "x", "label", 0, 5)
