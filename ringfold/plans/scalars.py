"""Queries that show filters, rules and the scalar functions on the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.functions import geometry, rotations, tensors
from ringfold.operators import checks
from ringfold.plans.registry import Registry, Tables

queries = Registry()


@queries.add("""
    SELECT o_orderkey, CASE WHEN k THEN o_totalprice ELSE 0 END AS o_totalprice, CASE WHEN k THEN o_custkey ELSE 0 END AS o_custkey FROM
    (SELECT *, o_totalprice > 1000 AND ((o_totalprice BETWEEN 20000 AND 90000 AND o_custkey < 700) OR (o_totalprice BETWEEN 150000 AND 250000 AND o_custkey > 300)) AS k FROM orders)""")
def boxed_or_zero(t: Tables) -> DataFrame:
    """Rows outside all boxes stay with zeros, except for their id."""
    boxes = [F.col("o_totalprice").between(20000, 90000) & (F.col("o_custkey") < 700), F.col("o_totalprice").between(150000, 250000) & (F.col("o_custkey") > 300)]
    return checks.kept_or_zero(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), (F.col("o_totalprice") > 1000) & checks.any_of(boxes), ["o_totalprice", "o_custkey"])


@queries.add("""
    SELECT l_orderkey AS id, 'quantity is positive' AS rule FROM lineitem WHERE NOT l_quantity > 2 UNION ALL SELECT l_orderkey, 'discount in range' FROM lineitem WHERE NOT l_discount BETWEEN 0.01 AND 0.09
    UNION ALL SELECT l_orderkey, 'price fits quantity' FROM lineitem WHERE NOT l_extendedprice > 1000 * l_quantity""")
def rule_violations(t: Tables) -> DataFrame:
    """One row for each rule that a row breaks (parameter validation)."""
    rules = {"quantity is positive": F.col("l_quantity") > 2, "discount in range": F.col("l_discount").between(0.01, 0.09), "price fits quantity": F.col("l_extendedprice") > 1000 * F.col("l_quantity")}
    return checks.violations(t.lineitem.withColumnRenamed("l_orderkey", "id"), "id", rules)


@queries.add("""
    SELECT p_partkey, CASE h WHEN 3 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END AS tier FROM (SELECT p_partkey, (p_size > 10)::INT + (p_retailprice > 1100)::INT + (p_partkey % 5 > 0)::INT AS h FROM part)""")
def trust_tiers(t: Tables) -> DataFrame:
    """Gold, silver and bronze by how many gates hold."""
    return t.part.select("p_partkey", checks.tiers([F.col("p_size") > 10, F.col("p_retailprice") > 1100, F.col("p_partkey") % 5 > 0]).alias("tier"))


@queries.add("""
    WITH c AS (SELECT *, round(l_partkey / 50.0) AS r, round(l_suppkey / 10.0) AS k FROM lineitem), b AS (SELECT r, k FROM c GROUP BY 1, 2 HAVING count(*) >= 140 AND max(l_orderkey) - min(l_orderkey) >= 14000)
    SELECT l_returnflag, count(*) AS n FROM c JOIN b USING (r, k) GROUP BY 1""")
def fixed_places(t: Tables) -> DataFrame:
    """Rows in crowded cells that span most of the order (fixed-pixel artefacts)."""
    scaled = t.lineitem.select("l_returnflag", "l_orderkey", (F.col("l_partkey") / 50.0).alias("r"), (F.col("l_suppkey") / 10.0).alias("k"))
    return checks.fixed_places(scaled, "r", "k", "l_orderkey", 1.0, 140, 14000).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@queries.add()
def quality_gate(t: Tables) -> DataFrame:
    """Rows above the crossing of two clear modes, all rows where there aren't two."""
    return checks.quality_gate(t.events.select("event_id", "value"), "value")


_Q = "[" + ", ".join(f"CAST(embedding[{k}] AS DOUBLE)" for k in (1, 2, 3, 4)) + "]"
_TURNED = """
    WITH q AS (SELECT vec_id, label, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS q FROM (SELECT vec_id, label, """ + _Q + """ AS e FROM embeddings)),
    f AS (SELECT label, arg_min(q, vec_id) AS p FROM q GROUP BY 1),
    t AS (SELECT vec_id, p[1]*q[1]+p[2]*q[2]+p[3]*q[3]+p[4]*q[4] AS a, p[1]*q[2]-p[2]*q[1]-p[3]*q[4]+p[4]*q[3] AS b, p[1]*q[3]+p[2]*q[4]-p[3]*q[1]-p[4]*q[2] AS c, p[1]*q[4]-p[2]*q[3]+p[3]*q[2]-p[4]*q[1] AS d FROM q JOIN f USING (label))"""
_SYMMETRY = ", ".join("({})".format(", ".join(f"CAST({x} AS DOUBLE)" for x in q)) for q in rotations.symmetry("m-3m"))


def _quaternions(t: Tables) -> DataFrame:
    q = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    # a vector without length has no direction, and no angle
    unit = t.embeddings.select("vec_id", "label", q.alias("e")).withColumn("q", F.transform("e", lambda x: F.try_divide(x, F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, y: a + y * y)))))
    return unit.select("vec_id", "label", "q")


@queries.add(_TURNED + f""", s(w, x, y, z) AS (VALUES {_SYMMETRY})
    SELECT vec_id, round(degrees(2 * acos(least(max(abs(a * w + b * x + c * y + d * z)), 1.0))), 4) AS angle FROM t, s GROUP BY vec_id, a, b, c, d HAVING max(abs(a * w + b * x + c * y + d * z)) < 0.9999999""")
def misorientations(t: Tables) -> DataFrame:
    """Smallest cubic angle of each orientation to the first of its label."""
    q = _quaternions(t)
    first = q.groupBy("label").agg(F.min_by("q", "vec_id").alias("p"))
    # no lambda on the pair: Spark pushes a filter that holds one below the join, where the other side's column isn't
    angle = rotations.misorientation(F.col("p"), F.col("q"), "m-3m")
    turned = rotations.multiply(rotations.conjugate(F.col("p")), F.col("q"))
    cosine = rotations.nearness([rotations.at(turned, k) for k in range(4)], "m-3m")
    return q.join(first, "label").where(cosine < 0.9999999).select("vec_id", F.round(angle, 4).alias("angle"))


@queries.add(f"""
    WITH q AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS q FROM (SELECT vec_id, {_Q} AS e FROM embeddings))
    SELECT vec_id, round(1 - 2 * (q[3] * q[3] + q[4] * q[4]), 8) AS m11, round(2 * (q[2] * q[3] - q[1] * q[4]), 8) AS m12, round(2 * (q[2] * q[4] + q[1] * q[3]), 8) AS m13,
        round(degrees(2 * atan2(sqrt(q[2] * q[2] + q[3] * q[3] + q[4] * q[4]), abs(q[1]))), 6) AS turn, round(abs(q[1]), 8) AS back FROM q""")
def rotation_forms(t: Tables) -> DataFrame:
    """Matrix, angle, and the way back through the matrix."""
    q = _quaternions(t).withColumn("m", rotations.to_matrix(F.col("q")))
    return q.select("vec_id", *[F.round(F.col("m")[k], 8).alias(f"m1{k + 1}") for k in range(3)], F.round(rotations.axis_angle(F.col("q"))[3], 6).alias("turn"), F.round(rotations.from_matrix(F.col("m"))[0], 8).alias("back"))


@queries.add()
def fundamental_zone(t: Tables) -> DataFrame:
    """Orientations in the cubic fundamental zone, with Euler angles."""
    q = _quaternions(t).withColumn("f", rotations.fundamental(F.col("q"), "m-3m"))
    return q.select("vec_id", *[F.round(F.col("f")[k], 6).alias(n) for k, n in enumerate("wxyz")], *[F.round(rotations.to_euler(F.col("f"))[k], 6).alias(n) for k, n in enumerate(("phi1", "Phi", "phi2"))])


@queries.add("""
    SELECT p_partkey, round(degrees(atan2(-y, z)), 6) AS eta, round(degrees(atan2(r, 1000.0)), 8) AS two_theta, round(4 * pi() * sin(atan2(r, 1000.0) / 2) / 0.18, 8) AS q,
        round(0.99 * (1 - pow(sin(atan2(r, 1000.0)) * sin(atan2(-y, z)), 2)) + 0.01 * (1 - pow(sin(atan2(r, 1000.0)) * cos(atan2(-y, z)), 2)), 8) AS polarisation, round(pow(cos(atan2(r, 1000.0)), 3), 8) AS solid_angle
    FROM (SELECT *, sqrt(y * y + z * z) AS r FROM (SELECT p_partkey, p_size - 25.5 AS y, p_retailprice - 1000.25 AS z FROM part))""")
def detector_geometry(t: Tables) -> DataFrame:
    """Azimuth, scattering angle and vector, polarisation and solid angle of detector places."""
    d = t.part.select("p_partkey", (F.col("p_size") - 25.5).alias("y"), (F.col("p_retailprice") - 1000.25).alias("z")).withColumn("r", F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    d = d.withColumns({"e": geometry.eta("y", "z"), "t": geometry.two_theta("r", 1000.0)})
    return d.select("p_partkey", F.round("e", 6).alias("eta"), F.round("t", 8).alias("two_theta"), F.round(geometry.q_of_two_theta("t", 0.18), 8).alias("q"), F.round(geometry.polarisation("t", "e"), 8).alias("polarisation"), F.round(geometry.solid_angle("t"), 8).alias("solid_angle"))


@queries.add("""
    SELECT h, k, l, round(4.05 / sqrt(h * h + k * k + l * l), 8) AS d, round(degrees(asin(0.18 / (2 * 4.05 / sqrt(h * h + k * k + l * l)))), 8) AS theta, CAST(dense_rank() OVER (ORDER BY h * h + k * k + l * l) AS INTEGER) AS ring
    FROM (SELECT a.i AS h, b.i AS k, c.i AS l FROM range(0, 6) a(i), range(0, 6) b(i), range(0, 6) c(i)) WHERE h + k + l > 0 AND h >= k AND k >= l AND (h % 2 = k % 2 AND k % 2 = l % 2)""")
def reflections(t: Tables) -> DataFrame:
    """Allowed reflections of a face-centred cubic cell: spacings, Bragg angles, ring numbers."""
    from pyspark.sql import Window

    n = t.spark.range(6)
    hkl = n.withColumnRenamed("id", "h").crossJoin(n.withColumnRenamed("id", "k")).crossJoin(n.withColumnRenamed("id", "l")).where("h + k + l > 0 AND h >= k AND k >= l AND h % 2 = k % 2 AND k % 2 = l % 2")
    a, right = F.lit(4.05), F.lit(90.0)
    d = tensors.d_spacing(F.col("h").cast("double"), F.col("k").cast("double"), F.col("l").cast("double"), a, a, a, right, right, right)
    return hkl.select("h", "k", "l", F.round(d, 8).alias("d"), F.round(geometry.bragg_theta(d, 0.18), 8).alias("theta"), F.dense_rank().over(Window.orderBy(F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l"))).alias("ring"))


@queries.add("""
    WITH s AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 7)] AS s FROM embeddings)
    SELECT vec_id, round((s[1] + s[2] + s[3]) / 3, 8) AS hydrostatic, round(sqrt((pow(s[1] - s[2], 2) + pow(s[2] - s[3], 2) + pow(s[3] - s[1], 2)) / 2 + 3 * (s[4] * s[4] + s[5] * s[5] + s[6] * s[6])), 8) AS von_mises,
        round(168 * s[1] + 121 * (s[2] + s[3]), 6) AS stress11, round(150 * s[4], 6) AS stress23 FROM s""")
def stress_measures(t: Tables) -> DataFrame:
    """Hydrostatic and equivalent stress, and Hooke's law, on six-part tensors."""
    v = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("s"))
    s = tensors.hooke(F.col("s"), 168.0, 121.0, 75.0)
    return v.select("vec_id", F.round(tensors.hydrostatic(F.col("s")), 8).alias("hydrostatic"), F.round(tensors.von_mises(F.col("s")), 8).alias("von_mises"), F.round(s[0], 6).alias("stress11"), F.round(s[3], 6).alias("stress23"))


def _schmid_sql() -> str:
    parts = [f"abs(({'+'.join(f'{n[k]}*v[{k + 1}]' for k in range(3))}) * ({'+'.join(f'{b[k]}*v[{k + 1}]' for k in range(3))}))" for n, b in tensors.slip_systems("fcc")]
    return f"SELECT vec_id, round(greatest({', '.join(parts)}) / ((v[1]*v[1]+v[2]*v[2]+v[3]*v[3]) * sqrt(6.0)), 8) AS schmid FROM (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 4)] AS v FROM embeddings)"


@queries.add(_schmid_sql())
def largest_schmid(t: Tables) -> DataFrame:
    """The largest Schmid factor of twelve slip systems."""
    v = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", F.round(F.array_max(tensors.schmid_factors(F.col("v"))), 8).alias("schmid"))


@queries.add("""
    WITH r AS (SELECT i * 0.1 AS r FROM range(1, 61) t(i)), s AS (SELECT CAST(p_size AS DOUBLE) / 5 AS q, avg(p_retailprice) / 1300 AS s FROM part GROUP BY 1)
    SELECT round(r, 2) AS r, round(sum(q * (s - 1) * sin(q * r)) * 2 / pi() * 0.2, 6) AS g FROM r, s GROUP BY r""")
def pair_distribution(t: Tables) -> DataFrame:
    """Sine transform of a structure factor on a grid of distances."""
    s = t.part.groupBy((F.col("p_size").cast("double") / 5).alias("q")).agg((F.avg("p_retailprice") / 1300).alias("s"))
    grid = s.select("q", "s", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("i")).withColumn("r", F.col("i") * 0.1)
    return grid.groupBy("r").agg(F.round(F.sum(F.col("q") * (F.col("s") - 1) * F.sin(F.col("q") * F.col("r"))) * 2 / F.pi() * 0.2, 6).alias("g")).select(F.round("r", 2).alias("r"), "g")


@queries.add("""
    SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, sha256(concat(event_type, '=', CAST(user_id AS VARCHAR))) AS digest, lpad(CAST(user_id AS VARCHAR), 6, '0') AS padded, regexp_extract(props, '[0-9]+', 0) AS number FROM events""")
def text_scalars(t: Tables) -> DataFrame:
    """Digests, paddings, patterns and JSON fields."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.sha2(F.concat("event_type", F.lit("="), F.col("user_id").cast("string")), 256).alias("digest"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("padded"), F.regexp_extract("props", "[0-9]+", 0).alias("number"))


@queries.add("""
    SELECT c_custkey, CAST(CASE (c_custkey % 4) WHEN 0 THEN y WHEN 1 THEN 39 - y WHEN 2 THEN y ELSE z END AS BIGINT) AS y2, CAST(CASE (c_custkey % 4) WHEN 0 THEN z WHEN 1 THEN z WHEN 2 THEN 49 - z ELSE y END AS BIGINT) AS z2
    FROM (SELECT c_custkey, c_custkey % 40 AS y, c_custkey % 50 AS z FROM customer)""")
def flipped_pixels(t: Tables) -> DataFrame:
    """Pixel places after image operations."""
    y, z, op = F.col("c_custkey") % 40, F.col("c_custkey") % 50, F.col("c_custkey") % 4
    made = [geometry.flip(y, z, 40, 50, [k]) for k in range(4)]
    pick = lambda k: F.coalesce(*[F.when(op == i, m[k]) for i, m in enumerate(made)])
    return t.customer.select("c_custkey", pick(0).alias("y2"), pick(1).alias("z2"))


@queries.add("""
    WITH RECURSIVE d AS (SELECT p_size / 50.0 AS q, avg(p_retailprice) / 100 AS i FROM part GROUP BY 1)
    SELECT round(regr_slope(ln(i), q * q), 8) AS slope, round(regr_intercept(ln(i), q * q), 8) AS intercept, count(*) AS n FROM d""")
def guinier_fit(t: Tables) -> DataFrame:
    """Regression of the logarithm of intensity on the squared vector."""
    d = t.part.groupBy((F.col("p_size") / 50.0).alias("q")).agg((F.avg("p_retailprice") / 100).alias("i"))
    x, y = F.col("q") * F.col("q"), F.log("i")
    return d.agg(F.round(F.regr_slope(y, x), 8).alias("slope"), F.round(F.regr_intercept(y, x), 8).alias("intercept"), F.count("*").alias("n"))
