"""Ways that queries take only on larger tables, on small ones: each against the plain rows."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.test_queries import duck, rows  # noqa: F401

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture
def unbroadcast(spark):
    """No side is small enough for a broadcast, as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def same(spark, duck, name):  # noqa: F811
    df, want = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_misorientations_without_a_broadcast(spark, duck, unbroadcast):  # noqa: F811
    same(spark, duck, "misorientations")


@pytest.mark.parametrize("name", ["orientation_pairs", "seed_clusters", "friedel_candidates", "friedel_matches", "friedel_seeds"])
def test_no_broadcast_gives_the_same(spark, duck, unbroadcast, name):  # noqa: F811
    same(spark, duck, name)


def test_orientation_pairs_meet_few_candidates(spark):
    """The angle comes from the representative in the cell: no lambda, and no sort of pairs, stands above the join."""
    from ringfold.operators import matching

    d = spark.createDataFrame([(k, [1.0, 0.01 * k, 0.0, 0.0]) for k in range(5)], "n long, q array<double>")
    df = matching.orientation_pairs(d, "n", "q", "m-3m", 2.0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.split("MapInPandas")[0] and "Aggregate" not in plan.split("MapInPandas")[0]
    assert {(r.a, r.b) for r in df.collect()} == {(k, k + 1) for k in range(4)}


def test_links_of_a_group_of_copies_shrink_to_a_forest(spark):
    from ringfold.operators.graph import forest

    links = spark.range(60).crossJoin(spark.range(60).withColumnRenamed("id", "y")).withColumnRenamed("id", "x").where("x < y").coalesce(2)
    got = forest(links).collect()
    assert len(got) <= 2 * 59 and {n for r in got for n in (r.x, r.y)} == set(range(60))


@pytest.mark.parametrize("take", [3, 1000])
def test_first_leads_by_heads_are_those_of_the_walk(spark, take):
    from ringfold.operators import joins, matching

    points = [(k, float(k * 37 % 60), float(k * 53 % 41)) for k in range(150)] + [(200 + k, 1000.0 + 100 * k, 0.0) for k in range(20)]
    want, leads = {}, []
    for k, x, y in points:
        near = [n for n, a, b in leads if math.hypot(a - x, b - y) < 9]
        want[k] = min(near, default=k)
        if not near:
            leads.append((k, x, y))
    d = spark.createDataFrame(points, "k long, x double, y double")
    seen = []

    def pairs(rest):
        seen.append(rest.count())
        return joins.pairs_within(rest, "k", ["x", "y"], 9.0)

    got = matching.first_leads(d, "k", ["x", "y"], lambda a, b: matching.gaps(a, b) < 9, pairs, take)
    assert {r.k: r.lead for r in got.collect()} == want
    assert bool(seen) == (take == 3)


def test_antipodal_matches_by_bands_are_those_of_the_walk(spark):
    from ringfold.operators import matching

    spots = [(k, k % 2, float(k * 37 % 360) - 180, math.cos(k * 0.7), math.sin(k * 0.7)) for k in range(160)]
    pairs = []
    for a in spots:
        for b in spots:
            turn, off = abs(abs(a[2] - b[2]) - 180), math.hypot(a[3] + b[3], a[4] + b[4])
            if a[0] < b[0] and a[1] == b[1] and turn < 20 and off < 0.6:
                pairs.append((turn / 20 + off / 0.6, a[0], b[0]))
    used, want = set(), set()
    for _, a, b in sorted(pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    d = spark.createDataFrame(spots, "k long, g long, o double, u double, v double")
    names = ("k", ["g"], "o", "u", "v", 20.0, 0.6)
    assert {(r.a, r.b) for r in matching.antipodal_matches(d, *names).collect()} == want
    assert sorted((r.a, r.b) for r in matching.antipodal_pairs(d, *names).collect()) == sorted((a, b) for _, a, b in pairs)
    assert sorted(r.k for r in matching.antipodal_spots(d, *names).collect()) == sorted({n for _, a, b in pairs for n in (a, b)})


@pytest.mark.parametrize("most", [1, 2])
def test_coverage_by_a_heap_is_that_of_the_plain_rounds(spark, most):
    from ringfold.operators import aggregates

    claims = [(g, (i * 7 + g) % 13, (i * i + 3 * g) % 31) for g in range(2) for i in range(120)]
    want = []
    for g in range(2):
        sets, seen = {}, {}
        for _, o, i in (c for c in claims if c[0] == g):
            sets.setdefault(o, set()).add(i)
        while sets:
            gains = {o: sum(seen.get(i, 0) < most for i in s) for o, s in sets.items()}
            best = min(gains, key=lambda o: (-gains[o], o))
            if gains[best] < 1:
                break
            for i in sets.pop(best):
                seen[i] = seen.get(i, 0) + 1
            want.append((g, best, gains[best]))
    got = aggregates.coverage_budget(spark.createDataFrame(claims, "g long, o long, i long"), "g", "o", "i", most, 1)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lonely_rows_search_by_cells_without_a_broadcast_of_them(spark):
    """Rows beside others in a small cell, at the reach itself, without a place, and beside themselves only."""
    import numpy as np

    from ringfold.operators import matching

    rng = np.random.default_rng(7)
    a = [(k, *map(float, rng.integers(0, 60, 3))) for k in range(120)] + [(500, 100.0, 0.0, 0.0), (501, 200.0, 0.0, 0.0), (502, None, 0.0, 0.0), (503, math.nan, 0.0, 0.0)]
    b = [(1000 + k, *map(float, rng.integers(0, 60, 3))) for k in range(60)] + [(1100, 110.0, 0.0, 0.0), (501, 200.0, 0.0, 0.0)]
    near = {p[0] for p in a for q in b if p[0] != q[0] and p[1] is not None and math.dist(p[1:], q[1:]) < 10.0}
    schema = "k long, x double, y double, z double"
    df = matching.lonely(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumnRenamed("k", "o"), "k", "o", ["x", "y", "z"], 10.0)
    assert {r.k for r in df.collect()} == {p[0] for p in a} - near and len(near) > 20
    g = QUERIES["unmatched_grains"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in g and "strategy=merge" in g


def test_nearest_others_by_growing_reach_are_those_of_all_pairs(spark):
    import numpy as np

    from ringfold.operators import matching

    rng = np.random.default_rng(8)
    p = [(k, k % 2, *map(float, rng.integers(0, 40, 2)), k * 10) for k in range(200)] + [(300, 0, 1.0, 1.0, 7), (301, 0, 1.0, 1.0, 8), (302, 0, None, 1.0, 9), (303, 0, 900.0, 0.0, 1), (304, 0, 916.0, 0.0, 2)]
    want = []
    for a in p:
        near = sorted((math.dist(a[2:4], b[2:4]), b[0]) for b in p if a[0] != b[0] and a[1] == b[1] and None not in (a[2], b[2]) and 0 < math.dist(a[2:4], b[2:4]) < 16.0)
        want += [(a[0], o, d, i + 1) for i, (d, o) in enumerate(near[:4])]
    df = matching.nearest_others(spark.createDataFrame(p, "k long, g int, x double, y double, c long"), "k", ["x", "y"], 16.0, 4, ["g"], ["c"])
    got = df.collect()
    assert sorted((r.k, r.neighbour, r.distance, r["rank"]) for r in got) == sorted(want)
    value = {r[0]: r[4] for r in p}
    assert all(r.a_c == value[r.k] and r.b_c == value[r.neighbour] for r in got)


def test_state_costs_and_cheapest_by_blocks_are_those_of_all_pairs(spark):
    import numpy as np

    from ringfold.operators import matching

    rng = np.random.default_rng(9)
    rows = [(k, *map(float, rng.integers(0, 50, 3)), [float(v) for v in (lambda q: q / np.linalg.norm(q))(np.array([1.0, *rng.uniform(-0.3, 0.3, 3)]))], float(rng.integers(1, 9))) for k in range(160)] + [(400, None, 0.0, 0.0, [1.0, 0.0, 0.0, 0.0], 1.0)]
    d = spark.createDataFrame(rows, "k long, x double, y double, z double, q array<double>, s double")
    one, two = d.where("k % 2 = 0").withColumnRenamed("k", "one"), d.where("k % 2 = 1").withColumnRenamed("k", "two")
    costs = matching.state_costs(one, two, "one", "two", ["x", "y", "z"], "q", "s", "m-3m", 20.0, "combined", (2.0, 10.0), 60.0, 5.0)
    want = {}
    for a in rows[:-1:2]:
        for b in rows[1:-1:2]:
            gap = math.dist(a[1:4], b[1:4])
            if gap < 20 and abs(a[5] - b[5]) <= 0.6 * a[5]:
                angle = float(matching.misoriented(np.array([a[4]]), np.array([b[4]]), "m-3m")[0, 0])
                want[a[0], b[0]] = (round(abs(angle - 5) / 2 + gap / 10, 9), round(angle, 9), round(gap, 9))
    assert {(r.one, r.two): (round(r.cost, 9), round(r.angle, 9), round(r.distance, 9)) for r in costs.collect()} == want
    best = matching.cheapest_states(one, two, "one", "two", ["x", "y", "z"], "q", "s", "m-3m", 20.0, (2.0, 10.0), 60.0, 5.0).collect()
    assert len(best) == len({b for _, b in want}) and all(round(r.cost, 9) == min(c for (_, b), (c, _, _) in want.items() if b == r.two) for r in best)
    # both modes come from one pass over the pairs
    assert QUERIES["state_cost_modes"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_pair_histogram_counts_without_a_table_of_pairs(spark):
    import numpy as np

    from ringfold.operators import summaries

    rng = np.random.default_rng(10)
    p = [(k, *map(float, rng.integers(-30, 40, 2))) for k in range(300)] + [(5, 1.0, 1.0), (900, None, 0.0), (None, 1.0, 1.0)]
    want: dict = {}
    for a in p:
        for b in p:
            if None not in a and None not in b and a[0] < b[0] and (gap := math.dist(a[1:], b[1:])) < 17.0:
                want[int(gap / 5)] = want.get(int(gap / 5), 0) + 1
    df = summaries.pair_histogram(spark.createDataFrame(p, "k long, x double, y double"), "k", ["x", "y"], 17.0, 5.0)
    assert {r.bin: r.n for r in df.collect()} == want
    assert "a_x" not in df._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]


@pytest.mark.parametrize("most", [0, 20_000])
def test_associated_takes_the_first_of_equal_predictions(spark, monkeypatch, most):
    """Predictions repeat: only the first of a place is indexed; broadcast or not, it is the nearest of all that wins."""
    from ringfold.operators import matching

    monkeypatch.setattr(matching, "BROADCAST_PLACES", most)
    s = [(k, k % 2, float(k * 37 % 360) - 180, float(k * 91 % 360) - 180) for k in range(200)]
    p = [(k, k % 2, float(k % 60 * 53 % 360) - 179.5, float(k % 60 * 71 % 360) - 179.0) for k in range(600)]
    turn = lambda x: abs(180 - (180 - x) % 360)
    want = set()
    for spot, ring, o, e in s:
        near = min(((turn(o - q) ** 2 + turn(e - f) ** 2, k, turn(o - q), turn(e - f)) for k, r, q, f in p if r == ring))
        if near[2] <= 12 and near[3] <= 5:
            want.add((spot, near[1]))
    df = matching.associated(spark.createDataFrame(s, "spot long, ring int, o double, e double"), spark.createDataFrame(p, "k long, ring int, o double, e double"), "spot", "k", "ring", "o", "e", 12.0, 5.0)
    assert {(r.spot, r.k) for r in df.collect()} == want and want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan if most else "strategy=merge" in plan


def test_claimed_nearest_by_growing_reach_is_that_of_all_pairs(spark):
    import numpy as np

    from ringfold.operators import matching

    rng = np.random.default_rng(11)
    a = [(k, *map(float, rng.integers(0, 90, 2))) for k in range(150)] + [(500, None, 1.0), (501, 300.0, 300.0), (502, 400.0, 400.0)]
    b = [(k, *map(float, rng.integers(0, 90, 2))) for k in range(70)] + [(90, 309.0, 319.0), (91, 410.0, 400.0)]
    want = {}
    for k, x, y in a:
        near = [(((u - x) / 10) ** 2 + ((v - y) / 20) ** 2, n) for n, u, v in b if x is not None and abs(u - x) < 10 and abs(v - y) < 20]
        if near:
            want[k] = (min(near)[1], round(min(near)[0], 9))
    schema = "long, x double, y double"
    got = matching.claimed_nearest(spark.createDataFrame(a, f"k {schema}"), spark.createDataFrame(b, f"s {schema}"), "k", "s", {"x": 10.0, "y": 20.0}).collect()
    assert {r.k: (r.s, round(r.d, 9)) for r in got} == want and want[501][0] == 90 and 502 not in want


def test_pairs_within_broadcast_no_side(spark):
    """A row of one side stands in nine cells, which statistics don't tell."""
    plan = QUERIES["clusters"](spark, SMALL)
    assert plan.count() >= 0
    from ringfold.operators import joins

    d = spark.createDataFrame([(k, float(k), 0.0) for k in range(9)], "k long, x double, y double")
    near = joins.pairs_within(d, "k", ["x", "y"], 1.5)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 8


@pytest.mark.parametrize("name", ["friedel_candidates", "friedel_seeds", "friedel_matches"])
def test_antipodal_sides_are_never_broadcast(spark, monkeypatch, name):
    """A row stands in up to eight cells, which statistics don't tell: on small tables, too, no plan that runs broadcasts a side."""
    from ringfold.operators import matching

    plans, settle = [], matching.settle
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "settle", lambda df: plans.append(plan(df)) or settle(df))
    plans.append(plan(QUERIES[name](spark, SMALL)))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("most", [2, 100_000])
def test_orientation_components_are_those_of_all_pairs(spark, monkeypatch, most):
    """By a growing angle or at once: copies of one orientation are one node, and no pair of copies is made."""
    import numpy as np

    from ringfold.operators import matching

    monkeypatch.setattr(matching, "PAIRED_ROWS", most)
    rng = np.random.default_rng(12)
    quats = np.concatenate([c + rng.normal(0, 0.012, (25, 4)) for c in rng.normal(0, 1, (5, 4))])
    quats = np.concatenate([quats / np.linalg.norm(quats, axis=1, keepdims=True), [[1.0, 0.0, 0.0, 0.0], [math.nan, 0.0, 0.0, 0.0]]])[[*range(127), *range(0, 125, 3), 125, 125]]
    near, up = matching.misoriented(quats, quats, "m-3m") < 3, list(range(len(quats)))
    for _ in up:
        up = [min([up[k], *(up[j] for j in np.flatnonzero(near[k]))]) for k in range(len(up))]
    seen, pairs = [], matching.orientation_pairs
    monkeypatch.setattr(matching, "orientation_pairs", lambda df, *a: (seen.append(df.count()), pairs(df, *a))[1])
    d = spark.createDataFrame([(k, [float(x) for x in q]) for k, q in enumerate(quats)], "n long, q array<double>")
    got = matching.orientation_components(d, "n", "q", "m-3m", 3.0).collect()
    assert {r.node: r.component for r in got} == {k: c for k, c in enumerate(up) if k != 126} and len(got) == len(quats) - 1
    assert set(seen) == {126} and (len(seen) > 1) == (most == 2) and len(set(up)) > 5
