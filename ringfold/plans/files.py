"""Queries that write the legacy files from the common tables and read them back.

The SQL is that of the rows that went in, so a row that a format loses, reorders or rounds
beyond its own precision shows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.plans.registry import Registry, Tables
from ringfold.plans.synthetic import GRAINS_SQL, SPOTS_SQL, folder, grains, rounded, spots
from ringfold.sources import binaries, tables

queries = Registry()


def _layout(layout: str) -> list[str]:
    return [x.removesuffix(":i") for x in layout.split()]


def _filled(df: DataFrame, layout: str, given: dict[str, str]) -> DataFrame:
    """The layout's columns: those given as SQL, the others from the row's number so that no two are alike."""
    return df.selectExpr(*[f"{given[n]} AS {n}" if n in given else f"CAST(spot % 101 + {k} AS DOUBLE) / 8 AS {n}" for k, n in enumerate(_layout(layout))])


def _filled_sql(layout: str, given: dict[str, str], source: str = SPOTS_SQL) -> str:
    cells = ", ".join(f"{given[n]} AS {n}" if n in given else f"CAST(spot % 101 + {k} AS DOUBLE) / 8 AS {n}" for k, n in enumerate(_layout(layout)))
    return f"SELECT {cells} FROM {source}"


_RESULT = {"SpotID": "spot", "IntegratedIntensity": "ii", "Omega": "omega", "Eta": "eta", "maskTouched": "spot % 2", "ReturnCode": "CASE WHEN spot % 5 = 0 THEN NULL ELSE spot % 3 END"}
_RADIUS = _RESULT | {"RingNr": "ring", "OrigSpotID": "CASE WHEN spot % 7 = 0 THEN NULL ELSE spot + 1 END"}
_INPUTALL = {"SpotID": "spot", "RingNumber": "ring", "Omega": "omega", "Eta": "eta", "DetID": "spot % 4 + 1"}
_EXTRA = _INPUTALL | {"maskTouched": "spot % 2", "OrigSpotID": "CASE WHEN spot % 7 = 0 THEN NULL ELSE spot + 1 END", "ReturnCode": "CASE WHEN spot % 5 = 0 THEN NULL ELSE spot % 3 END"}


def _round_trip(t: Tables, name: str, layout: str, given: dict[str, str]) -> DataFrame:
    path = f"{folder(t.spark, name)}/{name}.csv"
    tables.write_table(_filled(spots(t), layout, given), path, layout, header=(" ".join(_layout(layout)),), order=["SpotID"])
    back = tables.read_table(t.spark, path, layout, header=True)
    return rounded(back)


def _rounded_sql(layout: str, given: dict[str, str]) -> str:
    cells = ", ".join(x.removesuffix(":i") if x.endswith(":i") else f"round({x}, 6) AS {x}" for x in layout.split())
    return f"SELECT {cells} FROM ({_filled_sql(layout, given)})"


@queries.add(_rounded_sql(tables.RESULT, _RESULT))
def result_file(t: Tables) -> DataFrame:
    """The merged spot table as a text file of 18 columns, an unknown return code as -1."""
    return _round_trip(t, "result", tables.RESULT, _RESULT)


@queries.add(_rounded_sql(tables.RADIUS, _RADIUS))
def radius_file(t: Tables) -> DataFrame:
    """The table of spot radii, 26 columns."""
    return _round_trip(t, "radius", tables.RADIUS, _RADIUS)


@queries.add(_rounded_sql(tables.INPUTALL, _INPUTALL))
def input_file(t: Tables) -> DataFrame:
    """The indexer's input with a detector's number."""
    return _round_trip(t, "input", tables.INPUTALL, _INPUTALL)


_WIDTHS = [18, 19, 20, 21]


@queries.add("SELECT *, 18 AS width FROM (" + _rounded_sql(tables.INPUTALL_EXTRA, _EXTRA).replace(f"FROM {SPOTS_SQL}", f"FROM (SELECT * FROM {SPOTS_SQL} WHERE spot % 4 = 0)") + ") WHERE FALSE UNION ALL "
             + " UNION ALL ".join(f"SELECT * REPLACE ({'NULL' if w < 20 else 'OrigSpotID'} AS OrigSpotID, {'NULL' if w < 20 else 'ReturnCode'} AS ReturnCode), {w} AS width FROM (" + _rounded_sql(tables.INPUTALL_EXTRA, _EXTRA).replace(f"FROM {SPOTS_SQL}", f"FROM (SELECT * FROM {SPOTS_SQL} WHERE spot % 4 = {k})") + ")" for k, w in enumerate(_WIDTHS)))
def extra_input_files(t: Tables) -> DataFrame:
    """The same with 18 to 21 columns, told apart by their width: two more at the end, and a detector's number after either."""
    out = None
    for k, width in enumerate(_WIDTHS):
        path = f"{folder(t.spark, 'extra')}/extra.csv"
        names = _layout(tables.INPUTALL_EXTRA)[: 20 if width >= 20 else 18]
        df = _filled(spots(t).where(F.col("spot") % 4 == k), tables.INPUTALL_EXTRA, _EXTRA).select(*names)
        layout = " ".join(x for x in tables.INPUTALL_EXTRA.split() if x.removesuffix(":i") in names)
        if width % 2:
            df, layout = df.withColumn("DetID", F.lit(2)), layout + " DetID:i"
        tables.write_table(df, path, layout, header=(" ".join(df.columns),), order=["SpotID"])
        back = rounded(tables.read_extra(t.spark, path)).withColumn("width", F.lit(width))
        out = back if out is None else out.unionByName(back)
    return out.drop("DetID")


@queries.add("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS seq, o_orderkey AS SpotID FROM orders WHERE o_custkey % 5 = 2")
def seed_file(t: Tables) -> DataFrame:
    """The list of seeds, whose order counts."""
    path = f"{folder(t.spark, 'seeds')}/seeds.csv"
    chosen = t.orders.where("o_custkey % 5 = 2").orderBy(F.desc("o_totalprice"), "o_orderkey")
    tables.write_lines(chosen.select(F.col("o_orderkey").cast("string").alias("value")), path)
    return tables.read_seed_ids(t.spark, path)


_HKLS_SQL = "SELECT CAST(a.i AS BIGINT) AS h, CAST(b.i AS BIGINT) AS k, CAST(c.i AS BIGINT) AS l FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i) WHERE NOT (a.i = 0 AND b.i = 0 AND c.i = 0)"


@queries.add(f"SELECT h, k, l, round(4.0 / sqrt(h * h + k * k + l * l), 6) AS DSpacing, h * h + k * k + l * l AS RingNr, round(CAST(h AS DOUBLE) / 4, 6) AS g1, round(CAST(k AS DOUBLE) / 4, 6) AS g2, round(CAST(l AS DOUBLE) / 4, 6) AS g3 FROM ({_HKLS_SQL})")
def reflection_file(t: Tables) -> DataFrame:
    """The list of reflections, its Bragg angles in degrees on disk and radians inside."""
    path = f"{folder(t.spark, 'hkls')}/hkls.csv"
    axis = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    hkl = t.spark.range(1).select(axis.alias("h")).select("h", axis.alias("k")).select("h", "k", axis.alias("l")).where("h <> 0 OR k <> 0 OR l <> 0")
    n = F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l")
    d = F.lit(4.0) / F.sqrt(n)
    theta = F.degrees(F.asin(F.lit(0.2) / (2 * d)))
    full = hkl.select("h", "k", "l", d.alias("DSpacing"), n.alias("RingNr"), *[(F.col(c) / 4.0).alias(g) for c, g in zip("hkl", ("g1", "g2", "g3"), strict=True)], theta.alias("Theta"), (2 * theta).alias("TwoTheta"), F.tan(F.radians(2 * theta)).alias("Radius"))
    tables.write_table(full, path, tables.HKLS, 9, (" ".join(_layout(tables.HKLS)),), order=["RingNr", "h", "k", "l"])
    back = tables.read_reflections(t.spark, path)
    whole = back.where(F.abs(F.col("Theta") - F.asin(F.lit(0.1) / F.col("DSpacing"))) < 1e-6)
    return rounded(whole.drop("Theta", "TwoTheta", "Radius"))


_GRAIN_COLUMNS = {"GrainID": "grain", "X": "x", "Y": "y", "Z": "z", "GrainRadius": "radius", "Confidence": "confidence", "PhaseNr": "1"}


@queries.add(f"SELECT CAST(grain AS BIGINT) AS GrainID, round(x, 6) AS X, round(y, 6) AS Y, round(z, 6) AS Z, round(radius, 6) AS GrainRadius, round(confidence, 6) AS Confidence, CAST(1 AS BIGINT) AS PhaseNr, round(w0 / 3, 6) AS O11, CAST(NULL AS DOUBLE) AS AnglePost FROM {GRAINS_SQL}")
def grain_file(t: Tables) -> DataFrame:
    """The table of grains with its nine header lines and 53 columns; what wasn't measured comes back as null."""
    path = f"{folder(t.spark, 'grains')}/grains.csv"
    df = grains(t).selectExpr(*[f"{e} AS {n}" for n, e in _GRAIN_COLUMNS.items()], "w0 / 3 AS O11")
    tables.write_grains(df, path)
    back = tables.read_grains(t.spark, path)
    return rounded(back.select(*_GRAIN_COLUMNS, "O11", F.col("DiffAnglePost").alias("AnglePost")))


_MATRIX = {"GrainID": "grain", "SpotID": "spot", "Omega": "omega", "Eta": "eta", "RingNr": "ring", "Matched": "spot % 2", "theorSpotID": "spot + 3", "theorRingNr": "ring"}


@queries.add(_rounded_sql(tables.SPOT_MATRIX, _MATRIX).replace("round(StrainError, 6)", "round(StrainError, 6)"))
def spot_matrix_file(t: Tables) -> DataFrame:
    """Spots of each grain, 28 columns between tabs."""
    path = f"{folder(t.spark, 'matrix')}/matrix.csv"
    tables.write_table(_filled(spots(t), tables.SPOT_MATRIX, _MATRIX), path, tables.SPOT_MATRIX, header=("%" + "\t".join(_layout(tables.SPOT_MATRIX)),), separator="\t", order=["GrainID", "SpotID"])
    return rounded(tables.read_table(t.spark, path, tables.SPOT_MATRIX))


@queries.add("""
    SELECT min(o_orderkey) AS best, o_custkey AS cluster, count(*) - 1 AS others, sum(o_orderkey) - min(o_orderkey) AS total FROM orders GROUP BY o_custkey""")
def cluster_key_file(t: Tables) -> DataFrame:
    """A line for each cluster: its best member and place, then those of the others; read back into members."""
    path = f"{folder(t.spark, 'clusters')}/keys.csv"
    members = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("m"))
    line = F.array_join(F.transform("m", lambda x: F.concat_ws(" ", x.cast("string"), F.col("o_custkey").cast("string"))), " ")
    tables.write_lines(members.orderBy("o_custkey").select(line.alias("value")), path)
    cells = F.transform(F.split("value", " "), lambda x: x.cast("long"))
    back = t.spark.read.text(path).select(cells.alias("c")).select(F.col("c")[0].alias("best"), F.col("c")[1].alias("cluster"), F.expr("filter(c, (x, i) -> i % 2 = 0 AND i > 0)").alias("o"))
    return back.select("best", "cluster", F.size("o").cast("long").alias("others"), F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_PACKED = {"Y": "y", "Z": "z", "Omega": "omega", "GrainRadius": "ii", "SpotID": "CAST(spot AS DOUBLE)", "RingNumber": "CAST(ring AS DOUBLE)", "Eta": "eta", "Ttheta": "y / 3", "RadiusDistIdeal": "z / 7", "ScanNr": "CAST(scan AS DOUBLE)"}
_NINE = ", ".join(f"{e} AS {n}" for n, e in list(_PACKED.items())[:9])
_TEN = ", ".join(f"{e} AS {n}" for n, e in _PACKED.items())


def _by_row(sql: str, order: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS row, * EXCLUDE (spot_) FROM (SELECT spot AS spot_, {sql} FROM {SPOTS_SQL})"


@queries.add(_by_row(_NINE, "spot_"))
def packed_spots(t: Tables) -> DataFrame:
    """Nine doubles a spot, split over tasks by record."""
    path = f"{folder(t.spark, 'spots')}/spots.bin"
    binaries.write_records(spots(t).selectExpr("spot", *_NINE.split(", ")), path, "spots", ["spot"])
    return binaries.read_records(t.spark, path, "spots")


@queries.add(_by_row(_TEN, "spot_"))
def packed_scan_spots(t: Tables) -> DataFrame:
    """Ten doubles a spot, with its scan."""
    path = f"{folder(t.spark, 'spots')}/spots.bin"
    binaries.write_records(spots(t).selectExpr("spot", *_TEN.split(", ")), path, "scan_spots", ["spot"])
    return binaries.read_records(t.spark, path, "scan_spots")


@queries.add(f"WITH s AS (SELECT *, row_number() OVER (ORDER BY spot) - 1 AS row_nr FROM {SPOTS_SQL}) SELECT CAST(ring AS BIGINT) AS bin, row_nr, CAST(scan AS BIGINT) AS scan_nr FROM s")
def bin_index_files(t: Tables) -> DataFrame:
    """The inverted index of spots by bin: rows and scans in one file, each bin's count and begin in another; joined again by place."""
    home = folder(t.spark, "index")
    from ringfold.operators.windows import renumber

    rows = renumber(spots(t).select("spot", "ring", "scan"), "row_nr", ["spot"], start=0).select(F.col("ring").alias("bin"), F.col("row_nr").cast("long").alias("row_nr"), F.col("scan").cast("long").alias("scan_nr"))
    binaries.write_records(rows, f"{home}/data.bin", "scan_bin_rows", ["bin", "row_nr"])
    counts = t.spark.range(6).select(F.col("id").alias("bin")).join(rows.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").na.fill(0)
    ranges = counts.withColumn("begin", F.coalesce(F.sum("n").over(_upto("bin")), F.lit(0)))
    binaries.write_records(ranges, f"{home}/ndata.bin", "scan_bin_ranges", ["bin"])
    held = binaries.read_records(t.spark, f"{home}/ndata.bin", "scan_bin_ranges").withColumnRenamed("row", "bin")
    place = binaries.read_records(t.spark, f"{home}/data.bin", "scan_bin_rows")
    return place.join(F.broadcast(held), (F.col("row") >= F.col("begin")) & (F.col("row") < F.col("begin") + F.col("n"))).select("bin", "row_nr", "scan_nr")


def _upto(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)


_SEEDS = ["CAST(layer AS DOUBLE) / 9 AS AvgIA", *[f"w{k % 4} / {k + 2} AS O{k // 3 + 1}{k % 3 + 1}" for k in range(9)], "x AS X", "y AS Y", "z AS Z", "radius AS NTheor", "radius - 3 AS NMatches"]


@queries.add(f"SELECT row_number() OVER (ORDER BY grain) - 1 AS row, * EXCLUDE (grain) FROM (SELECT grain, {', '.join(_SEEDS)} FROM {GRAINS_SQL})")
def seed_records(t: Tables) -> DataFrame:
    """Fifteen doubles a seed, at the seed's own place."""
    path = f"{folder(t.spark, 'best')}/best.bin"
    binaries.write_records(grains(t).selectExpr("grain", *_SEEDS), path, "best_seeds", ["grain"])
    return binaries.read_records(t.spark, path, "best_seeds")


_REFINED = ["grain AS id0", *[f"w{k % 4} / {k + 2} AS O{k // 3 + 1}{k % 3 + 1}" for k in range(9)], "grain AS id1", "x AS X", "y AS Y", "z AS Z", "grain AS id2", *[f"radius + {k} AS {n}" for k, n in enumerate("a b c alpha beta gamma".split())], "grain AS id3",
            "x / 9 AS DiffPos", "y / 9 AS DiffOme", "z / 9 AS DiffAngle", "radius AS MeanRadius", "confidence AS Completeness"]
_PAIRS = [f"radius / {k + 2} AS {n}" for k, n in enumerate("PosPre OmePre AnglePre PosPost OmePost AnglePost".split())]


@queries.add(f"SELECT 'refined_33' AS kind, CAST(id0 AS BIGINT) AS grain, round(X, 6) AS X, round(gamma, 6) AS gamma, round(Completeness, 6) AS Completeness, round(AnglePost, 6) AS AnglePost FROM (SELECT {', '.join(_REFINED + _PAIRS)} FROM {GRAINS_SQL}) "
             f"UNION ALL SELECT 'refined_27', CAST(id0 AS BIGINT), round(X, 6), round(gamma, 6), round(Completeness, 6), NULL FROM (SELECT {', '.join(_REFINED)} FROM {GRAINS_SQL})")
def refined_records(t: Tables) -> DataFrame:
    """Refined seeds in records of 27 or 33 doubles; the width is told by the seed's id, which is repeated in four columns."""
    out = None
    for kind, names in (("refined_33", _REFINED + _PAIRS), ("refined_27", _REFINED)):
        path = f"{folder(t.spark, kind)}/fit.bin"
        binaries.write_records(grains(t).selectExpr("grain", *names), path, kind, ["grain"])
        told = binaries.refined_width(t.spark, path)
        back = binaries.read_records(t.spark, path, told)
        last = F.col("AnglePost") if "AnglePost" in back.columns else F.lit(None).cast("double").alias("AnglePost")
        back = back.select(F.lit(told).alias("kind"), F.col("id0").cast("long").alias("grain"), "X", "gamma", "Completeness", last)
        out = back if out is None else out.unionByName(back)
    return rounded(out)


_PEAKS = {"SpotID": "CAST(spot AS DOUBLE)", "IntegratedIntensity": "ii", "Omega": "omega", "Eta": "eta", "YCen": "y", "ZCen": "z"}


def _peaks(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("frame").orderBy("spot")) - 1
    return spots(t).withColumn("place", place).selectExpr("frame AS slot", "place", *[f"{_PEAKS[n]} AS {n}" if n in _PEAKS else f"CAST(spot % 101 + {k} AS DOUBLE) / 8 AS {n}" for k, n in enumerate(binaries.PEAK.names)])


_PEAKS_SQL = f"SELECT CAST(frame AS INTEGER) AS slot, CAST(row_number() OVER (PARTITION BY frame ORDER BY spot) - 1 AS INTEGER) AS place, {', '.join(f'{_PEAKS[n]} AS {n}' if n in _PEAKS else f'CAST(spot % 101 + {k} AS DOUBLE) / 8 AS {n}' for k, n in enumerate(binaries.PEAK.names))} FROM {SPOTS_SQL}"


@queries.add(_PEAKS_SQL)
def peak_blobs(t: Tables) -> DataFrame:
    """Peaks of all frames in one file with a table of offsets, 29 doubles each; some frames have none."""
    path = f"{folder(t.spark, 'peaks')}/peaks.bin"
    binaries.write_slots(_peaks(t), path, binaries.PEAK, 30)
    return binaries.read_slots(t.spark, path, binaries.PEAK)


@queries.add(f"SELECT slot, place, SpotID FROM ({_PEAKS_SQL})")
def merged_peak_blobs(t: Tables) -> DataFrame:
    """Peaks of frames that three workers wrote by blocks, as one table; a frame that two of them wrote counts once."""
    out = []
    for k in range(3):
        path = f"{folder(t.spark, 'block')}/peaks.bin"
        binaries.write_slots(_peaks(t).where((F.col("slot") >= 8 * k) & (F.col("slot") < 8 * k + 9)), path, binaries.PEAK, 24)
        out.append(binaries.read_slots(t.spark, path, binaries.PEAK))
    return binaries.merged_slots(out).select("slot", "place", "SpotID")


_PIXELS = "SELECT CAST(l_orderkey % 12 AS INTEGER) AS slot, CAST(l_orderkey % 7 AS INTEGER) AS peak, CAST(row_number() OVER (PARTITION BY l_orderkey % 12, l_orderkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER) AS place, CAST(l_partkey % 2048 AS INTEGER) AS y, CAST(l_suppkey % 2048 AS INTEGER) AS z FROM lineitem"


@queries.add(_PIXELS.replace("ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate", "ORDER BY l_partkey % 2048, l_suppkey % 2048"))
def peak_pixel_blobs(t: Tables) -> DataFrame:
    """Ragged lists of each peak's pixels."""
    path = f"{folder(t.spark, 'pixels')}/pixels.bin"
    from pyspark.sql import Window

    cells = t.lineitem.selectExpr("CAST(l_orderkey % 12 AS INT) AS slot", "CAST(l_orderkey % 7 AS INT) AS peak", "CAST(l_partkey % 2048 AS INT) AS y", "CAST(l_suppkey % 2048 AS INT) AS z")
    placed = cells.withColumn("place", F.row_number().over(Window.partitionBy("slot", "peak").orderBy("y", "z")) - 1)
    binaries.write_peak_pixels(placed, path, 15, 2048)
    return binaries.read_peak_pixels(t.spark, path)


_SOLUTIONS = ", ".join(f"CAST(o_orderkey % {k + 50} AS DOUBLE) / 3 AS v{k}" for k in range(16))


@queries.add(f"SELECT CAST(o_custkey AS INTEGER) AS slot, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, {_SOLUTIONS}, CAST(o_orderkey AS BIGINT) AS SpotID, CAST(o_orderkey % 9 AS BIGINT) AS NMatches FROM orders")
def voxel_solution_files(t: Tables) -> DataFrame:
    """Candidates of each voxel and their keys, in two files with tables of offsets, joined again by voxel and place."""
    home = folder(t.spark, "voxels")
    from pyspark.sql import Window

    rows = t.orders.selectExpr("CAST(o_custkey AS INT) AS slot", "o_orderkey", *_SOLUTIONS.split(", ")).withColumn("place", (F.row_number().over(Window.partitionBy("slot").orderBy("o_orderkey")) - 1).cast("int"))
    n = int(rows.agg(F.max("slot")).first()[0]) + 1
    binaries.write_slots(rows.drop("o_orderkey"), f"{home}/best.bin", binaries.SOLUTION, n)
    keys = rows.select("slot", "place", *[F.expr(e).cast("decimal(20,0)").alias(c) for c, e in (("SpotID", "o_orderkey"), ("NMatches", "o_orderkey % 9"), ("NIDs", "3"), ("Best", "0"))])
    binaries.write_slots(keys, f"{home}/key.bin", binaries.SOLUTION_KEY, n)
    back = binaries.read_slots(t.spark, f"{home}/key.bin", binaries.SOLUTION_KEY).select("slot", "place", F.col("SpotID").cast("long").alias("SpotID"), F.col("NMatches").cast("long").alias("NMatches"))
    return binaries.read_slots(t.spark, f"{home}/best.bin", binaries.SOLUTION).join(back, ["slot", "place"])


@queries.add("SELECT o_custkey AS slot, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, CAST(o_orderkey + 1 AS INTEGER) AS value FROM orders")
def padded_lists(t: Tables) -> DataFrame:
    """Lists of ids in slots of a fixed width, the last one short."""
    path = f"{folder(t.spark, 'lists')}/lists.bin"
    held = t.orders.groupBy(F.col("o_custkey").alias("slot")).agg(F.sort_array(F.collect_list((F.col("o_orderkey") + 1).cast("int"))).alias("v"))
    every = t.orders.agg(F.max("o_custkey").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("slot"))
    binaries.write_padded(every.join(held, "slot", "left").select("slot", F.coalesce("v", F.array().cast("array<int>")).alias("values")), path, 64)
    return binaries.read_padded(t.spark, path, 64)


@queries.add(f"SELECT CAST(grain AS INTEGER) AS voxel, CAST(row_number() OVER (PARTITION BY grain ORDER BY spot) - 1 AS INTEGER) AS place, CAST(spot AS DOUBLE) AS theorSpotID, CAST(spot % 3 <> 0 AS INTEGER) * 1.0 AS matched, CASE WHEN spot % 3 <> 0 THEN y END AS obsY FROM {SPOTS_SQL}")
def diagnostics_file(t: Tables) -> DataFrame:
    """Every predicted spot of every voxel; what wasn't observed is a sentinel on disk and null here."""
    path = f"{folder(t.spark, 'diagnostics')}/diagnostics.bin"
    from pyspark.sql import Window

    rows = spots(t).withColumn("place", (F.row_number().over(Window.partitionBy("grain").orderBy("spot")) - 1).cast("int"))
    given = {"theorSpotID": "CAST(spot AS DOUBLE)", "matched": "CAST(spot % 3 <> 0 AS DOUBLE)", "obsY": "CASE WHEN spot % 3 <> 0 THEN y ELSE -999.0D END"}
    full = rows.selectExpr("grain AS voxel", "place", *[f"{given.get(n, f'CAST(spot % 101 + {k} AS DOUBLE)')} AS {n}" for k, n in enumerate(binaries.DIAGNOSTIC.names)])
    voxels = full.select("voxel").distinct().select("voxel", *[F.lit(float(k)).alias(n) for k, n in enumerate(binaries.DIAGNOSTIC_META.names)])
    binaries.write_diagnostics(full, voxels, path)
    return binaries.read_diagnostics(t.spark, path).select("voxel", "place", "theorSpotID", "matched", "obsY")


@queries.add(f"""
    SELECT layer AS family, grain, CAST(x AS DOUBLE) AS x, count(spot) AS n_spots, min(spot) AS first_spot FROM (SELECT g.layer, g.grain, g.x, s.spot FROM {GRAINS_SQL} g LEFT JOIN (SELECT *, o_custkey FROM (SELECT s.*, o.o_custkey FROM {SPOTS_SQL} s JOIN orders o ON o.o_orderkey = s.spot)) s ON s.o_custkey = g.grain) GROUP BY 1, 2, 3""")
def nested_grains(t: Tables) -> DataFrame:
    """Families of grains of spots as one nested table in Parquet, taken apart again."""
    path = f"{folder(t.spark, 'nested')}/families"
    s = t.orders.selectExpr("o_orderkey AS spot", "o_custkey AS grain").groupBy("grain").agg(F.sort_array(F.collect_list("spot")).alias("spots"))
    g = grains(t).select("layer", "grain", "x").join(s, "grain", "left")
    g.groupBy(F.col("layer").alias("family")).agg(F.collect_list(F.struct("grain", "x", F.coalesce("spots", F.array().cast("array<bigint>")).alias("spots"))).alias("grains")).write.parquet(path)
    each = t.spark.read.parquet(path).select("family", F.explode("grains").alias("g")).select("family", "g.grain", "g.x", "g.spots")
    return each.select("family", "grain", "x", F.size("spots").cast("long").alias("n_spots"), F.get("spots", F.lit(0)).alias("first_spot"))


@queries.add("SELECT CAST(l_suppkey % 6 AS INTEGER) AS bin, CAST(row_number() OVER (PARTITION BY l_suppkey % 6 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER) AS place, CAST(l_partkey AS FLOAT) AS y, CAST(l_linenumber AS FLOAT) AS z, l_tax AS frac, CAST(l_quantity AS FLOAT) AS area_weight FROM lineitem")
def pixel_map_files(t: Tables) -> DataFrame:
    """A map of pixels to bins with a header that holds the hash of its parameters; another parameter makes it stale."""
    home = folder(t.spark, "map")
    from pyspark.sql import Window

    values = {"Ycen": 10.0, "Zcen": 11.0, "EtaBinSize": 5.0, "EtaMax": 180.0, "EtaMin": -180.0, "Lsd": 1e6, "NrPixelsY": 2048, "NrPixelsZ": 2048, "RBinSize": 1.0, "RMax": 900.0, "RMin": 10.0, "RhoD": 2e5, "pxY": 200.0, "pxZ": 200.0}
    digest = binaries.parameter_hash(values)
    order = Window.partitionBy("bin").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = t.lineitem.withColumn("bin", (F.col("l_suppkey") % 6).cast("int")).withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    full = rows.selectExpr("bin", "place", "CAST(l_partkey AS FLOAT) AS y", "CAST(l_linenumber AS FLOAT) AS z", "l_tax AS frac", "CAST(0 AS FLOAT) AS delta_r", "CAST(l_quantity AS FLOAT) AS area_weight")
    binaries.write_map(full, f"{home}/map.bin", f"{home}/nmap.bin", 8, digest)
    try:
        binaries.read_map(t.spark, f"{home}/map.bin", f"{home}/nmap.bin", binaries.parameter_hash(values | {"p7": 0.5}))
    except ValueError:
        return binaries.read_map(t.spark, f"{home}/map.bin", f"{home}/nmap.bin", digest).drop("delta_r")
    raise AssertionError("a stale map was taken")


_PROFILE_SQL = "SELECT CAST(p_size AS DOUBLE) / 4 AS x, avg(p_retailprice) AS y, stddev_samp(p_retailprice) AS s FROM part GROUP BY 1"
_KINDS = ["csv", "xye", "fxye", "esg", "dat"]


@queries.add("SELECT kind, round(x, 4) AS x, round(y, 1) AS y, round(s, 1) AS s FROM (" + _PROFILE_SQL + ") CROSS JOIN (VALUES " + ", ".join(f"('{k}')" for k in _KINDS) + ") AS k(kind)")
def profile_files(t: Tables) -> DataFrame:
    """One profile in five text formats, read back alike."""
    p = t.part.groupBy((F.col("p_size") / 4.0).alias("x")).agg(F.avg("p_retailprice").alias("y"), F.stddev_samp("p_retailprice").alias("s"))
    out = None
    for kind in _KINDS:
        path = f"{folder(t.spark, kind)}/profile.{kind}"
        tables.write_profile_text(p, path, kind, "x", "y", "s", notes=("wavelength 0.2",))
        back = tables.read_profile_text(t.spark, path, kind).select(F.lit(kind).alias("kind"), F.round("x", 4).alias("x"), F.round("y", 1).alias("y"), F.round("sigma", 1).alias("s"))
        out = back if out is None else out.unionByName(back)
    return out


_CAKE_SQL = "SELECT CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 9 AS DOUBLE) * 10 AS b, sum(p_retailprice) AS v FROM part GROUP BY 1, 2"


@queries.add(f"SELECT kind, round(a, 4) AS a, round(b, 4) AS b, round(v, 0) AS v FROM ({_CAKE_SQL}) CROSS JOIN (VALUES ('xpc'), ('epf')) AS k(kind) UNION ALL SELECT 'pol', NULL, b, round(sum(v), 0) FROM (SELECT b, round(v, 0) AS v FROM ({_CAKE_SQL})) GROUP BY b")
def texture_files(t: Tables) -> DataFrame:
    """Cakes and pole figures for texture programs; the grid format comes back as a line of values for each angle."""
    cake = t.part.groupBy(F.col("p_size").cast("double").alias("a"), ((F.col("p_partkey") % 9).cast("double") * 10).alias("b")).agg(F.sum("p_retailprice").alias("v"))
    out = None
    for kind in ("xpc", "epf"):
        path = f"{folder(t.spark, kind)}/cake.{kind}"
        tables.write_cake_text(cake, path, kind, "a", "b", "v")
        cells = t.spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", " ").alias("p"))
        back = cells.select(F.lit(kind).alias("kind"), *[F.round(F.col("p")[k].cast("double"), d).alias(c) for k, (c, d) in enumerate((("a", 4), ("b", 4), ("v", 0)))])
        out = back if out is None else out.unionByName(back)
    path = f"{folder(t.spark, 'pol')}/cake.pol"
    tables.write_cake_text(cake.withColumn("v", F.round("v", 0)), path, "pol", "a", "b", "v")
    seq = t.spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "v")).where("v <> '' AND NOT v LIKE '#%'")
    grid = cake.select("b").distinct().withColumn("line", F.row_number().over(_all("b")) + 2)
    total = F.aggregate(F.transform(F.split("v", " "), lambda x: F.round(x.cast("double"), 0)), F.lit(0.0), lambda a, x: a + x)
    return out.unionByName(seq.join(grid, "line").select(F.lit("pol").alias("kind"), F.lit(None).cast("double").alias("a"), "b", F.round(total, 0).alias("v")))


def _all(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


@queries.add(f"SELECT row_number() OVER (ORDER BY grain) - 1 AS row, CAST(grain AS DOUBLE) AS OrientationRowNr, x AS X, y AS Y, radius AS TriEdgeSize, confidence AS Confidence FROM {GRAINS_SQL}")
def voxel_records(t: Tables) -> DataFrame:
    """A voxel map of eleven doubles a voxel."""
    path = f"{folder(t.spark, 'voxels')}/map.mic"
    given = {"OrientationRowNr": "CAST(grain AS DOUBLE)", "X": "x", "Y": "y", "TriEdgeSize": "radius", "Confidence": "confidence"}
    binaries.write_records(grains(t).selectExpr("grain", *[f"{given.get(n, 'CAST(layer AS DOUBLE)')} AS {n}" for n in binaries.RECORDS["voxels"].names]), path, "voxels", ["grain"])
    return binaries.read_records(t.spark, path, "voxels").select("row", "OrientationRowNr", "X", "Y", "TriEdgeSize", "Confidence")


@queries.add(f"SELECT CAST(grain AS BIGINT) AS OrientationRowNr, round(x, 6) AS X, round(y, 6) AS Y, round(confidence, 6) AS Confidence, CAST(1 AS BIGINT) AS PhaseNr FROM {GRAINS_SQL} WHERE confidence <> 0")
def voxel_text(t: Tables) -> DataFrame:
    """The same as text; voxels without confidence aren't written."""
    path = f"{folder(t.spark, 'voxels')}/map.mic"
    given = {"OrientationRowNr": "grain", "X": "x", "Y": "y", "TriEdgeSize": "radius", "Confidence": "confidence", "PhaseNr": "1"}
    df = grains(t).where("confidence <> 0").selectExpr(*[f"{given.get(n, 'CAST(layer AS DOUBLE)')} AS {n}" for n in _layout(tables.MIC)])
    tables.write_table(df, path, tables.MIC, 6, ("%TriEdgeSize 5.000000", "%NumPhases 1", "%GlobalPosition 0.000000", "%" + "\t".join(_layout(tables.MIC))), "\t", ["OrientationRowNr"])
    return rounded(tables.read_table(t.spark, path, tables.MIC).select("OrientationRowNr", "X", "Y", "Confidence", "PhaseNr"))


@queries.add("SELECT DISTINCT CAST(l_orderkey % 3 AS INTEGER) AS layer, CAST(l_linenumber % 5 AS INTEGER) AS frame, CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey % 48 AS INTEGER) AS z FROM lineitem")
def bit_mask(t: Tables) -> DataFrame:
    """Which pixels of which frames are lit, a bit each, counted from the far edge."""
    path = f"{folder(t.spark, 'mask')}/spots.bin"
    cells = t.lineitem.selectExpr("CAST(l_orderkey % 3 AS INT) AS layer", "CAST(l_linenumber % 5 AS INT) AS frame", "CAST(l_partkey % 64 AS INT) AS y", "CAST(l_suppkey % 48 AS INT) AS z")
    binaries.write_bits(cells, path, 3, 5, 64, 48)
    return binaries.read_bits(t.spark, path, 5, 64, 48)


@queries.add("SELECT CAST(o_custkey AS BIGINT) AS orientation, CAST(o_orderkey AS DOUBLE) AS omega, CAST(o_custkey AS DOUBLE) / 3 AS O11 FROM orders")
def predicted_spot_files(t: Tables) -> DataFrame:
    """Predicted spots of each orientation: counts and begins, spots, and matrices in three files, joined again by place."""
    home = folder(t.spark, "predicted")
    rows = t.orders.selectExpr("o_custkey", "o_orderkey", "CAST(o_custkey AS DOUBLE) AS yl", "CAST(0 AS DOUBLE) AS zl", "CAST(o_orderkey AS DOUBLE) AS omega")
    binaries.write_records(rows, f"{home}/spots.bin", "predicted_spots", ["o_custkey", "o_orderkey"])
    last = t.orders.agg(F.max("o_custkey")).first()[0]
    counts = t.spark.range(last + 1).select(F.col("id").alias("o_custkey")).join(rows.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "left").na.fill(0)
    binaries.write_records(counts.select("o_custkey", "n", F.coalesce(F.sum("n").over(_upto("o_custkey")), F.lit(0)).alias("begin")), f"{home}/key.bin", "bin_ranges", ["o_custkey"])
    binaries.write_records(counts.select("o_custkey", *[(F.col("o_custkey") / (k + 3.0)).alias(n) for k, n in enumerate(binaries.RECORDS["orientations"].names)]), f"{home}/mats.bin", "orientations", ["o_custkey"])
    key = binaries.read_records(t.spark, f"{home}/key.bin", "bin_ranges").withColumnRenamed("row", "orientation")
    # places of an orientation follow from its range, so the join is one of equal places
    places = key.where("n > 0").select("orientation", F.explode(F.sequence(F.col("begin").cast("long"), (F.col("begin") + F.col("n") - 1).cast("long"))).alias("row"))
    mats = binaries.read_records(t.spark, f"{home}/mats.bin", "orientations").select(F.col("row").alias("orientation"), "O11")
    return binaries.read_records(t.spark, f"{home}/spots.bin", "predicted_spots").join(places, "row").join(mats, "orientation").select("orientation", "omega", "O11")


@queries.add(f"SELECT round(w0 / sqrt(w0*w0+w1*w1+w2*w2+w3*w3), 6) AS q0, round(w1 / sqrt(w0*w0+w1*w1+w2*w2+w3*w3), 6) AS q1, round(w2 / sqrt(w0*w0+w1*w1+w2*w2+w3*w3), 6) AS q2, round(w3 / sqrt(w0*w0+w1*w1+w2*w2+w3*w3), 6) AS q3 FROM {GRAINS_SQL}")
def seed_orientations(t: Tables) -> DataFrame:
    """A library of seed orientations as quaternions between commas."""
    path = f"{folder(t.spark, 'seeds')}/seeds.csv"
    n = F.sqrt(sum((F.col(f"w{k}") * F.col(f"w{k}") for k in range(4)), F.lit(0.0)))
    quats = grains(t).select("grain", *[(F.col(f"w{k}") / n).alias(f"q{k}") for k in range(4)])
    tables.write_lines(quats.orderBy("grain").select(F.format_string("%.12f,%.12f,%.12f,%.12f", "q0", "q1", "q2", "q3").alias("value")), path)
    return rounded(tables.read_table(t.spark, path, "q0 q1 q2 q3", least=4))


@queries.add("SELECT * FROM (VALUES ('_cell_length_a', '4.080000'), ('_cell_length_b', '4.080000'), ('_cell_length_c', '4.080000'), ('_cell_angle_alpha', '90.000000'), ('_cell_angle_beta', '90.000000'), ('_cell_angle_gamma', '90.000000'), ('_space_group_IT_number', '225'), ('0/_atom_site_type_symbol', 'Au'), ('0/_atom_site_fract_x', '0.000000'), ('0/_atom_site_fract_y', '0.000000'), ('0/_atom_site_fract_z', '0.250000'), ('0/_atom_site_occupancy', '1.0000')) AS v(key, value)")
def crystal_file(t: Tables) -> DataFrame:
    """A crystal file's cell, group and atoms."""
    path = f"{folder(t.spark, 'crystal')}/gold.cif"
    tables.write_cif(path, t.spark, "gold", (4.08, 4.08, 4.08, 90.0, 90.0, 90.0), 225, [("Au", 0.0, 0.0, 0.25, 1.0)])
    items, atoms = tables.read_cif(t.spark, path)
    return items.unionByName(atoms.select(F.concat_ws("/", F.col("site").cast("string"), "key").alias("key"), "value"))


@queries.add("""
    WITH p AS (SELECT n_regionkey, n_nationkey, n_name FROM nation)
    SELECT n_regionkey AS file, 'Lsd' AS key, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS place, 1000.5 + n_regionkey AS number, NULL AS problem FROM (SELECT DISTINCT n_regionkey FROM p)
    UNION ALL SELECT n_regionkey, 'RingThresh', s, j, CASE j WHEN 0 THEN n_nationkey ELSE 80 + n_nationkey / 2 END, NULL FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS s FROM p), range(2) r(j)
    UNION ALL SELECT n_regionkey, 'Nothing', 0, 0, NULL, 'unknown key' FROM (SELECT DISTINCT n_regionkey FROM p)
    UNION ALL SELECT n_regionkey, 'NrPixels', 0, 0, 20.5, 'not a whole number' FROM (SELECT DISTINCT n_regionkey FROM p)""")
def parameter_files(t: Tables) -> DataFrame:
    """Parameter files with repeated keys, typed by their kinds; each file's keys count for themselves."""
    home = folder(t.spark, "parameters")
    own = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("n"))
    rings = F.transform("n", lambda k: F.concat(F.lit("RingThresh "), k.cast("string"), F.lit(" "), (80 + k / 2).cast("string")))
    for r in own.select("n_regionkey", F.concat(F.array(F.concat(F.lit("Lsd "), (1000.5 + F.col("n_regionkey")).cast("string"), F.lit(" # distance"))), rings, F.array(F.lit("Nothing here"), F.lit("NrPixels 20.5"))).alias("lines")).collect():
        binaries.write_stream(t.spark, f"{home}/{r.n_regionkey}.par", iter(["\n".join(r.lines).encode()]))
    typed = tables.typed_parameters(tables.read_parameters(t.spark, f"{home}/*.par"), {"Lsd": "float", "RingThresh": "float", "NrPixels": "int"})
    return typed.select(F.regexp_extract("file", r"([0-9]+)\.par$", 1).cast("int").alias("file"), "key", F.col("seq").cast("long").alias("seq"), F.col("place").cast("long").alias("place"), "number", "problem")


@queries.add("SELECT 'scan' || s AS stem, '.ge' || (s + 2) AS ext, CAST(6 AS INTEGER) AS padding, CAST(min(n) AS BIGINT) AS first, CAST(max(n) AS BIGINT) AS last, count(*) AS n FROM (SELECT s_suppkey % 3 AS s, s_suppkey AS n FROM supplier WHERE s_suppkey <= 40) GROUP BY s")
def discovered_files(t: Tables) -> DataFrame:
    """Numbered frame files in a folder: their stems, paddings, first, last and how many."""
    home = folder(t.spark, "frames")
    for r in t.supplier.where("s_suppkey <= 40").select("s_suppkey").collect():
        binaries.write_stream(t.spark, f"{home}/scan{r.s_suppkey % 3}_{r.s_suppkey:06d}.ge{r.s_suppkey % 3 + 2}", iter([b"x"]))
    binaries.write_stream(t.spark, f"{home}/notes.txt", iter([b"x"]))
    return tables.discovered(t.spark, home).select("stem", "ext", "padding", "first", "last", "n")


@queries.add("SELECT p_brand AS name, 'USD' AS units, round(quantile_cont(p_retailprice, 0.5), 6) AS median, count(*) AS n, round(max(p_retailprice), 6) AS top FROM part GROUP BY 1")
def inventory_file(t: Tables) -> DataFrame:
    """An inventory of results, their samples as JSON lists in a CSV file, read back whole."""
    path = f"{folder(t.spark, 'inventory')}/inventory"
    made = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.lit("USD").alias("units"), F.percentile("p_retailprice", 0.5).alias("median"), F.to_json(F.sort_array(F.collect_list("p_retailprice"))).alias("samples_json"))
    made.write.option("header", True).option("escape", '"').csv(path)
    back = t.spark.read.option("header", True).option("escape", '"').schema("name string, units string, median double, samples_json string").csv(path)
    samples = back.withColumn("s", F.from_json("samples_json", "array<double>"))
    return samples.select("name", "units", F.round("median", 6).alias("median"), F.size("s").cast("long").alias("n"), F.round(F.array_max("s"), 6).alias("top"))


@queries.add("SELECT CAST(l_orderkey % 10 AS BIGINT) AS frame, CAST(l_partkey % 400 AS BIGINT) AS pixel, sum(CASE l_orderkey % 10 % 7 WHEN 0 THEN l_linenumber WHEN 4 THEN l_linenumber + 0.5 WHEN 5 THEN l_linenumber + 0.25 ELSE l_linenumber * CASE l_orderkey % 10 % 7 WHEN 6 THEN 30000 WHEN 1 THEN 10 ELSE 1000 END END) AS v FROM (SELECT l_orderkey, l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem WHERE l_orderkey % 400 = l_partkey % 400 GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) = 1")
def payload_frames(t: Tables) -> DataFrame:
    """Frames as payloads of every code, decoded to pixels; code 6 lists what overflows 16 bits."""
    kind = "l_orderkey % 10 % 7"
    cells = t.lineitem.where("l_orderkey % 400 = l_partkey % 400").groupBy("l_orderkey", "l_partkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    value = f"CASE {kind} WHEN 0 THEN l_linenumber WHEN 4 THEN l_linenumber + 0.5D WHEN 5 THEN l_linenumber + 0.25D ELSE l_linenumber * CASE {kind} WHEN 6 THEN 30000 WHEN 1 THEN 10 ELSE 1000 END END"
    pixels = cells.selectExpr("l_orderkey % 10 AS frame", "l_partkey % 400 AS pixel", f"CAST({value} AS DOUBLE) AS v").groupBy("frame", "pixel").agg(F.max("v").alias("v"), F.count("*").alias("n")).where("n = 1")

    def pack(rows):
        import pandas as pd

        frame = int(rows["frame"].iloc[0])
        image = np.zeros(400)
        image[rows["pixel"].to_numpy()] = rows["v"].to_numpy()
        return pd.DataFrame({"frame": [frame], "code": [frame % 7], "payload": [binaries.encode_payload(image, frame % 7)]})

    framed = pixels.groupBy("frame").applyInPandas(pack, "frame long, code int, payload binary")
    return binaries.decoded_payloads(framed, 400)


@queries.add("SELECT CAST(l_orderkey % 4 AS INTEGER) AS frame, CAST(l_partkey % 50 AS BIGINT) AS y, CAST(l_suppkey % 40 AS BIGINT) AS x, CAST(sum(CASE WHEN l_linenumber = 7 THEN 70000 * l_quantity WHEN l_linenumber = 1 THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3 HAVING sum(CASE WHEN l_linenumber = 7 THEN 70000 * l_quantity WHEN l_linenumber = 1 THEN -l_quantity ELSE l_quantity END) <> 0")
def compressed_images(t: Tables) -> DataFrame:
    """Images compressed by differences of one to eight bytes, with a digest, read back to pixels."""
    home = folder(t.spark, "images")
    v = F.expr("CASE WHEN l_linenumber = 7 THEN 70000 * l_quantity WHEN l_linenumber = 1 THEN -l_quantity ELSE l_quantity END")
    cells = t.lineitem.groupBy((F.col("l_orderkey") % 4).cast("int").alias("frame"), (F.col("l_partkey") % 50).alias("y"), (F.col("l_suppkey") % 40).alias("x")).agg(F.sum(v).cast("long").alias("v"))

    def pack(rows):
        import pandas as pd

        image = np.zeros((50, 40), np.int64)
        image[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows["v"].to_numpy()
        return pd.DataFrame({"frame": [rows["frame"].iloc[0]], "file": [binaries.cbf_file(image, 40)]})

    for r in cells.groupBy("frame").applyInPandas(pack, "frame int, file binary").toLocalIterator():
        binaries.write_stream(t.spark, f"{home}/frame_{r.frame:03d}.cbf", iter([bytes(r.file)]))
    back = binaries.read_cbf(t.spark, home)
    return back.select(F.regexp_extract("file", r"_([0-9]+)\.cbf$", 1).cast("int").alias("frame"), "y", "x", "v")


@queries.add("SELECT CAST(l_orderkey % 6 AS BIGINT) AS frame, CAST(l_partkey % 32 AS BIGINT) AS y, CAST(l_suppkey % 16 AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_partkey % 32 BETWEEN 8 AND 15 GROUP BY 1, 2, 3")
def frame_row_bands(t: Tables) -> DataFrame:
    """A band of rows of every raw frame: only the band's records are decoded."""
    path = f"{folder(t.spark, 'raw')}/frames.raw"
    cells = t.lineitem.groupBy((F.col("l_orderkey") % 6).alias("frame"), (F.col("l_partkey") % 32).alias("y"), (F.col("l_suppkey") % 16).alias("x")).agg(F.count("*").alias("v"))
    every = t.spark.range(6 * 32).select(F.floor(F.col("id") / 32).alias("frame"), (F.col("id") % 32).alias("y"))
    line = cells.groupBy("frame", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("m"))
    rows = every.join(line, ["frame", "y"], "left").select("frame", "y", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.coalesce(F.col("m")[x.cast("long")], F.lit(0)).cast("int")).alias("v"))

    def pack(batch: pa.RecordBatch) -> bytes:
        return np.array(batch.column(2).to_pylist(), "<u2").tobytes()

    binaries.write_stream(t.spark, path, binaries._ordered_parts(rows, ["frame", "y"], pack))
    return tables.read_row_band(t.spark, path, 32, 16, 8, 16).select("frame", "y", "x", "v")


@queries.add("SELECT DISTINCT CAST(l_suppkey % 90 AS DOUBLE) * 2 AS theta, CAST(l_linenumber AS BIGINT) AS t, CAST(l_orderkey % 3 AS BIGINT) AS slice, CAST(sum(l_quantity) AS FLOAT) AS v FROM lineitem GROUP BY 1, 2, 3")
def sinogram_files(t: Tables) -> DataFrame:
    """Sinograms as a cube of single floats, with a file of angles; joined again by place."""
    home = folder(t.spark, "sinogram")
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 90).alias("k"), F.col("l_linenumber").cast("long").alias("t"), (F.col("l_orderkey") % 3).alias("slice")).agg(F.sum("l_quantity").cast("float").alias("v"))
    angles = [r.k for r in rows.select("k").distinct().orderBy("k").collect()]
    tables.write_lines(t.spark.createDataFrame([(k,) for k in angles], "k long").orderBy("k").select((F.col("k") * 2.0).cast("string").alias("value")), f"{home}/thetas.txt")
    full = t.spark.createDataFrame([(n, k) for n, k in enumerate(angles)], "n int, k long").crossJoin(t.spark.range(8).withColumnRenamed("id", "t")).crossJoin(t.spark.range(3).withColumnRenamed("id", "slice"))
    cube = full.join(rows, ["k", "t", "slice"], "left").select("n", "t", "slice", F.coalesce("v", F.lit(0.0)).cast("float").alias("v"))
    binaries.write_stream(t.spark, f"{home}/cube.bin", binaries._ordered_parts(cube.select("n", "t", "slice", "v"), ["slice", "n", "t"], lambda b: b.column(3).to_numpy(zero_copy_only=False).astype("<f4").tobytes()))
    theta = tables.read_seed_values(t.spark, f"{home}/thetas.txt")
    return tables.read_cube(t.spark, f"{home}/cube.bin", len(angles), 8).join(F.broadcast(theta), "n").where("v <> 0").select("theta", "t", "slice", "v")


@queries.add(f"SELECT frame, CAST(spot AS BIGINT) AS peak, round(ii, 4) AS area, round(omega, 4) AS centre FROM {SPOTS_SQL}")
def fitted_peaks_table(t: Tables) -> DataFrame:
    """Fitted peaks appended frame by frame to a partitioned table, and read as one."""
    path = f"{folder(t.spark, 'fitted')}/peaks"
    fitted = spots(t).select("frame", F.col("spot").alias("peak"), "ii", "omega")
    for lo in (0, 8, 16):
        fitted.where((F.col("frame") >= lo) & (F.col("frame") < lo + 8)).write.mode("append").partitionBy("frame").parquet(path)
    return t.spark.read.parquet(path).select(F.col("frame").cast("int").alias("frame"), "peak", F.round("ii", 4).alias("area"), F.round("omega", 4).alias("centre"))
