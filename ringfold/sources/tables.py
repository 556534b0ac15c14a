"""Readers and writers of the fixed-layout text and binary tables, with explicit schemas.

Sentinels become null on the way in (-1 where it means unknown, NaN where it means not
measured) and are put back by the legacy writers. Layouts that grew by columns are told
apart by their width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the file kinds, in the order on disk; a colon and i marks integers.
RESULT = "SpotID:i IntegratedIntensity Omega YCen ZCen IMax MinOme MaxOme SigmaR SigmaEta NrPx NrPxTot Radius Eta RawSumIntensity maskTouched:i FitRMSE ReturnCode:i"
RADIUS = "SpotID:i IntegratedIntensity Omega YCen ZCen IMax MinOme MaxOme Radius Theta Eta DeltaOmega NImgs RingNr:i GrainVolume GrainRadius PowderIntensity SigmaR SigmaEta NrPx NrPxTot RawSumIntensity maskTouched:i FitRMSE OrigSpotID:i ReturnCode:i"
INPUTALL = "YLab ZLab Omega GrainRadius SpotID:i RingNumber:i Eta Ttheta DetID:i"
HKLS = "h:i k:i l:i DSpacing RingNr:i g1 g2 g3 Theta TwoTheta Radius"
SPOTS = "Y Z Omega GrainRadius SpotID:i RingNumber:i Eta Ttheta RadiusDistIdeal ScanNr:i"
INPUTALL_EXTRA = "YLab ZLab Omega GrainRadius SpotID:i RingNumber:i Eta Ttheta OmegaIni YOrigDetCor ZOrigDetCor YRawPx ZRawPx OmegaDetCor IntegratedIntensity RawSumIntensity maskTouched:i FitRMSE OrigSpotID:i ReturnCode:i"
GRAINS = "GrainID:i O11 O12 O13 O21 O22 O23 O31 O32 O33 X Y Z a b c alpha beta gamma DiffPos DiffOme DiffAngle GrainRadius Confidence eFab11 eFab12 eFab13 eFab21 eFab22 eFab23 eFab31 eFab32 eFab33 eKen11 eKen12 eKen13 eKen21 eKen22 eKen23 eKen31 eKen32 eKen33 RMSErrorStrain PhaseNr:i Eul0 Eul1 Eul2 DiffPosPre DiffOmePre DiffAnglePre DiffPosPost DiffOmePost DiffAnglePost"
SPOT_MATRIX = "GrainID:i SpotID:i Omega DetectorHor DetectorVert OmeRaw Eta RingNr:i YLab ZLab Theta StrainError Matched:i theorSpotID:i theorRingNr:i theorEta YExp ZExp OmegaExp DiffLen DiffOme InternalAngle YExpPost ZExpPost OmegaExpPost DiffLenPost DiffOmePost InternalAnglePost"
MIC = "OrientationRowNr:i OrientationID:i RunTime X Y TriEdgeSize UpDown Eul1 Eul2 Eul3 Confidence PhaseNr:i"
UNKNOWN = {"ReturnCode", "OrigSpotID"}


def _columns(layout: str) -> list[tuple[str, bool]]:
    return [(x.removesuffix(":i"), x.endswith(":i")) for x in layout.split()]


def read_table(spark: SparkSession, path: str, layout: str, comment: str = "%", least: int | None = None, header: bool = False) -> DataFrame:
    """Rows of numbers between white space. Columns that a narrower file lacks are null, -1 in the columns of ``UNKNOWN`` too; rows narrower than ``least`` are errors."""
    named = _columns(layout)
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith(comment))
    parts = lines.select(F.split("v", r"[\s,]+").alias("p"))
    if header:
        parts = parts.where(F.col("p")[0].rlike(r"^[-+.0-9]"))
    if least:
        parts = parts.withColumn("p", F.when(F.size("p") >= least, F.col("p")).otherwise(F.raise_error(F.lit(f"a row has fewer than {least} columns"))))
    out = []
    for k, (name, whole) in enumerate(named):
        x = F.get("p", F.lit(k)).cast("double")
        x = F.when(~F.isnan(x), x)
        x = F.when(x != -1, x) if name in UNKNOWN else x
        out.append((x.cast("long") if whole else x).alias(name))
    return parts.select(*out)


def write_table(df: DataFrame, path: str, layout: str, digits: int = 6, header: tuple[str, ...] = (), separator: str = " ", order: list[str] | None = None) -> None:
    """The legacy form: numbers between separators, -1 for unknown, nan for not measured; with ``header`` lines before, as one ordered file."""
    cells = []
    for name, whole in _columns(layout):
        if name in df.columns:
            missing = "-1" if name in UNKNOWN or whole else "nan"
            cells.append(F.when(F.col(name).isNull(), missing).otherwise(F.col(name).cast("long").cast("string") if whole else F.format_string(f"%.{digits}f", F.col(name).cast("double"))))
    lines = df.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(order or [])], F.concat_ws(separator, *cells).alias("value"))
    if not header and not order:
        lines.write.text(path)
        return
    sort = [f"__{k}" for k in range(len(order or []))]
    write_lines(lines.orderBy(*sort).select("value") if sort else lines, path, header)


def write_lines(lines: DataFrame, path: str, header: tuple[str, ...] = ()) -> None:
    """One text file: the header's lines, then those of ``lines`` in their order."""
    from ringfold.sources.binaries import write_stream

    def parts() -> Iterator[bytes]:
        held = [x + "\n" for x in header]
        for r in lines.toLocalIterator():
            held.append(r.value + "\n")
            if len(held) > 20_000:
                yield "".join(held).encode()
                held = []
        yield "".join(held).encode()

    write_stream(lines.sparkSession, path, parts())


#: The header of a table of grains but for its first line and its column names.
_GRAINS_HEADER = ("%BeamCenter 0 0", "%BeamThickness 0", "%GlobalPosition 0", "%NumPhases 1", "%PhaseInfo")


def write_grains(df: DataFrame, path: str, space_group: int = 225, lattice: tuple[float, ...] = (0.0,) * 6) -> None:
    """Nine header lines, then tab-separated rows by GrainID; all 53 columns of ``GRAINS``, those that df lacks as nan."""
    named = _columns(GRAINS)
    full = df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n, _ in named])
    header = (f"%NumGrains {df.count()}", *_GRAINS_HEADER, f"%\tSpaceGroup:{space_group}", "%\tLattice Parameter:" + "\t".join(f"{x:.6f}" for x in lattice), "%ID\t" + "\t".join(n for n, _ in named[1:]))
    write_table(full, path, GRAINS, 9, header, "\t", ["GrainID"])


def read_grains(spark: SparkSession, path: str) -> DataFrame:
    """Grains of 47 or 53 columns, and those of 24; the number that the first line promises must be there."""
    first = spark.read.text(path).where(F.col("value").startswith("%NumGrains")).first()
    if first is None:
        raise ValueError(f"{path}: no line tells the number of grains")
    rows = read_table(spark, path, GRAINS, least=23)
    return rows.limit(int(first.value.split()[1]))


def write_profile_text(df: DataFrame, path: str, kind: str, x: str, y: str, sigma: str | None = None, title: str = "profile", wavelength: float = 1.0, notes: tuple[str, ...] = ()) -> None:
    """A profile as one ordered text file: csv, xye, fxye (hundredths of a degree, with a BANK line), esg, dat, or xy. ``notes`` become comment lines."""
    notes = tuple(f"# {n}" for n in notes)
    # a value that is missing is written as not a number
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in (y, *([sigma] if sigma else []))})
    if kind in ("xye", "fxye", "esg") and sigma is None:
        raise ValueError(f"{kind} needs a standard deviation")
    if kind in ("csv", "dat", "xy", "xye"):
        separator = "," if kind == "csv" else " "
        form = separator.join(["%.6e"] * (3 if sigma else 2))
        head = (*notes, "# " + separator.join(["R_px", "intensity", *(["sigma"] if sigma else [])]))
        write_lines(df.orderBy(x).select(F.format_string(form, *[F.col(c).cast("double") for c in (x, y, *([sigma] if sigma else []))]).alias("value")), path, head)
        return
    ends = df.agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    second = df.where(F.col(x) > ends.lo).agg(F.min(x).alias("s")).first().s
    step = (second - ends.lo) if second is not None else 0.0
    if kind == "fxye":
        head = (f"{title:<80s}", *notes, f"BANK 1 {ends.n} {ends.n} CONST {100 * ends.lo:.5f} {100 * step:.5f} 0 0 FXYE")
        write_lines(df.orderBy(x).select(F.format_string("%14.5f %14.5e %14.5e", F.col(x) * 100.0, F.col(y).cast("double"), F.col(sigma).cast("double")).alias("value")), path, head)
    elif kind == "esg":
        head = (*notes, f"_pd_block_id {title}", f"_diffrn_radiation_wavelength {wavelength:.6f}", f"_pd_meas_2theta_range_min {ends.lo:.6f}", f"_pd_meas_2theta_range_max {ends.hi:.6f}", f"_pd_meas_2theta_range_inc {step:.6f}",
            "loop_", "_pd_meas_2theta", "_pd_proc_intensity_total", "_pd_proc_intensity_total_su")
        write_lines(df.orderBy(x).select(F.format_string("%.6f %.6e %.6e", F.col(x).cast("double"), F.col(y).cast("double"), F.col(sigma).cast("double")).alias("value")), path, head)
    else:
        raise ValueError(f"unknown kind of profile {kind}")


def read_profile_text(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(x, y, sigma) of a profile's numbers; angles of fxye come back in degrees."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,]+").alias("p")).where(F.col("p")[0].rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"))
    scale = 100.0 if kind == "fxye" else 1.0
    return cells.select((F.col("p")[0].cast("double") / scale).alias("x"), F.col("p")[1].cast("double").alias("y"), F.get("p", F.lit(2)).cast("double").alias("sigma"))


def write_cake_text(df: DataFrame, path: str, kind: str, a: str, b: str, value: str, hkl: tuple[int, int, int] = (1, 1, 1)) -> None:
    """A two-dimensional map for texture programs: xpc and epf (a row for each pair of angles), pol (a line of values for each b), in order of a, then b."""
    if kind in ("xpc", "epf"):
        n_a, n_b = df.select(a).distinct().count(), df.select(b).distinct().count()
        head = (f"# cake | n_eta {n_a} n_R {n_b}", "# eta_deg px intensity") if kind == "xpc" else (f"# pole figure | hkl={hkl[0]} {hkl[1]} {hkl[2]}", "# alpha_deg beta_deg intensity")
        write_lines(df.orderBy(a, b).select(F.format_string("%.5f %.5f %.6e", *[F.col(c).cast("double") for c in (a, b, value)]).alias("value")), path, head)
        return
    if kind != "pol":
        raise ValueError(f"unknown kind of map {kind}")
    steps = {c: [r[0] for r in df.select(c).distinct().orderBy(c).limit(2).collect()] for c in (a, b)}
    n = {c: df.select(c).distinct().count() for c in (a, b)}
    head = (f"# pole figure | hkl={hkl[0]} {hkl[1]} {hkl[2]}", f"# alpha_step={steps[a][-1] - steps[a][0]:.4f} beta_step={steps[b][-1] - steps[b][0]:.4f}", f"# n_alpha={n[a]} n_beta={n[b]}")
    line = df.groupBy(b).agg(F.sort_array(F.collect_list(F.struct(F.col(a).alias("a"), F.format_string("%.6e", F.col(value).cast("double")).alias("v")))).alias("l"))
    write_lines(line.orderBy(b).select(F.array_join(F.col("l.v"), " ").alias("value")), path, head)


def read_extra(spark: SparkSession, path: str) -> DataFrame:
    """Input tables of 18 to 21 columns, told by their width: OrigSpotID and ReturnCode are there from 20 on, DetID (1 where it is absent) stands last in those of odd width."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.col("p")[0].rlike(r"^[-+.0-9]"))
    n = F.size("p")
    fine = lines.withColumn("p", F.when(n.isin(18, 19, 20, 21), F.col("p")).otherwise(F.raise_error(F.lit("a row has neither 18 nor 19, 20 or 21 columns"))))
    out = []
    for k, (name, whole) in enumerate(_columns(INPUTALL_EXTRA)):
        x = F.get("p", F.lit(k)).cast("double")
        x = F.when((n >= 20) & (x != -1), x) if name in UNKNOWN else F.when(~F.isnan(x), x)
        out.append((x.cast("long") if whole else x).alias(name))
    return fine.select(*out, F.when(n % 2 == 1, F.element_at("p", -1).cast("double").cast("long")).otherwise(1).alias("DetID"))


def read_reflections(spark: SparkSession, path: str, rings: list[int] | None = None) -> DataFrame:
    """Reflections of the given rings (all by default); Theta comes in radians, lines of fewer than eleven numbers are skipped."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where((F.size("p") >= 11) & F.col("p")[0].rlike(r"^[-+.0-9]"))
    out = lines.select(*[F.col("p")[k].cast("double").cast("long" if whole else "double").alias(name) for k, (name, whole) in enumerate(_columns(HKLS))])
    out = out.withColumn("Theta", F.radians("Theta"))
    return out.where(F.col("RingNr").isin(rings)) if rings is not None else out


def read_row_band(spark: SparkSession, path: str, height: int, width: int, lo: int, hi: int, dtype: str = "<u2") -> DataFrame:
    """(frame, y, x, v) of the pixels that aren't zero in rows lo to hi (exclusive) of all raw frames of a file. A record is one row of pixels, so the file splits between tasks and other rows are never decoded."""
    one = np.dtype(dtype)
    size = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(width * one.itemsize)}
    raw = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=size)
    band = spark.createDataFrame(raw, "row long, record binary").where((F.col("row") % height >= lo) & (F.col("row") % height < hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), one).reshape(-1, width)
            k, x = np.nonzero(v)
            row = batch.column(0).to_numpy()[k]
            yield pa.RecordBatch.from_arrays([pa.array(row // height), pa.array(row % height), pa.array(x), pa.array(v[k, x].astype(float))], ["frame", "y", "x", "v"])

    return band.mapInArrow(run, "frame long, y long, x long, v double")


def read_seed_values(spark: SparkSession, path: str) -> DataFrame:
    """(n, theta): the numbers of a text file, one to a line, with their places."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "v")).where("trim(v) <> ''")
    return lines.select("n", F.col("v").cast("double").alias("theta"))


def read_cube(spark: SparkSession, path: str, rows: int, width: int) -> DataFrame:
    """(slice, n, t, v) of a cube of single floats, (slices, rows, width); its size must be whole slices."""
    size = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(rows * width * 4)}
    raw = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v, at = np.frombuffer(record, "<f4"), np.arange(rows * width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array((at // width).astype(np.int32)), pa.array(at % width), pa.array(v)], ["slice", "n", "t", "v"])

    return spark.createDataFrame(raw, "row long, record binary").mapInArrow(run, "slice long, n int, t long, v float")


def read_seed_ids(spark: SparkSession, path: str) -> DataFrame:
    """(seq, SpotID): the first number of each line, in the file's order; lines that begin otherwise are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "v"))
    found = lines.select("line", F.regexp_extract("v", r"^\s*([-+]?[0-9]+)(\s|$)", 1).alias("n")).where("n <> ''")
    return found.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("seq"), F.col("n").cast("long").alias("SpotID"))


def discovered(spark: SparkSession, pattern: str) -> DataFrame:
    """(folder, stem, ext, padding, first, last, n) of the numbered files that match: ``stem_000123.ext``."""
    names = spark.read.format("binaryFile").load(pattern).select("path")
    m = r"^(.*)/([^/]*?)_?([0-9]+)(\.[^/0-9][^/]*)$"
    parts = names.select(*[F.regexp_extract("path", m, k).alias(c) for k, c in ((1, "folder"), (2, "stem"), (3, "num"), (4, "ext"))]).where("num <> ''")
    return parts.groupBy("folder", "stem", "ext", F.length("num").alias("padding")).agg(F.min(F.col("num").cast("long")).alias("first"), F.max(F.col("num").cast("long")).alias("last"), F.count("*").alias("n"))


def read_cif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((key, value) of a crystal file's single items, (site, key, value) of its loop of atoms). Uncertainties in brackets are dropped."""
    text = spark.read.text(path, wholetext=True).first().value
    items, atoms, lines, k = [], [], [x.strip() for x in text.split("\n")], 0
    while k < len(lines):
        if lines[k] == "loop_":
            names, k = [], k + 1
            while k < len(lines) and lines[k].startswith("_"):
                names.append(lines[k])
                k += 1
            site = 0
            while k < len(lines) and lines[k] and not lines[k].startswith(("_", "loop_", "data_", "#")):
                if any(n.startswith("_atom_site_") for n in names):
                    atoms += [(site, n, _plain(v)) for n, v in zip(names, _tokens(lines[k]), strict=False)]
                site, k = site + 1, k + 1
            continue
        cells = _tokens(lines[k]) if lines[k].startswith("_") else []
        if len(cells) == 2:
            items.append((cells[0], _plain(cells[1])))
        k += 1
    return spark.createDataFrame(items, "key string, value string"), spark.createDataFrame(atoms, "site int, key string, value string")


def _tokens(line: str) -> list[str]:
    return [a or b or c for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", line)]


def _plain(value: str) -> str:
    return re.sub(r"\([0-9]+\)$", "", value)


def write_cif(path: str, spark: SparkSession, name: str, cell: tuple[float, ...], space_group: int, atoms: list[tuple[str, float, float, float, float]]) -> None:
    """A crystal file of a cell (a, b, c, alpha, beta, gamma), a space group's number, and atoms (symbol, x, y, z, occupancy)."""
    keys = ("_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_angle_alpha", "_cell_angle_beta", "_cell_angle_gamma")
    lines = [f"data_{name}", *[f"{k} {v:.6f}" for k, v in zip(keys, cell, strict=True)], f"_space_group_IT_number {space_group}", "loop_", "_atom_site_type_symbol", "_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z", "_atom_site_occupancy"]
    lines += [f"{s} {x:.6f} {y:.6f} {z:.6f} {o:.4f}" for s, x, y, z, o in atoms]
    write_lines(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, value string").orderBy("k").select("value"), path)


def read_packed(spark: SparkSession, path: str, layout: str, width: int | None = None) -> DataFrame:
    """Packed little-endian doubles, ``width`` to a row (all of the layout by default); a torn record is an error. ``row`` is the place in the file."""
    named = _columns(layout)[: width or None]
    n = width or len(named)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(blob.as_buffer(), "<f8")
                if len(raw) % n:
                    raise ValueError(f"{name}: a record is torn")
                table = raw.reshape(-1, n)
                for k in range(0, len(table), 1 << 16):
                    part = table[k : k + (1 << 16)]
                    cells = [pa.array(part[:, j].astype(np.int64) if whole else part[:, j].copy()) for j, (_, whole) in enumerate(named)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(k, k + len(part))), *cells], ["file", "row", *[x for x, _ in named]])

    kinds = ", ".join(f"`{x}` {'long' if whole else 'double'}" for x, whole in named)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, f"file string, row long, {kinds}")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, seq, values) of parameter files: a key and values between white space, # begins a comment, repeated keys of a file count up in ``seq``."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "v"))
    parts = lines.select("file", "line", F.split(F.trim(F.regexp_replace("v", r"#.*$", "")), r"\s+").alias("p")).where(F.col("p")[0] != "")
    order = Window.partitionBy("file", F.col("p")[0]).orderBy("line")
    return parts.select("file", F.col("p")[0].alias("key"), (F.row_number().over(order) - 1).alias("seq"), F.expr("slice(p, 2, size(p) - 1)").alias("values"))


def typed_parameters(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(file, key, seq, place, number, text, problem): values by the kinds (int, float or str) of the keys that are known; a value that isn't of its kind has a problem, and so has a key that isn't known."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else F.create_map().cast("map<string,string>")
    each = raw.select("file", "key", "seq", F.posexplode("values").alias("place", "text"), kind[F.col("key")].alias("kind"))
    number = F.expr("try_cast(text AS DOUBLE)")
    wrong = F.when(F.col("kind").isNull(), "unknown key").when((F.col("kind") == "int") & ~F.col("text").rlike(r"^[-+]?[0-9]+$"), "not a whole number").when((F.col("kind") == "float") & number.isNull(), "not a number")
    return each.select("file", "key", "seq", "place", F.when(F.col("kind") != "str", number).alias("number"), "text", wrong.alias("problem"))


def read_frames(spark: SparkSession, path: str, height: int, width: int, dtype: str = "<u2", header: int = 0) -> DataFrame:
    """(file, frame, pixels): raw frames in files after a header of ``header`` bytes, a row each; pixels stay bytes."""
    size = height * width * np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = blob.as_buffer().to_pybytes()[header:]
                if len(raw) % size:
                    raise ValueError(f"{name}: a frame is torn")
                for k in range(len(raw) // size):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([raw[k * size : (k + 1) * size]], pa.binary())], ["file", "frame", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, frame long, pixels binary")


def pixels_over(frames: DataFrame, width: int, dtype: str = "<u2", threshold: float = 0.0, keys: tuple[str, ...] = ("file", "frame")) -> DataFrame:
    """(keys, y, x, v) of pixels above a threshold: dense frames become rows only after it."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in enumerate(batch.column(len(keys))):
                v = np.frombuffer(blob.as_buffer(), dtype)
                at = np.flatnonzero(v > threshold)
                if len(at):
                    own = [pa.array([c[k].as_py()] * len(at), c.type) for c in batch.columns[: len(keys)]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(at // width), pa.array(at % width), pa.array(v[at].astype(float))], [*keys, "y", "x", "v"])

    kinds = dict(frames.dtypes)
    return frames.select(*keys, "pixels").mapInArrow(pick, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y long, x long, v double")
