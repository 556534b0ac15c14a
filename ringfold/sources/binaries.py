"""Legacy binary files as tables: packed records, offset tables with ragged records, headered maps, bit masks and payloads.

Packed records of one width are read by Spark's fixed-length input, which splits a file of
any size over tasks and numbers the records. Files of slots are written and read in pieces by
many tasks where the folder is one that all see as their own. Others that begin with a table of
offsets are read whole, one file to a task; runs larger than that come in several files, whose
tables are put together by ``merged_slots``. The other legacy writers make a single file as one stream of
ordered parts: the file has one end, so it has one writer; Parquet is the container that
scales.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Records on disk, in order; O11 to O33 is a rotation by rows.
_ROTATION = "O11 O12 O13 O21 O22 O23 O31 O32 O33"


def _doubles(names: str) -> np.dtype:
    return np.dtype([(x, "<f8") for x in names.split()])


RECORDS = {
    "spots": _doubles("Y Z Omega GrainRadius SpotID RingNumber Eta Ttheta RadiusDistIdeal"),
    "scan_spots": _doubles("Y Z Omega GrainRadius SpotID RingNumber Eta Ttheta RadiusDistIdeal ScanNr"),
    "extra_info": _doubles(" ".join(f"e{k}" for k in range(16))),
    "bin_rows": np.dtype([("row_nr", "<i4")]),
    "bin_ranges": np.dtype([("n", "<i4"), ("begin", "<i4")]),
    "scan_bin_rows": np.dtype([("row_nr", "<i8"), ("scan_nr", "<i8")]),
    "scan_bin_ranges": np.dtype([("n", "<i8"), ("begin", "<i8")]),
    "best_seeds": _doubles(f"AvgIA {_ROTATION} X Y Z NTheor NMatches"),
    "weighted_seeds": _doubles("WeightedMatches WeightedShare"),
    "refined_27": _doubles(f"id0 {_ROTATION} id1 X Y Z id2 a b c alpha beta gamma id3 DiffPos DiffOme DiffAngle MeanRadius Completeness"),
    "refined_33": _doubles(f"id0 {_ROTATION} id1 X Y Z id2 a b c alpha beta gamma id3 DiffPos DiffOme DiffAngle MeanRadius Completeness PosPre OmePre AnglePre PosPost OmePost AnglePost"),
    "keep_key": np.dtype([("keep", "<i4"), ("n_ids", "<i4")]),
    "voxels": _doubles("OrientationRowNr OrientationID RunTime X Y TriEdgeSize UpDown Eul1 Eul2 Eul3 Confidence"),
    "predicted_spots": _doubles("yl zl omega"),
    "orientations": _doubles(_ROTATION),
}
#: Records of the files with a table of offsets.
PEAK = _doubles(
    "SpotID IntegratedIntensity Omega YCen ZCen IMax Radius Eta SigmaR SigmaEta NrPixels NrPxTot NPeaks MaxY MaxZ DiffY DiffZ RawIMax ReturnCode "
    "RetVal BG SigmaGR SigmaLR SigmaGEta SigmaLEta Mu RawSumIntensity MaskTouched FitRMSE")
SOLUTION = _doubles(" ".join(f"v{k}" for k in range(16)))
SOLUTION_KEY = np.dtype([("SpotID", "<u8"), ("NMatches", "<u8"), ("NIDs", "<u8"), ("Best", "<u8")])
SPOT_ID = np.dtype([("SpotID", "<i4")])
MAP_PIXEL = np.dtype([("y", "<f4"), ("z", "<f4"), ("frac", "<f8"), ("delta_r", "<f4"), ("area_weight", "<f4")])
DIAGNOSTIC = _doubles("theorY theorZ theorOmega theorEta ringNr theorSpotID theorGx theorGy theorGz theorScanNr matched obsY obsZ obsOmega obsSpotID obsScanNr IA diffLen diffOme")
DIAGNOSTIC_META = _doubles("posX0 posX posY posZ euler1 euler2 euler3 a b c alpha beta gamma")
_DIAGNOSTIC_MAGIC, _MAP_MAGIC, _MAP_VERSION = 0x47414944, 0x3050414D, 3
#: Payload types of frames by code; 6 is 16-bit with a list of pixels that overflow.
PAYLOADS = {0: "u1", 1: "<u2", 2: "<u4", 3: "<i8", 4: "<f4", 5: "<f8", 6: "hybrid"}

_SQL = {"f8": "double", "f4": "float", "i4": "int", "i8": "long", "u8": "decimal(20,0)"}


def _ddl(kind: np.dtype) -> str:
    return ", ".join(f"`{n}` {_SQL[kind[n].str[1:]]}" for n in kind.names)


def _columns(records: np.ndarray) -> list[pa.Array]:
    out = []
    for n in records.dtype.names:
        x = np.ascontiguousarray(records[n])
        out.append(pa.array(x).cast(pa.decimal128(20, 0)) if x.dtype == "<u8" else pa.array(x))
    return out


def _packed(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    out = np.empty(batch.num_rows, kind)
    for n in kind.names:
        x = batch.column(batch.schema.get_field_index(n))
        out[n] = (x.cast(pa.uint64()) if kind[n].str == "<u8" else x).to_numpy(zero_copy_only=False)
    return out


def write_stream(spark: SparkSession, path: str, parts: Iterator[bytes]) -> None:
    """One file of all parts, through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for part in parts:
            for k in range(0, len(part), 8 << 20):
                out.write(bytearray(part[k : k + (8 << 20)]))
    finally:
        out.close()


def _ordered_parts(df: DataFrame, order: list[str], pack: Callable[[pa.RecordBatch], bytes]) -> Iterator[bytes]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pack(batch)], pa.binary())], ["part"])

    for row in df.orderBy(*order).mapInArrow(run, "part binary").toLocalIterator():
        yield bytes(row.part)


def write_records(df: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """Packed records of the columns that the kind names, in order."""
    layout = RECORDS[kind]
    write_stream(df.sparkSession, path, _ordered_parts(df.select(*layout.names, *[c for c in order if c not in layout.names]), order, lambda b: _packed(b, layout).tobytes()))


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(row, the kind's columns): packed records of one file, split over tasks; a torn last record is an error."""
    layout = RECORDS[kind]
    size = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(layout.itemsize)}
    raw = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=size)
    records = spark.createDataFrame(raw, "row long, record binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), layout)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(found)], ["row", *layout.names])

    return records.mapInArrow(run, f"row long, {_ddl(layout)}")


def refined_width(spark: SparkSession, path: str) -> str:
    """The kind of a file of refined seeds, which repeats the seed's id in four columns: the one width at which these agree."""
    content = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 1 << 20).alias("head")).first()
    fits = []
    for kind in ("refined_27", "refined_33"):
        layout = RECORDS[kind]
        if content.length % layout.itemsize == 0:
            rows = np.frombuffer(bytes(content.head)[: len(content.head) // layout.itemsize * layout.itemsize], layout)
            if all((rows["id0"] == rows[f"id{k}"]).all() for k in (1, 2, 3)):
                fits.append(kind)
    if len(fits) != 1:
        raise ValueError(f"{path}: the width of its records can't be told, it may be {fits}")
    return fits[0]


def _whole(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                for columns in decode(blob.as_buffer().to_pybytes()):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _offsets(raw: bytes, lead: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    if n < 0 or len(raw) < 4 + lead + 12 * n:
        raise ValueError("the table of offsets is torn")
    return np.frombuffer(raw, "<i4", n, 4 + lead), np.frombuffer(raw, "<i8", n, 4 + lead + 4 * n)


#: Records that are read at once.
PIECE = 1 << 15


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the file system that all tasks see as their own, None for any other kind."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def read_slots(spark: SparkSession, path: str, layout: np.dtype) -> DataFrame:
    """(slot, place, the layout's columns) of a file with a count and an offset for each slot (a frame or a voxel). A file of a shared folder is read in pieces of ``PIECE`` records; one of any other system is one task's work."""

    def decode(raw: bytes) -> Iterator[list[pa.Array]]:
        counts, offsets = _offsets(raw, 0)
        for slot in np.flatnonzero(counts > 0).tolist():
            n = int(counts[slot])
            if len(raw) < offsets[slot] + n * layout.itemsize:
                raise ValueError(f"slot {slot} is torn")
            records = np.frombuffer(raw, layout, n, int(offsets[slot]))
            yield [pa.array(np.full(n, slot, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *_columns(records)]

    schema = f"slot int, place int, {_ddl(layout)}"
    local = _local(spark, path)
    if local is None or not os.path.isfile(local):
        return _whole(spark, path, decode, schema)
    size = os.path.getsize(local)
    with open(local, "rb") as f:
        n = int(np.frombuffer(f.read(4), "<i4")[0]) if size >= 4 else -1
        if n < 0 or size < 4 + 12 * n:
            raise ValueError("the table of offsets is torn")
        counts, offsets = np.frombuffer(f.read(4 * n), "<i4").astype(np.int64), np.frombuffer(f.read(8 * n), "<i8")
    held = np.flatnonzero(counts > 0)
    for slot in held[offsets[held] + counts[held] * layout.itemsize > size][:1].tolist():
        raise ValueError(f"slot {slot} is torn")
    # a piece begins at a slot and place, and may hold many slots or a part of one
    ends = np.cumsum(counts[held])
    starts = np.arange(0, int(ends[-1]) if len(ends) else 0, PIECE)
    at = np.searchsorted(ends, starts, "right")
    pieces = [(int(held[i]), int(g - (ends[i] - counts[held[i]])), int(min(PIECE, ends[-1] - g))) for i, g in zip(at, starts, strict=True)]
    names = ["slot", "place", *layout.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(local, "rb") as f:
            for batch in batches:
                for slot, place, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    # the slots that the piece can reach
                    many = min(n - slot, rows + 1)
                    while True:
                        f.seek(4 + 4 * slot)
                        held = np.frombuffer(f.read(4 * many), "<i4").astype(np.int64)
                        if slot + many == n or np.maximum(held, 0).sum() - place >= rows:
                            break
                        many = min(n - slot, 2 * many)
                    f.seek(4 + 4 * n + 8 * slot)
                    begins = np.frombuffer(f.read(8 * many), "<i8").copy()
                    held = np.maximum(held, 0)
                    held[0] -= place
                    begins[0] += place * layout.itemsize
                    took = np.minimum(held, np.maximum(rows - (np.cumsum(held) - held), 0))
                    use = np.flatnonzero(took)
                    raw = bytearray()
                    cuts = [0, *(np.flatnonzero(begins[use][1:] != begins[use][:-1] + took[use][:-1] * layout.itemsize) + 1).tolist(), len(use)]
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        f.seek(int(begins[use[i]]))
                        raw += f.read(int(took[use[i:j]].sum()) * layout.itemsize)
                    slots = np.repeat(use, took[use])
                    places = np.arange(rows) - np.repeat(np.cumsum(took[use]) - took[use], took[use]) + np.where(slots == 0, place, 0)
                    yield pa.RecordBatch.from_arrays([pa.array((slots + slot).astype(np.int32)), pa.array(places.astype(np.int32)), *_columns(np.frombuffer(bytes(raw), layout))], names)

    wide = max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame(spark.sparkContext.parallelize(pieces, wide), "slot int, place long, rows int")
    return rows.mapInArrow(run, schema)


def write_slots(df: DataFrame, path: str, layout: np.dtype, slots: int) -> None:
    """``df``: (slot, place, the layout's columns), slots from 0; those without rows stay empty. In a shared folder tasks write their rows at their places themselves."""
    counts = np.zeros(slots, "<i4")
    told = df.groupBy("slot").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).toArrow()
    at, n, low, high = (told.column(k).to_numpy() for k in range(4))
    counts[at] = n
    size = counts.astype("<i8") * layout.itemsize
    offsets = (4 + 12 * slots + np.cumsum(size) - size).astype("<i8")
    head = struct.pack("<i", slots) + counts.tobytes() + offsets.tobytes()
    local = _local(df.sparkSession, path)
    rows = df.select("slot", "place", *layout.names)
    if local is not None and (low == 0).all() and (high == n - 1).all():
        os.makedirs(os.path.dirname(local), exist_ok=True)
        stale = os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.crc")
        if os.path.exists(stale):
            os.remove(stale)
        with open(local, "wb") as f:
            f.write(head)
            f.truncate(len(head) + int(size.sum()))
        begins = df.sparkSession.sparkContext.broadcast(offsets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, twice = None, 0
            with open(local, "r+b") as f:
                for batch in batches:
                    if batch.num_rows:
                        to = begins.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy().astype(np.int64) * layout.itemsize
                        twice += int((np.diff(to) == 0).sum()) + int(last == to[0])
                        last, packed = to[-1], _packed(batch, layout)
                        cuts = [0, *(np.flatnonzero(np.diff(to) != layout.itemsize) + 1).tolist(), len(to)]
                        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                            f.seek(int(to[i]))
                            f.write(packed[i:j].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([twice], pa.int64())], ["twice"])

        # equal places come to one task; as many rows as places, none of them twice, fill all
        if not rows.orderBy("slot", "place").mapInArrow(run, "twice long").agg(F.sum("twice")).first()[0]:
            return

    def parts() -> Iterator[bytes]:
        yield head
        yield from _ordered_parts(rows, ["slot", "place"], lambda b: _packed(b, layout).tobytes())

    write_stream(df.sparkSession, path, parts())


def merged_slots(blocks: list[DataFrame]) -> DataFrame:
    """Tables of one file kind from several blocks as one: a slot's rows come from the first block that has any."""
    every = None
    for k, b in enumerate(blocks):
        b = b.withColumn("__block", F.lit(k))
        every = b if every is None else every.unionByName(b)
    return every.withColumn("__first", F.min("__block").over(Window.partitionBy("slot"))).where("__block = __first").drop("__block", "__first")


def read_peak_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(slot, peak, place, y, z): the pixels of each frame's peaks."""

    def decode(raw: bytes) -> Iterator[list[pa.Array]]:
        counts, offsets = _offsets(raw, 4)
        for slot in np.flatnonzero(counts > 0).tolist():
            at, peaks, found = int(offsets[slot]), [], []
            for peak in range(int(counts[slot])):
                n = int(np.frombuffer(raw, "<i4", 1, at)[0])
                found.append(np.frombuffer(raw, "<i2", 2 * n, at + 4).reshape(n, 2))
                peaks.append(np.full(n, peak, np.int32))
                at += 4 + 4 * n
            yz, peak = np.concatenate(found), np.concatenate(peaks)
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
            yield [pa.array(np.full(len(yz), slot, np.int32)), pa.array(peak), pa.array(place), pa.array(yz[:, 0].astype(np.int32)), pa.array(yz[:, 1].astype(np.int32))]

    return _whole(spark, path, decode, "slot int, peak int, place int, y int, z int")


def write_peak_pixels(df: DataFrame, path: str, slots: int, pixels: int) -> None:
    """``df``: (slot, peak, place, y, z); peaks of a slot are numbered from 0 without a gap."""
    listed = df.groupBy("slot", "peak").agg(F.sort_array(F.collect_list(F.struct("place", "y", "z"))).alias("yz"))
    counts, size = np.zeros(slots, "<i4"), np.zeros(slots, "<i8")
    for r in listed.groupBy("slot").agg(F.count("*").alias("n"), F.sum(4 + 4 * F.size("yz")).alias("b")).collect():
        counts[r.slot], size[r.slot] = r.n, r.b
    head = struct.pack("<ii", slots, pixels) + counts.tobytes() + (8 + 12 * slots + np.cumsum(size) - size).astype("<i8").tobytes()

    def pack(batch: pa.RecordBatch) -> bytes:
        out = []
        for yz in batch.column(2).to_pylist():
            out += [struct.pack("<i", len(yz)), np.array([(p["y"], p["z"]) for p in yz], "<i2").tobytes()]
        return b"".join(out)

    def parts() -> Iterator[bytes]:
        yield head
        yield from _ordered_parts(listed, ["slot", "peak"], pack)

    write_stream(df.sparkSession, path, parts())


def read_padded(spark: SparkSession, path: str, width: int, dtype: str = "<i4") -> DataFrame:
    """(slot, place, value): slots of ``width`` values of a file whose last slot may be short; what is missing, and zeros, are left out."""
    one = np.dtype(dtype)

    def decode(raw: bytes) -> Iterator[list[pa.Array]]:
        if len(raw) % one.itemsize:
            raise ValueError("a value is torn")
        values = np.frombuffer(raw, one)
        for a in range(0, len(values), 1 << 20):
            part = values[a : a + (1 << 20)]
            at = np.flatnonzero(part)
            yield [pa.array((a + at) // width), pa.array((a + at) % width), pa.array(part[at])]

    return _whole(spark, path, decode, f"slot long, place long, value {_SQL[one.str[1:]]}")


def write_padded(df: DataFrame, path: str, width: int, dtype: str = "<i4") -> None:
    """``df``: (slot, values), slots from 0 without a gap; every slot but the last is filled up with zeros."""
    last = df.agg(F.max("slot").alias("m")).first().m

    def pack(batch: pa.RecordBatch) -> bytes:
        out = []
        for slot, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.append(np.array(values + [0] * (0 if slot == last else width - len(values)), dtype).tobytes())
        return b"".join(out)

    write_stream(df.sparkSession, path, _ordered_parts(df.select("slot", "values"), ["slot"], pack))


def write_diagnostics(spots: DataFrame, voxels: DataFrame, path: str, version: int = 2, sentinel: float = -999.0) -> None:
    """Every predicted spot of every voxel. ``spots``: (voxel, place, the columns of DIAGNOSTIC), ``voxels``: (voxel, the columns of DIAGNOSTIC_META)."""
    n = spots.groupBy("voxel").agg(F.count("*").alias("n"), F.sum((F.col("matched") != 0).cast("int")).alias("m"))
    rows = voxels.join(n, "voxel", "left").na.fill(0, ["n", "m"]).orderBy("voxel").collect()
    directory = np.array([(r.voxel, r.n, r.m) for r in rows], "<i4").reshape(-1, 3)
    meta = np.array([tuple(r[c] for c in DIAGNOSTIC_META.names) for r in rows], "<f8").reshape(-1, 13)

    def parts() -> Iterator[bytes]:
        yield struct.pack("<IIii", _DIAGNOSTIC_MAGIC, version, len(rows), len(DIAGNOSTIC.names)) + struct.pack("<d", sentinel) + bytes(40) + directory.tobytes() + meta.tobytes()
        yield from _ordered_parts(spots.select("voxel", "place", *DIAGNOSTIC.names), ["voxel", "place"], lambda b: _packed(b, DIAGNOSTIC).tobytes())

    write_stream(spots.sparkSession, path, parts())


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """(voxel, place, the columns of DIAGNOSTIC); the sentinel becomes null."""

    def decode(raw: bytes) -> Iterator[list[pa.Array]]:
        magic, version, n, width = struct.unpack_from("<IIii", raw)
        if magic != _DIAGNOSTIC_MAGIC or version not in (1, 2) or width != len(DIAGNOSTIC.names):
            raise ValueError("not a file of spot diagnostics, or of a version that isn't known")
        sentinel = struct.unpack_from("<d", raw, 16)[0]
        directory = np.frombuffer(raw, "<i4", 3 * n, 64).reshape(n, 3)
        at = 64 + 12 * n + 13 * 8 * n
        for voxel, rows, _ in directory.tolist():
            found = np.frombuffer(raw, DIAGNOSTIC, rows, at)
            at += rows * DIAGNOSTIC.itemsize
            yield [pa.array(np.full(rows, voxel, np.int32)), pa.array(np.arange(rows, dtype=np.int32)), *[pa.array(found[c], mask=found[c] == sentinel) for c in DIAGNOSTIC.names]]

    return _whole(spark, path, decode, f"voxel int, place int, {_ddl(DIAGNOSTIC)}")


def parameter_hash(values: dict[str, float], transforms: list[int] | None = None) -> bytes:
    """SHA-256 of the geometry that a pixel map was made with; another value in any of them makes another hash."""
    # fixed values: the names and formats of what is hashed
    six = "BC EtaBinSize EtaMax EtaMin Lsd NrPixelsY NrPixelsZ Parallax RBinSize RMax RMin RhoD".split()

    def said(name: str) -> str:
        if name == "BC":
            return f"BC={values['Ycen']:.6f},{values['Zcen']:.6f}"
        return f"{name}={int(values[name])}" if name.startswith("NrPixels") else f"{name}={values.get(name, 0.0):.6f}"

    turns = transforms or []
    head = "|".join([*map(said, six), f"TransOpt={len(turns)}", f"Wavelength={values.get('Wavelength', 0.0):.8f}"]) + "".join(f",{t}" for t in turns[:10])
    tail = [f"p{k}={values.get(f'p{k}', 0.0):.6f}" for k in range(15)] + [f"{k}={values.get(k, 0.0):.6f}" for k in ("pxY", "pxZ", "tx", "ty", "tz")]
    return hashlib.sha256("|".join([head, *tail, *(["qMode=1"] if values.get("qMode") else [])]).encode()).digest()


def write_map(df: DataFrame, pixels_path: str, ranges_path: str, bins: int, digest: bytes) -> None:
    """A pixel map: ``df`` (bin, place, the columns of MAP_PIXEL), bins from 0; both files carry the header with the parameters' hash."""
    spark = df.sparkSession
    counts = np.zeros(bins, "<i4")
    for r in df.groupBy("bin").agg(F.count("*").alias("n")).collect():
        counts[r.bin] = r.n
    head = struct.pack("<II", _MAP_MAGIC, _MAP_VERSION) + digest + bytes(24)

    def parts() -> Iterator[bytes]:
        yield head
        yield from _ordered_parts(df.select("bin", "place", *MAP_PIXEL.names), ["bin", "place"], lambda b: _packed(b, MAP_PIXEL).tobytes())

    write_stream(spark, pixels_path, parts())
    write_stream(spark, ranges_path, iter([head + np.stack([counts, np.cumsum(counts) - counts], axis=1).astype("<i4").tobytes()]))


def read_map(spark: SparkSession, pixels_path: str, ranges_path: str, digest: bytes | None = None) -> DataFrame:
    """(bin, place, the columns of MAP_PIXEL). A map made with other parameters than ``digest`` tells is an error; a file without a header is taken as it is."""
    ranges = bytes(spark.read.format("binaryFile").load(ranges_path).first().content)
    headed = len(ranges) >= 64 and struct.unpack_from("<I", ranges)[0] == _MAP_MAGIC
    if headed and digest is not None and ranges[8:40] != digest:
        raise ValueError("the map was made with other parameters")
    counts = np.frombuffer(ranges, "<i4", -1, 64 if headed else 0).reshape(-1, 2)
    ends = np.cumsum(counts[:, 0])

    def decode(raw: bytes) -> Iterator[list[pa.Array]]:
        start = 64 if struct.unpack_from("<I", raw)[0] == _MAP_MAGIC else 0
        if (len(raw) - start) % MAP_PIXEL.itemsize:
            raise ValueError("a pixel's record is torn")
        found = np.frombuffer(raw, MAP_PIXEL, -1, start)
        for k in range(0, len(found), 1 << 16):
            at = np.arange(k, min(len(found), k + (1 << 16)))
            own = np.searchsorted(ends, at, "right")
            yield [pa.array(own.astype(np.int32)), pa.array((at - (ends - counts[:, 0])[own]).astype(np.int32)), *_columns(found[at])]

    return _whole(spark, pixels_path, decode, f"bin int, place int, {_ddl(MAP_PIXEL)}")


def read_bits(spark: SparkSession, path: str, frames: int, height: int, width: int) -> DataFrame:
    """(layer, frame, y, z) of the set bits of a packed mask; y and z count from the far edge, as the mask has them."""
    size = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": "4"}
    raw = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=size)
    words = spark.createDataFrame(raw, "row long, record binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 4)
            word, bit = np.nonzero(np.unpackbits(w, axis=1, bitorder="little"))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[word] * 32 + bit)], ["bit"])

    b, n = F.col("bit"), height * width
    return words.mapInArrow(run, "bit long").select(
        F.floor(b / (n * frames)).cast("int").alias("layer"), F.floor(b / n % frames).cast("int").alias("frame"),
        (height - 1 - F.floor(b % n / width)).cast("int").alias("y"), (width - 1 - b % width).cast("int").alias("z"))


def write_bits(df: DataFrame, path: str, layers: int, frames: int, height: int, width: int) -> None:
    """The packed mask of (layer, frame, y, z). Words without a bit are filled in by the stream."""
    total = (layers * frames * height * width + 31) // 32
    bit = ((F.col("layer").cast("long") * frames + F.col("frame")) * height + (height - 1 - F.col("y"))) * width + (width - 1 - F.col("z"))
    words = df.select(bit.alias("b")).distinct().groupBy(F.floor(F.col("b") / 32).alias("word")).agg(F.sum(F.expr("shiftleft(1L, CAST(b % 32 AS INT))")).alias("w"))

    def parts() -> Iterator[bytes]:
        at = 0
        for r in words.orderBy("word").toLocalIterator():
            yield bytes(4 * (r.word - at)) + int(r.w).to_bytes(4, "little")
            at = r.word + 1
        yield bytes(4 * (total - at))

    def gathered() -> Iterator[bytes]:
        held, size = [], 0
        for part in parts():
            held.append(part)
            size += len(part)
            if size > 4 << 20:
                yield b"".join(held)
                held, size = [], 0
        yield b"".join(held)

    write_stream(df.sparkSession, path, gathered())


def decode_payload(payload: bytes, code: int, pixels: int) -> np.ndarray:
    """The pixels of a frame's payload; hybrid ones are 16-bit, with pixels beyond that listed before."""
    if code not in PAYLOADS:
        raise ValueError(f"unknown payload code {code}")
    if code != 6:
        out = np.frombuffer(payload, PAYLOADS[code])
        if len(out) != pixels:
            raise ValueError("a payload of another size")
        return out.astype(np.float64)
    n = struct.unpack_from("<I", payload)[0]
    if len(payload) != 4 + 2 * pixels + 12 * n:
        raise ValueError("a payload of another size")
    out = np.frombuffer(payload, "<u2", pixels, 4).astype(np.float64)
    out[np.frombuffer(payload, "<i4", n, 4 + 2 * pixels)] = np.frombuffer(payload, "<i8", n, 4 + 2 * pixels + 4 * n)
    return out


def encode_payload(values: np.ndarray, code: int) -> bytes:
    if code != 6:
        return values.astype(PAYLOADS[code]).tobytes()
    over = np.flatnonzero(values > 0xFFFF)
    base = np.where(values > 0xFFFF, 0xFFFF, values).astype("<u2")
    return struct.pack("<I", len(over)) + base.tobytes() + over.astype("<i4").tobytes() + values[over].astype("<i8").tobytes()


def decoded_payloads(frames: DataFrame, pixels: int) -> DataFrame:
    """(frame, pixel, v) of (frame, code, payload); pixels that are zero are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, code, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v = decode_payload(blob, code, pixels)
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), frame, np.int64)), pa.array(at), pa.array(v[at])], ["frame", "pixel", "v"])

    return frames.select(F.col("frame").cast("long"), "code", "payload").mapInArrow(run, "frame long, pixel long, v double")


def byte_offset_decode(data: bytes, n: int) -> np.ndarray:
    """The counts of a byte-offset compressed image: differences in 1 byte, or after 0x80 in 2, after 0x8000 in 4, after 0x80000000 in 8."""
    out, at, last = np.empty(n, np.int64), 0, 0
    raw = np.frombuffer(data, np.int8)
    k = 0
    while k < n:
        # a run of one-byte differences at once
        stop = np.flatnonzero(raw[at : at + n - k] == -128)
        m = int(stop[0]) if len(stop) else min(n - k, len(raw) - at)
        if m:
            out[k : k + m] = last + np.cumsum(raw[at : at + m], dtype=np.int64)
            last, k, at = int(out[k + m - 1]), k + m, at + m
            continue
        step, at = struct.unpack_from("<h", data, at + 1)[0], at + 3
        if step == -0x8000:
            step, at = struct.unpack_from("<i", data, at)[0], at + 4
            if step == -0x80000000:
                step, at = struct.unpack_from("<q", data, at)[0], at + 8
        last += step
        out[k], k = last, k + 1
    return out


def byte_offset_encode(values: np.ndarray) -> bytes:
    out = []
    for d in np.diff(values.astype(np.int64), prepend=0).tolist():
        if abs(d) < 0x80:
            out.append(struct.pack("<b", d))
        elif abs(d) < 0x8000:
            out.append(struct.pack("<bh", -0x80, d))
        elif abs(d) < 0x80000000:
            out.append(struct.pack("<bhi", -0x80, -0x8000, d))
        else:
            out.append(struct.pack("<bhiq", -0x80, -0x8000, -0x80000000, d))
    return b"".join(out)


_CBF_BEGIN = b"\x0c\x1a\x04\xd5"


def cbf_file(values: np.ndarray, width: int) -> bytes:
    """A minimal compressed image file: a header that names size and digest, and byte-offset data."""
    body = byte_offset_encode(values.reshape(-1))
    digest = hashlib.md5(body).digest()
    import base64

    head = [
        b"###CBF: VERSION 1.5", b"data_image", b"_array_data.data", b";", b"--CIF-BINARY-FORMAT-SECTION--", b'Content-Type: application/octet-stream;\r\n     conversions="x-CBF_BYTE_OFFSET"',
        b"Content-Transfer-Encoding: BINARY", f"X-Binary-Size: {len(body)}".encode(), b"X-Binary-ID: 1", b'X-Binary-Element-Type: "signed 32-bit integer"', b"X-Binary-Element-Byte-Order: LITTLE_ENDIAN",
        b"Content-MD5: " + base64.b64encode(digest), f"X-Binary-Number-of-Elements: {values.size}".encode(), f"X-Binary-Size-Fastest-Dimension: {width}".encode(), f"X-Binary-Size-Second-Dimension: {values.size // width}".encode(), b"", b"",
    ]
    return b"\r\n".join(head) + _CBF_BEGIN + body + b"\r\n--CIF-BINARY-FORMAT-SECTION----\r\n;\r\n"


def read_cbf(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(file, y, x, v) of the pixels that aren't zero of compressed images, one file to a row of tasks; with ``check`` their MD5 must hold."""
    import base64
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = blob.as_buffer().to_pybytes()
                at = raw.index(_CBF_BEGIN)
                said = {k.lower(): v.strip() for k, v in re.findall(r"(?m)^((?:X-|Content-)[\w-]+):\s*([^\r\n]*)", raw[:at].decode("latin-1"))}
                body = raw[at + 4 : at + 4 + int(said["x-binary-size"])]
                if check and "content-md5" in said and base64.b64encode(hashlib.md5(body).digest()).decode() != said["content-md5"]:
                    raise ValueError(f"{name}: the data aren't those of its digest")
                n, width = int(said["x-binary-number-of-elements"]), int(said["x-binary-size-fastest-dimension"])
                v = byte_offset_decode(body, n)
                found = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found // width), pa.array(found % width), pa.array(v[found])], ["file", "y", "x", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, y long, x long, v long")
