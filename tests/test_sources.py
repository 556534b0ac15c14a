"""Readers and writers by round trip, and streams against batches."""

import decimal
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.functions import rotations
from ringfold.sources import binaries, tables
from ringfold.streaming import frames


def test_result_table_widths(spark, tmp_path):
    (tmp_path / "new.csv").write_text("% header\n" + " ".join(str(k) for k in range(1, 18)) + " 0\n" + " ".join(str(k) for k in range(2, 19)) + " -1\n")
    (tmp_path / "old.csv").write_text(" ".join(str(k) for k in range(1, 18)) + "\n")
    new = tables.read_table(spark, str(tmp_path / "new.csv"), tables.RESULT, least=17).orderBy("SpotID").collect()
    old = tables.read_table(spark, str(tmp_path / "old.csv"), tables.RESULT, least=17).collect()
    assert [r.ReturnCode for r in new] == [0, None] and old[0].ReturnCode is None and old[0].FitRMSE == 17.0
    tables.write_table(tables.read_table(spark, str(tmp_path / "new.csv"), tables.RESULT), str(tmp_path / "back"), tables.RESULT)
    again = tables.read_table(spark, str(tmp_path / "back"), tables.RESULT).orderBy("SpotID").collect()
    assert again == new
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "old.csv"), tables.RESULT, least=18).collect()


def test_packed_and_frames(spark, tmp_path):
    x = np.arange(40, dtype="<f8").reshape(4, 10)
    x.tofile(tmp_path / "Spots.bin")
    rows = tables.read_packed(spark, str(tmp_path / "Spots.bin"), tables.SPOTS).orderBy("row").collect()
    assert [r.SpotID for r in rows] == [4, 14, 24, 34] and rows[1].Y == 10.0
    image = np.zeros((2, 3, 4), "<u2")
    image[0, 1, 2], image[1, 2, 3] = 500, 7
    (tmp_path / "f.raw").write_bytes(b"head" + image.tobytes())
    f = tables.read_frames(spark, str(tmp_path / "f.raw"), 3, 4, header=4)
    assert sorted((r.frame, r.y, r.x, r.v) for r in tables.pixels_over(f, 4).collect()) == [(0, 1, 2, 500.0), (1, 2, 3, 7.0)]
    (tmp_path / "torn.bin").write_bytes(b"\0" * 12)
    with pytest.raises(Exception):
        tables.read_packed(spark, str(tmp_path / "torn.bin"), "a b").collect()


def test_parameters(spark, tmp_path):
    (tmp_path / "p.par").write_text("Lsd 1000 # distance\nRingThresh 1 80\nRingThresh 2 90\n\n# none\n")
    got = sorted((r.key, r.seq, r["values"]) for r in tables.read_parameters(spark, str(tmp_path / "p.par")).collect())
    assert got == [("Lsd", 0, ["1000"]), ("RingThresh", 0, ["1", "80"]), ("RingThresh", 1, ["2", "90"])]


def test_profiles(spark, tmp_path):
    p = spark.createDataFrame([(2.0, 5.0, 1.0), (1.0, 4.0, 2.0)], "x double, y double, s double")
    tables.write_profile_text(p, str(tmp_path / "a.fxye"), "fxye", "x", "y", "s", "a title", notes=("made here",))
    lines = (tmp_path / "a.fxye").read_text().split("\n")
    # the title first, notes before the BANK line, or readers stop at them
    assert lines[0].rstrip() == "a title" and lines[1] == "# made here" and lines[2] == "BANK 1 2 2 CONST 100.00000 100.00000 0 0 FXYE"
    assert [x.split()[0] for x in lines[3:5]] == ["100.00000", "200.00000"]
    with pytest.raises(ValueError):
        tables.write_profile_text(p, str(tmp_path / "b"), "xye", "x", "y")


def test_ledger_runs_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert frames.run_once(spark, str(tmp_path / "ledger"), "stage", "digest", str(tmp_path / "out"), make).count() == 3
    assert len(made) == 1
    frames.run_once(spark, str(tmp_path / "ledger"), "stage", "other", str(tmp_path / "out2"), make)
    assert len(made) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f, p, float(f * 10 + p)) for f in range(4) for p in range(6)], "frame int, pixel int, v double")
    rows.repartition(4, "frame").write.parquet(str(tmp_path / "in"))
    bins = spark.createDataFrame([(p, p % 2, 0.5 + p) for p in range(6)], "pixel int, bin int, fraction double")
    frames.integrated(frames.file_stream(spark, str(tmp_path / "in"), "frame int, pixel int, v double"), bins, str(tmp_path / "out"), str(tmp_path / "state"), "frame", "pixel", "v")
    from ringfold.operators.aggregates import integrate

    got = sorted((r.frame, r.bin, round(r["mean"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.frame, r.bin, round(r["mean"], 9)) for r in integrate(rows, bins, "frame", "pixel", "v", "bin", "fraction").collect())


def test_symmetry_orders():
    sizes = {"-1": 1, "2/m": 2, "mmm": 4, "4/m": 4, "4/mmm": 8, "-3": 3, "-3m": 6, "6/m": 6, "6/mmm": 12, "m-3": 12, "m-3m": 24}
    assert {k: len(rotations.symmetry(k)) for k in sizes} == sizes


def test_symmetric_orientations_coincide(spark):
    d = spark.createDataFrame([([0.9, 0.1, 0.3, 0.3],)], "q array<double>").select(rotations.normalised(F.col("q")).alias("q"))
    for s in rotations.symmetry("m-3m")[:6]:
        turned = d.select("q", rotations.multiply(F.col("q"), F.array(*[F.lit(float(x)) for x in s])).alias("p"))
        assert turned.select(rotations.misorientation(F.col("q"), F.col("p"), "m-3m").alias("a")).first().a < 1e-4


@pytest.mark.parametrize("piece", [1, 3, 7, 1000])
def test_slots_are_read_in_pieces(spark, tmp_path, monkeypatch, piece):
    """Pieces begin and end within slots and over empty ones; a file in other order, with gaps, keys beyond 63 bits and a torn slot."""
    monkeypatch.setattr(binaries, "PIECE", piece)
    counts = [0, 5, 0, 0, 2, 11, 1, 0]
    want = sorted((s, p, 100 * s + p, 2**64 - 1 - p, 3, 0) for s, n in enumerate(counts) for p in range(n))
    d = spark.createDataFrame([(s, p, *map(decimal.Decimal, rest)) for s, p, *rest in want], "slot int, place int, SpotID decimal(20,0), NMatches decimal(20,0), NIDs decimal(20,0), Best decimal(20,0)")
    path = str(tmp_path / "slots.bin")
    binaries.write_slots(d.repartition(3), path, binaries.SOLUTION_KEY, len(counts))
    got = binaries.read_slots(spark, path, binaries.SOLUTION_KEY)
    assert sorted(tuple(map(int, r)) for r in got.collect()) == want
    if piece == 3:
        assert got.rdd.getNumPartitions() > 1
    raw, head = open(path, "rb").read(), 4 + 12 * len(counts)
    assert len(raw) == head + 32 * len(want)
    # slots from the last to the first, with something between
    begins, body = np.zeros(len(counts), "<i8"), b""
    own = np.frombuffer(raw, "<i8", len(counts), 4 + 4 * len(counts))
    for s in reversed(range(len(counts))):
        begins[s] = head + len(body)
        body += raw[own[s] : own[s] + 32 * counts[s]] + b"\1" * 5
    (tmp_path / "turned.bin").write_bytes(raw[: 4 + 4 * len(counts)] + begins.tobytes() + body)
    assert sorted(tuple(map(int, r)) for r in binaries.read_slots(spark, str(tmp_path / "turned.bin"), binaries.SOLUTION_KEY).collect()) == want
    (tmp_path / "short.bin").write_bytes(raw[:-1])
    with pytest.raises(ValueError, match="torn"):
        binaries.read_slots(spark, str(tmp_path / "short.bin"), binaries.SOLUTION_KEY)
