"""Files in and out: headers, listings, hit tables, models' folders, stages."""

import struct

import pytest

from spindrift.operators import browse
from spindrift.sources import files, tables as tb


def wav(n, rate=44100, channels=2, extra=b""):
    body = b"\0" * (n * channels * 2)
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_headers_and_listings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.wav").write_bytes(wav(10))
    (tmp_path / "two.wav").write_bytes(wav(7, 8000, 1, b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxx")
    (tmp_path / "notes.txt").write_text("x")
    got = {r.stem: (r.sample_rate, r.channels, r.n_samples) for r in files.recordings(spark, f"file://{tmp_path}").collect()}
    assert got == {"one": (44100, 2, 10), "two": (8000, 1, 7), "bad": (None, None, None)}
    assert {(r.stem, r.folder) for r in files.listing(spark, f"file://{tmp_path}", "*.wav").collect()} == {("one", "a"), ("two", tmp_path.name), ("bad", tmp_path.name)}
    v2 = spark.createDataFrame([("one", "v2/one")], "stem string, path string")
    v3 = spark.createDataFrame([("one", "v3/one"), ("two", "v3/two")], "stem string, path string")
    assert {(r.stem, r.path) for r in files.first_version([v2, v3]).collect()} == {("one", "v2/one"), ("two", "v3/two")}


def test_spans_and_sidecars(spark, tmp_path):
    (tmp_path / "c.csv").write_text("starts,stops\n0,6000\n100,200\n5000,99999\n")
    assert sorted((r.start, r.stop) for r in tb.candidate_spans(spark, f"file://{tmp_path}/c.csv", 12000).collect()) == [(0, 6000), (5000, 12000)]
    (tmp_path / "s.json").write_text('{"sample_rate": 8000}')
    assert tuple(tb.sidecar(spark, f"file://{tmp_path}/s.json").first()) == (8000, "default")


def test_frames_and_hits_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(1, 0, "UP", 0.5), (2, 0, "NOISE", 1.5), (1, 1, "UP", 2.5)], "recording bigint, frame bigint, label string, value double")
    tb.write_frames(f, f"file://{tmp_path}/frames")
    back = tb.frames_cache(spark, f"file://{tmp_path}/frames")
    assert back.filter("recording = 1").count() == 2 and back.filter("probs IS NULL").count() == 3
    ddl = files.HITS_DDL
    h = spark.createDataFrame([(0, 3, 0, 2560, 0.0, 0.058, 1, -3.0, None, None, "WHISTLE", 1.0, None)], ddl)
    from pyspark.sql import functions as F

    files.write_hits(h.withColumn("recording", F.lit("r1")), f"file://{tmp_path}/hits")
    out = files.read_hits(spark, f"file://{tmp_path}/hits/recording=r1").first()
    assert out.submodel_id == 3 and out.mean_noise_score is None and out.classification == "WHISTLE" and out.recording == "recording=r1"


def test_browse_tables_and_stages(spark, tmp_path):
    display = spark.createDataFrame([(1, 0, 5.0), (2, 0, 9.0), (3, 1, 1.0)], "results_id int, submodel int, llr double")
    links = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "model_i int, model_j int, single double")
    files.write_browse(display, links, f"file://{tmp_path}/b")
    assert spark.read.parquet(f"file://{tmp_path}/b/display_set").count() == 3
    with pytest.raises(ValueError):
        files.write_browse(display.union(display), links, f"file://{tmp_path}/c")
    made = []
    steps = [("one", f"file://{tmp_path}/s1", lambda: made.append(1) or display), ("two", f"file://{tmp_path}/s2", lambda: made.append(2) or links)]
    assert files.stages(steps[:1], spark) == ["one"] and files.stages(steps, spark) == ["two"] and made == [1, 2]
    merges, marks, settings = browse.reset(links, display, display)
    assert merges.count() == marks.count() == 0 and settings.count() == 3
    report = files.comparison_report([{"metric": "bic", "run": "b", "baseline": 2.0, "value": 1.0, "lift": -50.0, "magnitude": "significant", "verdict": "improvement"}, {"metric": "x", "run": "b", "baseline": 0.0, "value": 1.0, "lift": None, "magnitude": None, "verdict": None}])
    assert "| bic | b | 2.0000 | 1.0000 | -50.00 % | significant improvement |" in report and "not comparable" in report
