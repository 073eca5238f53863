import io
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pitwall.plans import frame_csv
from pitwall.sources import recording as r
from pitwall.sources import recording_writer
from tests.recordings import build


def test_layout_and_frames():
    data = build(n=60, lap_frames=20)
    layout, frames, extras = r.parse(data)
    assert (layout.track, layout.weather, len(layout.cars), layout.driver_names) == ("ring", "clear", 2, ("Ann", "Bob"))
    assert frames[1]["position"][3, 0] == np.float32(3 * 0.3 + 101.25) and frames[0]["best_lap_ms"][0] == 4294967295
    assert [e[0] for e in extras] == [6, 7] and r.extra_columns(*extras[1])["clutch"][:3].tolist() == [200, 199, 198]
    found = r.extra_columns(*extras[1])
    assert found["turn_signals"][0] == 1 and found["low_beams"].all() and found["extra_options"][0].tolist()[:4] == [True, False, True, False]
    assert all(v[0] == w for v, w in zip(r.status_columns(frames[0]["status"]).values(), (True, True, 2, True), strict=True))


@pytest.mark.parametrize("break_it", [lambda d: d[:-30][:5000], lambda d: b"\x0f" + d[1:], lambda d: d[:100]])
def test_broken_files(break_it):
    with pytest.raises(r.RecordingError):
        r.parse(break_it(build(n=60, patch=False)))


def test_unknown_extra_version_and_missing_patch():
    assert r.parse(build(n=30, versions=(5, 7)))[2][0] is None
    assert r.parse(build(n=30, patch=False))[0].patch_offset is None
    assert r.parse(build(n=30, footer_version=2))[0].patch_offset is None
    with pytest.raises(r.RecordingError):
        r.parse(build(n=0))


def test_source_ranges_and_driver(spark, tmp_path):
    path = tmp_path / "AC_300726-155603_R_car_ring.rec"
    path.write_bytes(build(n=90, lap_frames=30))
    spark.dataSource.register(r.RecordingSource)
    df = spark.read.format("recording").option("path", str(path)).option("frames_per_partition", "25").load()
    assert df.rdd.getNumPartitions() == 8 and df.count() == 180
    rows = df.where("car_index = 1").orderBy("source_frame").collect()
    assert [x.source_frame for x in rows] == list(range(90)) and rows[2].clutch == 198 and rows[5].rotation_y == rows[5].yaw
    assert abs(rows[7].rotation_y - np.sin(7 / 50)) < 1e-3 and rows[0].rotation_x == -0.25
    assert r.read(spark, str(path), "Bob").select("car_index").distinct().collect()[0][0] == 1
    with pytest.raises(Exception, match="Zoe"):
        r.read(spark, str(path), "Zoe").count()
    header = r.read(spark, str(path), mode="header").orderBy("car_index").collect()
    assert [(h.frame_count, h.extra_version, h.patch_driver_name) for h in header] == [(90, 6, "Ann"), (90, 7, "Bob")]
    assert r.read_binary_files(spark, str(path)).exceptAll(df.withColumn("source_file", r_path(path))).count() == 0


def r_path(path):
    from pyspark.sql import functions as F

    return F.lit(f"file:{path}")


def test_text_export(spark, tmp_path):
    assert len(frame_csv.labels()) == 107
    source = tmp_path / "race.rec"
    source.write_bytes(build(n=5, lap_frames=2))
    out = frame_csv.convert(spark, str(source), f"{tmp_path}/out/")
    assert [p.name for p in out] == ["race_Ann.csv", "race_Bob.csv"]
    body = out[0].read_text().splitlines()
    assert body[0] == "# formatVersion 2" and "# driverName Ann" in body
    header = next(x for x in body if x.startswith("frame,")).split(",")
    first = body[-5].split(",")
    assert len(header) == len(first) == 122 and first[header.index("position.x")] == "1.25" and first[header.index("lights")] == "true"
    assert frame_csv.convert(spark, str(source), f"{tmp_path}/out/", "Ann")[0].name == "race.csv"
    assert frame_csv.convert(spark, str(source), f"{tmp_path}/out/", "Ann")[0].name == "race (2).csv"
    with pytest.raises(r.RecordingError):
        r.scan(io.BytesIO(b"\x10\x00"), 2)


def many_cars(n, frames=2):
    metas = [{"car_id": f"car {k}", "driver_name": f"driver {k % 2}", "nation_code": "TST", "driver_team": "t", "car_skin_id": "s", "wings": k % 3, "extra_version": (6, 7, 0)[k % 3]} for k in range(n)]
    rows = {"source_lap_number": np.zeros(frames), "clutch": np.arange(frames)}
    return recording_writer.build({"interval_ms": 60.0, "weather": "clear", "track_id": "ring", "track_config": ""}, [(m, rows, frames) for m in metas])


def test_a_row_for_a_car_does_not_carry_all_cars(spark, tmp_path):
    for n in (1, 90):
        (tmp_path / f"{n}.rec").write_bytes(many_cars(n))
    longest = {row.path: row.n for row in r.layouts(spark, [str(tmp_path / f"{n}.rec") for n in (1, 90)]).selectExpr("path", "length(layout) AS n").groupBy("path").agg({"n": "max"}).toDF("path", "n").collect()}
    assert longest[str(tmp_path / "90.rec")] < longest[str(tmp_path / "1.rec")] + 50
    heads = r.read(spark, str(tmp_path / "90.rec"), mode="header").orderBy("car_index").collect()
    assert [(h.car_id, h.num_cars, h.extra_version, h.patch_driver_name) for h in heads] == [(f"car {k}", 90, (6, 7, None)[k % 3], f"driver {k % 2}") for k in range(90)]
    assert r.read(spark, str(tmp_path / "90.rec"), "driver 1", columns=["car_index", "clutch"]).where("car_index % 3 < 2").select("car_index", "clutch").distinct().count() == 60


def test_building_a_recording_copies_no_car_twice(monkeypatch):
    class Counted(bytes):
        grown = 0

        def __add__(self, other):
            Counted.grown += len(self)
            return Counted(bytes(self) + other)

    monkeypatch.setattr(recording_writer, "_text", lambda value, whole=recording_writer._text: Counted(whole(value)))
    monkeypatch.setattr(recording_writer.struct, "pack", lambda *a, whole=struct.pack: Counted(whole(*a)))
    data = many_cars(60)
    assert Counted.grown < 2 * len(data)
    monkeypatch.undo()
    assert many_cars(60) == data and len(r.parse(data)[1]) == 60


def test_preambles_format_no_frame(spark, tmp_path, monkeypatch):
    path = tmp_path / "90.rec"
    path.write_bytes(many_cars(7))
    whole = {(x.path, x.car): x.preamble for x in frame_csv.texts(spark, str(path)).where("lo = 0").collect()}
    heads = frame_csv.preambles(spark, str(path))
    assert {(x.path, x.car): x.preamble for x in heads.collect()} == whole and "body" not in heads.columns


def test_cars_of_a_name_do_not_try_all_numbers(tmp_path, monkeypatch):
    tried, exists = [], Path.exists
    monkeypatch.setattr(Path, "exists", lambda self, **more: tried.append(self) or exists(self, **more))
    taken, names = {}, []
    (tmp_path / "x_d (3).csv").write_text("")
    for _ in range(40):
        found = frame_csv.output_path(Path("x.rec"), f"{tmp_path}/", "d", 40, None, taken)
        found.write_text("")
        names.append(found.name)
    assert names == ["x_d.csv", "x_d (2).csv", *[f"x_d ({n}).csv" for n in range(4, 42)]]
    assert len(tried) < 90
    assert frame_csv.output_path(Path("x.rec"), f"{tmp_path}/", "d", 40, None, {}).name == "x_d (42).csv"


def test_short_cars_keep_their_tasks_and_share_batches(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.rec").write_bytes(many_cars(90))
    df = r.read(spark, [str(tmp_path / f"{n}.rec") for n in (1, 2)], columns=["source_file", "car_index", "sample_index"])
    seen = df.selectExpr("spark_partition_id() AS p", "*").collect()
    assert len({x.p for x in seen}) == 4 and len({(x.source_file, x.car_index, x.sample_index) for x in seen}) == len(seen) == 360
    parts = [pa.record_batch({"a": [n]}) for n in range(25_000)]
    joined = list(r._joined(iter(parts)))
    assert [b.num_rows for b in joined] == [10_000, 10_000, 5_000] and joined[2]["a"][0].as_py() == 20_000
