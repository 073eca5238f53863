import json

import pytest

from pitwall import adapter, cli
from pitwall.operators import channels
from pitwall.plans import dataset
from pitwall.sources.files import Files
from pitwall.streaming.ingest import ingest
from tests.conftest import SF
from tests.recordings import build


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "AC_300726-155603_R_car_ring.rec").write_bytes(build(n=700, lap_frames=200))
    (root / "AC_310726-155603_R_car_ring.rec").write_bytes(build(drivers=("Cid",), n=500, lap_frames=240))
    (root / "a.ini").write_text("[WING_1]\nVALUE=3\n")
    (root / "b.ini").write_text("[WING_1]\nVALUE=5\n[FUEL]\nVALUE=20\n")
    (root / "segments.json").write_text(json.dumps({"coordinate": "actual_distance_m", "segments": [{"id": "one", "start": 0, "end": 40}, {"id": "two", "start": 90, "end": 10}]}))
    sessions = [{"replay": "AC_300726-155603_R_car_ring.rec", "setup": "a.ini"}, {"replay": "AC_310726-155603_R_car_ring.rec", "setup": "b.ini", "session_label": "second"}]
    (root / "dataset.json").write_text(json.dumps({"segments": "segments.json", "sessions": sessions}))
    specs, segment_path = dataset.session_specs(spark, str(root / "dataset.json"))
    return root, dataset.preprocess(spark, specs, str(root / "out"), segment_path)


def test_preprocess(spark, built):
    root, manifest = built
    table = lambda name: dataset.read_table(spark, str(root / "out"), name)
    assert json.loads((root / "out" / "quality" / "validation.json").read_text())["status"] == "ok"
    assert manifest["tables"]["samples"] == {"path": "samples.parquet", "rows": 1900, "columns": 90}
    sessions = {r.driver_name: r for r in table("sessions").collect()}
    assert sessions["Ann"].session_label == "AC_300726-155603_R_car_ring (Ann)" and sessions["Cid"].session_label == "second" and len(sessions["Cid"]) == 23
    assert str(sessions["Cid"].datetime) == "2026-07-31 15:56:03" and sessions["Ann"].lap_count_total == 4 and sessions["Ann"].lap_count_complete == 3
    assert len(table("laps").columns) == 44 and table("events/braking").count() > 0 and table("events/shifts").count() > 0
    assert "position.x" in table("samples").columns and table("segments/passes").count() > 0 and len(table("segments/passes").columns) == 34
    assert {(r.section, r.absolute_numeric_change) for r in table("setup/diffs").collect()} == {("WING_1", 2.0), ("FUEL", None)}
    facts = json.loads((root / "out" / "summaries" / "ai_context.json").read_text())
    assert facts["dataset"] == {"sessions": 3, "complete_laps": 8, "valid_laps": 8, "setups": 2} and len(facts["best_laps"]) == 8
    with pytest.raises(FileExistsError):
        dataset.preprocess(spark, [{"replay": "x"}], str(root / "out"))
    with pytest.raises(KeyError):
        table("nothing")


def test_commands(spark, built, capsys, monkeypatch):
    root, _ = built
    out = str(root / "out")
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark)
    assert cli.main(["validate", out]) == 0 and cli.main(["summarize", out]) == 0
    assert cli.main(["export", out, "--table", "laps", "--output", str(root / "laps.csv")]) == 0
    assert len((root / "laps.csv").read_text().splitlines()) == 12
    assert cli.main(["merge", out, out, "--output", str(root / "both")]) == 0
    assert dataset.read_table(spark, str(root / "both"), "laps").count() == 11
    assert cli.main(["merge", out, "--output", str(root / "both")]) == 2
    assert cli.main(["inspect", str(root / "AC_310726-155603_R_car_ring.rec")]) == 0
    assert cli.main(["validate", str(root)]) == 2
    assert cli.main(["frames", str(root / "a.ini")]) == 1


def test_findings(spark, built):
    root, manifest = built
    damaged = root / "damaged"
    dataset.Store(spark, str(damaged)).write("laps", dataset.read_table(spark, str(root / "out"), "laps"))
    Files(spark).dump(str(damaged / "manifest.json"), {**manifest, "tables": {"laps": {"path": "laps.parquet", "rows": 1, "columns": 44}, "samples": {"path": "samples.parquet", "rows": 1}}})
    codes = {w["code"] for w in dataset.validate(spark, str(damaged))["warnings"]}
    assert codes == {"MISSING_TABLES", "ROW_COUNT_MISMATCH", "MISSING_TABLE_FILE"}
    with pytest.raises(ValueError):
        dataset.require_compatible([{"schema_version": "2"}, {"schema_version": "1"}])
    dataset.require_compatible([{"schema_version": "2"}])


def test_streamed_sessions_equal_batch(spark, tmp_path):
    raw = adapter.frames(spark.read.parquet(f"{SF}/events.parquet"))
    for part in (0, 1):
        raw.where(f"session_id % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = ingest(spark, str(tmp_path / "in"), raw.schema, str(tmp_path / "out"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "samples")).drop("batch")
    assert got.count() == raw.count() == got.select("session_id", "sample_index").distinct().count()
    assert sorted(got.columns) == sorted(channels.SAMPLE_COLUMNS)
