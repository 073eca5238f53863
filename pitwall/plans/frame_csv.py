"""Text export of a car's frames: a preamble of "# key value" lines and one line for each frame.

Ranges of frames are decoded and formatted by tasks; the driver only appends their texts, in order, to the one file asked for.
"""

from __future__ import annotations

import itertools
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pitwall.sources import recording
from pitwall.sources.files import name_of

# Fixed values of the text format: its version, the columns' labels and the preamble's keys.
FORMAT_VERSION = 2
_WHEELS = ("wheelFL", "wheelFR", "wheelRL", "wheelRR")
_EXTRA = ("clutch", "handbrake", "wipers", "turnSignals", "lowBeams", *[f"extraOption{x}" for x in "ABCDEFGHIJ"])
#: Frames formatted at once.
CHUNK = 4_000


def labels() -> list[str]:
    """The 107 columns of a frame."""
    axes = lambda *names: [f"{n}.{a}" for n in names for a in "xyz"]
    each = lambda what: [f"{w}.{what}" for w in _WHEELS]
    return [
        "frame", *axes("position", "rotation", "velocity"), *axes(*each("staticPosition")), *axes(*each("staticRotation")), *axes(*each("position")), *axes(*each("rotation")),
        *each("angularVelocity"), *each("slipAngle"), *each("slipRatio"), *each("ndSlip"), *each("load"), *each("dirt"), "steerAngle", "bodyworkNoise", "drivetrainSpeed",
        "currentLap", "currentLapTime", "lastLapTime", "bestLapTime", "fuel", "fuelPerLap", "rpm", "gear", "gas", "brake", "boost",
        "damageFrontDeformation", "damageFront", "damageRear", "damageLeft", "damageRight", "lights", "horn", "cameraDir", "engineHealth", "gearboxBeingDamaged", "dirt",
    ]


def lines(rows: np.ndarray, extra: tuple[int, np.ndarray] | None, lo: int = 0):
    """Lines of values: 9 digits of 4-byte numbers, 5 of 2-byte numbers, booleans in lower case. The first is frame ``lo``."""
    n = len(rows)
    yxz = lambda a: a.reshape(n, -1, 3)[:, :, [1, 0, 2]].reshape(n, -1)
    flat = lambda name: rows[name].reshape(n, -1)
    status = recording.status_columns(rows["status"])
    parts = [
        ("i", np.arange(lo, lo + n)[:, None]), ("9", flat("position")), ("5", yxz(rows["rotation"])), ("5", flat("velocity")), ("9", flat("static_position")), ("5", yxz(rows["static_rotation"])),
        ("9", flat("wheel_position")), ("5", yxz(rows["wheel_rotation"])), *[("5", flat(c)) for c in ("angular_velocity", "slip_angle", "slip_ratio", "nd_slip", "load")], ("i", flat("tyre_dirt")),
        *[("5", flat(c)) for c in ("steer", "bodywork_noise", "drivetrain_speed")], *[("i", flat(c)) for c in ("source_lap_number", "lap_time_ms", "last_lap_ms", "best_lap_ms", "fuel", "fuel_per_lap")],
        ("5", flat("rpm")), *[("i", flat(c)) for c in ("gear_raw", "gas", "brake", "boost", "damage_front_deformation", "damage_front", "damage_rear", "damage_left", "damage_right")],
        ("b", status["lights"][:, None]), ("b", status["horn"][:, None]), ("i", status["camera_direction"][:, None]), ("i", flat("engine_health")), ("b", status["gearbox_being_damaged"][:, None]), ("i", flat("dirt")),
    ]
    if extra:
        columns = recording.extra_columns(*extra)
        parts += [("i", columns[c][:, None]) for c in ("clutch", "handbrake", "wipers", "turn_signals")] + [("b", columns["low_beams"][:, None]), ("b", columns["extra_options"])]
    form = {"i": "%d", "9": "%.9g", "5": "%.5g", "b": "%s"}
    line = ",".join(form[kind] for kind, values in parts for _ in range(values.shape[1]))
    words = np.array(["false", "true"])
    columns = [(words[c.astype(np.int64)] if kind == "b" else c.astype(np.float64) if kind in "95" else c.astype(np.int64)).tolist() for kind, values in parts for c in values.T]
    for row in zip(*columns, strict=True):
        yield line % row


def preamble(layout: recording.Layout, index: int, extra: bool) -> str:
    car = layout.car(index)
    keys = (
        ("formatVersion", FORMAT_VERSION), ("numFrames", car.frames), ("carNumFrames", car.frames), ("recordingInterval", format(layout.interval_ms, ".6g")), ("replayVersion", layout.version),
        ("weather", layout.weather), ("track", layout.track), ("trackConfig", layout.track_config), ("numCars", layout.num_cars), ("currentRecordingIndex", layout.current_recording_index),
        ("replayNumFrames", layout.num_frames), ("numTrackObjects", layout.num_track_objects), ("carID", car.car_id), ("driverName", car.driver_name), ("nationCode", car.nation_code),
        ("driverTeam", car.driver_team), ("carSkinID", car.car_skin_id), ("numWings", car.wings),
    )
    return "".join(f"# {key} {value}\n" for key, value in keys) + ",".join([*labels(), *(_EXTRA if extra else ())]) + "\n"


def _formatted(batches):
    for batch in batches:
        for row in batch.to_pylist():
            layout, car = recording.from_json(row["layout"]), row["car"]
            file, size = recording.open_file(row["path"])
            with file:
                extra = recording.extra_frames(file, size, layout, car)
                for lo in range(row["lo"], row["hi"], CHUNK):
                    hi = min(row["hi"], lo + CHUNK)
                    part = (extra[0], extra[1][lo:hi]) if extra else None
                    body = "".join(x + "\n" for x in lines(recording.frames(file, layout.car(car), lo, hi), part, lo))
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([car], pa.int32()), pa.array([lo], pa.int64()), pa.array([preamble(layout, car, bool(extra)) if lo == 0 else None], pa.string()), pa.array([layout.name(car)]), pa.array([layout.num_cars], pa.int32()), pa.array([body])], ["path", "car", "lo", "preamble", "driver", "cars", "body"])


def _heads(batches):
    for batch in batches:
        for row in batch.to_pylist():
            layout, car = recording.from_json(row["layout"]), row["car"]
            file, size = recording.open_file(row["path"])
            with file:
                extra = recording.extra_frames(file, size, layout, car)
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([car], pa.int32()), pa.array([preamble(layout, car, bool(extra))])], ["path", "car", "preamble"])


def preambles(spark: SparkSession, paths: list[str] | str):
    """(path, car, preamble) of each car: it stands in the headers, no frame is formatted for it."""
    cars = recording.layouts(spark, [paths] if isinstance(paths, str) else paths)
    return recording.dealt(cars, "path", "car").mapInArrow(_heads, "path string, car int, preamble string")


def texts(spark: SparkSession, paths: list[str] | str):
    """(path, car, lo, preamble, driver, cars, body): the text of ranges of frames; the first of a car has its preamble."""
    cars = recording.layouts(spark, [paths] if isinstance(paths, str) else paths)
    return recording.dealt(recording.ranges(cars, recording.RANGE // 10), "path", "car", "lo").mapInArrow(_formatted, "path string, car int, lo long, preamble string, driver string, cars int, body string")


def free_path(path: Path, taken: dict[Path, int] | None = None) -> Path:
    """The path, or with the first free number behind its stem; ``taken`` keeps the last number of each path, so that many cars of a name don't try all numbers again."""
    n = (taken or {}).get(path, 0)
    found = path
    while n or found.exists():
        n = max(n, 1) + 1
        found = path.with_name(f"{path.stem} ({n}){path.suffix}")
        if not found.exists():
            break
    if taken is not None:
        taken[path] = max(n, 1)
    return found


def output_path(source: Path, wanted: str | None, driver: str, cars: int, chosen: str | None, taken: dict[Path, int] | None = None) -> Path:
    """Where a car's text goes: in a folder under the recording's name, or the file that is wanted; several cars add the driver."""
    suffix = f"_{driver}" if chosen is None and cars > 1 else ""
    if wanted is None or wanted.endswith(("/", "\\")):
        return free_path((Path(wanted) if wanted else Path.cwd()) / f"{source.stem}{suffix}.csv", taken)
    path = Path(wanted)
    path = path.with_name(f"{path.stem}{suffix}{path.suffix}")
    return path if path.suffix else path.with_suffix(".csv")


def convert(spark: SparkSession, source: str, wanted: str | None = None, driver: str | None = None) -> list[Path]:
    """Write the text of each chosen car; ranges come to the driver one after the other."""
    chosen = texts(spark, source)
    chosen = chosen.where(F.col("driver") == driver) if driver is not None else chosen
    out, taken = [], {}
    for _, parts in itertools.groupby(chosen.sort("car", "lo").toLocalIterator(), key=lambda x: x.car):
        first = next(parts)
        path = output_path(Path(name_of(source)), wanted, first.driver, first.cars, driver, taken)
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("w", encoding="utf-8") as target:
            target.write(first.preamble + first.body)
            for part in parts:
                target.write(part.body)
        out.append(path)
    if not out:
        raise recording.RecordingError(f'driver "{driver}" is not in {source}')
    return out
