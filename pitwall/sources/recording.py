"""Binary session recordings (version 16): layout, frames, and a Spark data source.

The layout of a file is found by seeking over its blocks; frames are records of equal length and are decoded
by one numpy dtype, so that any range of a car's frames can be read alone. :func:`read` finds layouts and hashes
in a Spark job over the paths and deals (file, car, range of frames) to tasks; the driver sees no file. The data
source "recording" does the same for plans that name a format, and takes equality filters on driver and car.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from pitwall.config import WHEELS

# Fixed values of the format.
VERSION = 16
FRAME_BYTES, GAP_BYTES, WING_BYTES, EXTRA_BYTES = 256, 20, 4, 108
FOOTER = b"__AC_SHADERS_PATCH_v1__"
DRIVER_KEY = "DRIVER_NAME="
EXTRA_TAG = b"EXT_PERCAR"
OPTION_BITS = (4, 5, 6, 7, 10, 11, 12, 13, 14, 15)
#: Byte positions in an extra frame by version: wipers, status, handbrake, clutch.
EXTRA_PLACES = {6: (89, 90, 92, 98), 7: (91, 88, 92, 94)}
#: Frames of a partition.
RANGE = 200_000

_F, _E, _B, _I, _H = "<f4", "<f2", "u1", "<u4", "<u2"
#: Field: (offset, type, shape); rotations are stored as y, x, z.
FIELDS = {
    "position": (0, _F, (3,)), "rotation": (12, _E, (3,)), "static_position": (20, _F, (4, 3)), "static_rotation": (68, _E, (4, 3)),
    "wheel_position": (92, _F, (4, 3)), "wheel_rotation": (140, _E, (4, 3)), "velocity": (164, _E, (3,)), "rpm": (170, _E, ()),
    "angular_velocity": (172, _E, (4,)), "slip_angle": (180, _E, (4,)), "slip_ratio": (188, _E, (4,)), "nd_slip": (196, _E, (4,)), "load": (204, _E, (4,)),
    "steer": (212, _E, ()), "bodywork_noise": (214, _E, ()), "drivetrain_speed": (216, _E, ()), "lap_time_ms": (220, _I, ()), "last_lap_ms": (224, _I, ()),
    "best_lap_ms": (228, _I, ()), "fuel": (232, _B, ()), "fuel_per_lap": (233, _B, ()), "gear_raw": (234, _B, ()), "tyre_dirt": (235, _B, (4,)),
    "damage_front_deformation": (239, _B, ()), "damage_rear": (240, _B, ()), "damage_left": (241, _B, ()), "damage_right": (242, _B, ()), "damage_front": (243, _B, ()),
    "gas": (244, _B, ()), "brake": (245, _B, ()), "source_lap_number": (246, _B, ()), "status": (248, _H, ()), "dirt": (252, _B, ()), "engine_health": (253, _B, ()), "boost": (254, _B, ()),
}


class RecordingError(ValueError):
    """The file is no recording that can be read: wrong version, cut off or malformed."""


@dataclass(frozen=True)
class CarBlock:
    car_id: str
    driver_name: str
    nation_code: str
    driver_team: str
    car_skin_id: str
    frames: int
    wings: int
    offset: int
    trailing: int

    @property
    def stride(self) -> int:
        return GAP_BYTES + FRAME_BYTES + WING_BYTES * self.wings


@dataclass(frozen=True)
class Layout:
    version: int
    interval_ms: float
    weather: str
    track: str
    track_config: str
    num_cars: int
    current_recording_index: int
    num_frames: int
    num_track_objects: int
    cars: tuple[CarBlock, ...]
    patch_offset: int | None
    driver_names: tuple[str, ...]
    extras: dict = field(default_factory=dict)  # car -> (version, offset of the packed size)
    first: int = 0  # index of the first of ``cars``

    def car(self, index: int) -> CarBlock:
        return self.cars[index - self.first]

    def name(self, index: int) -> str:
        """The driver's name as the patch has it."""
        return self.driver_names[index - self.first]

    def alone(self, index: int) -> Layout:
        """The layout with one of its cars, under the same index: a task of a car carries this, whatever the number of cars."""
        own = {index: self.extras[index]} if index in self.extras else {}
        return replace(self, cars=(self.car(index),), driver_names=(self.name(index),), extras=own, first=index)


class _Cursor:
    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def take(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) != n:
            raise RecordingError(f"the file ends at {self.file.tell()}, {n - len(data)} bytes early")
        return data

    def number(self, code: str):
        return struct.unpack(f"<{code}", self.take(struct.calcsize(f"<{code}")))[0]

    def text(self) -> str:
        n = self.number("I")
        if n > self.size - self.file.tell():
            raise RecordingError(f"a text of {n} bytes at {self.file.tell()} reaches over the end")
        return self.take(n).decode("utf-8", errors="replace")

    def skip(self, n: int) -> None:
        if self.file.tell() + n > self.size:
            raise RecordingError(f"a block of {n} bytes at {self.file.tell()} reaches over the end")
        self.file.seek(n, 1)


def _patch_offset(c: _Cursor) -> int | None:
    tail = len(FOOTER) + 8
    if c.size < tail:
        return None
    c.file.seek(c.size - tail)
    marker = c.take(len(FOOTER))
    offset, version = c.number("I"), c.number("I")
    return offset if marker == FOOTER and version == 1 and offset < c.size else None


def _patch(c: _Cursor, offset: int, cars: int) -> tuple[tuple[str, ...], dict]:
    """Driver names of the first long chunk, and where each car's extra frames lie; all chunks are met once."""
    c.file.seek(offset)
    end = c.size - len(FOOTER) - 8
    names, extras, at = None, {}, offset
    while at + 4 <= end:
        c.file.seek(at)
        n = c.number("I")
        if n > end - at - 4:
            raise RecordingError(f"malformed chunk at {at}")
        chunk = c.take(n)
        at += 4 + n
        if names is None and n > 255:
            names = _driver_names(chunk.decode("utf-8", errors="replace"), cars)
        if chunk.startswith(EXTRA_TAG):
            try:
                head, car = chunk.decode("ascii").split(":", 1)
                found = int(car), int(head.rsplit("_v", 1)[1])
            except (UnicodeDecodeError, ValueError, IndexError) as error:
                raise RecordingError(f"malformed tag before {at}: {chunk[:60]!r}") from error
            extras.setdefault(found[0], (found[1], at))
    return names or ("",) * cars, extras


def _driver_names(ini: str, cars: int) -> tuple[str, ...]:
    names = []
    for piece in ini.split(DRIVER_KEY)[1 : cars + 1]:
        name = piece.split("\n", 1)[0].removesuffix("\r")
        names.append(name[1:-1] if len(name) > 1 and name[0] == name[-1] == "'" else name)
    return (*names, *[""] * (cars - len(names)))


def scan(file, size: int) -> Layout:
    """Layout of an open binary file; reads headers only."""
    c = _Cursor(file, size)
    version = c.number("I")
    if version != VERSION:
        raise RecordingError(f"only version {VERSION} can be read, this is {version}")
    head = [version, c.number("d"), c.text(), c.text(), c.text(), *(c.number("I") for _ in range(4))]
    after = file.tell()
    patch = _patch_offset(c)
    file.seek(after)
    c.skip((4 + 12 * head[8]) * head[7])
    cars = []
    for _ in range(head[5]):
        texts = [c.text() for _ in range(5)]
        frames, wings = c.number("I"), c.number("I")
        if not frames:
            raise RecordingError("a car without frames")
        offset = file.tell()
        c.skip(frames * (GAP_BYTES + FRAME_BYTES + WING_BYTES * wings))
        trailing = c.number("I")
        c.skip(8 * trailing)
        cars.append(CarBlock(*texts, frames, wings, offset, trailing))
    names, extras = _patch(c, patch, len(cars)) if patch is not None else (tuple(car.driver_name for car in cars), {})
    return Layout(*head, tuple(cars), patch, names, extras)


def record_type(wings: int) -> np.dtype:
    return np.dtype({"names": list(FIELDS), "formats": [(t, s) if s else t for _, t, s in FIELDS.values()], "offsets": [GAP_BYTES + o for o, _, _ in FIELDS.values()], "itemsize": GAP_BYTES + FRAME_BYTES + WING_BYTES * wings})


def frames(file, car: CarBlock, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Frames lo to hi of a car as a structured array."""
    hi = car.frames if hi is None else hi
    file.seek(car.offset + lo * car.stride)
    data = file.read((hi - lo) * car.stride)
    if len(data) != (hi - lo) * car.stride:
        raise RecordingError("the file ends in a car's frames")
    return np.frombuffer(data, dtype=record_type(car.wings))


def extra_frames(file, size: int, layout: Layout, index: int) -> tuple[int, np.ndarray] | None:
    """(version, bytes by frame) of a car's extra frames; None if there are none or their version is unknown."""
    version, offset = layout.extras.get(index, (None, 0))
    if version not in EXTRA_PLACES:
        return None
    file.seek(offset)
    c = _Cursor(file, size)
    try:
        data = zlib.decompress(c.take(c.number("I")))
    except zlib.error as error:
        raise RecordingError(f"extra frames of car {index} cannot be unpacked: {error}") from error
    wanted = EXTRA_BYTES * layout.car(index).frames
    if len(data) < wanted:
        raise RecordingError(f"extra frames of car {index} have {len(data)} bytes of {wanted}")
    return version, np.frombuffer(data[:wanted], dtype=np.uint8).reshape(-1, EXTRA_BYTES)


def extra_columns(version: int, raw: np.ndarray) -> dict[str, np.ndarray]:
    wipers, status, handbrake, clutch = EXTRA_PLACES[version]
    word = raw[:, status].astype(np.int64) | raw[:, status + 1].astype(np.int64) << 8
    options = np.stack([(word >> b) & 1 for b in OPTION_BITS], axis=1).astype(bool)
    return {"clutch": raw[:, clutch], "handbrake": raw[:, handbrake], "wipers": raw[:, wipers], "turn_signals": word & 7, "low_beams": (word >> 3 & 1).astype(bool), "extra_options": options, "raw_status": word}


def status_columns(status: np.ndarray) -> dict[str, np.ndarray]:
    word = status.astype(np.int64)
    return {"lights": (word >> 12 & 1).astype(bool), "horn": (word >> 3 & 1).astype(bool), "camera_direction": word >> 4 & 3, "gearbox_being_damaged": (word >> 9 & 1).astype(bool)}


_DOUBLES = (
    *[f"{k}_{a}" for k in ("position", "rotation", "velocity") for a in "xyz"], "gas", "brake", "clutch", "steer", "rpm", "drivetrain_speed", "bodywork_noise", "fuel", "fuel_per_lap", "boost",
    *[f"wheel_{w}_{c}" for w in WHEELS for c in ("angular_velocity", "slip_angle", "slip_ratio", "nd_slip", "load", "position_x", "position_y", "position_z")],
)
_META = "source_file string, source_name string, source_hash string, car_index int, car_id string, driver_name string, nation_code string, driver_team string, car_skin_id string, num_cars int, track_id string, track_config string, weather string, interval_ms double"
SCHEMA = f"{_META}, source_frame long, sample_index long, source_lap_number long, lap_time_ms long, last_lap_ms long, best_lap_ms long, gear_raw long, status int, yaw double, {', '.join(f'{c} double' for c in _DOUBLES)}"
HEADER_SCHEMA = f"path string, size_bytes long, {_META}, frame_count long, extra_version int, extra_frame_count long, replay_version int, current_recording_index long, replay_num_frames long, num_track_objects long, patch_offset long, patch_driver_name string"


def _optional(values: np.ndarray) -> pa.Array:
    """Doubles with null for NaN."""
    return pa.array(values.astype(np.float64), pa.float64(), from_pandas=True)


def table(meta: dict, rows: np.ndarray, lo: int, clutch: np.ndarray | None, wanted: list[str] | None = None) -> pa.RecordBatch:
    """A batch of SCHEMA, or of its ``wanted`` columns, from decoded frames; the first is frame ``lo`` of its car."""
    n = len(rows)
    axes = {"position": (0, 1, 2), "rotation": (1, 0, 2), "velocity": (0, 1, 2)}
    doubles = {f"{k}_{a}": rows[k][:, i] for k, order in axes.items() for a, i in zip("xyz", order, strict=True)}
    for k, w in enumerate(WHEELS):
        doubles |= {f"wheel_{w}_{c}": rows[c][:, k] for c in ("angular_velocity", "slip_angle", "slip_ratio", "nd_slip", "load")}
        doubles |= {f"wheel_{w}_position_{a}": rows["wheel_position"][:, k, i] for i, a in enumerate("xyz")}
    doubles |= {c: rows[c] for c in ("gas", "brake", "steer", "rpm", "drivetrain_speed", "bodywork_noise", "fuel", "fuel_per_lap", "boost")}
    kinds = dict(part.strip().split() for part in _META.split(","))
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def column(name: str) -> pa.Array:
        if name in kinds:
            return pa.repeat(pa.scalar(meta[name], arrow[kinds[name]]), n)
        if name in ("source_frame", "sample_index"):
            return pa.array(np.arange(lo, lo + n))
        if name in ("source_lap_number", "lap_time_ms", "last_lap_ms", "best_lap_ms", "gear_raw"):
            return pa.array(rows[name].astype(np.int64))
        if name == "status":
            return pa.array(rows["status"].astype(np.int32))
        if name == "yaw":
            return _optional(rows["rotation"][:, 0])
        return _optional(doubles[name]) if name in doubles else _optional(clutch) if clutch is not None else pa.nulls(n, pa.float64())

    names = wanted or [part.strip().split()[0] for part in SCHEMA.split(",")]
    return pa.RecordBatch.from_arrays([column(name) for name in names], names)


def car_meta(path: str, digest: str, layout: Layout, index: int) -> dict:
    car = layout.car(index)
    return {
        "source_file": path, "source_name": path.rstrip("/").rsplit("/", 1)[-1], "source_hash": digest, "car_index": index, "car_id": car.car_id, "driver_name": car.driver_name,
        "nation_code": car.nation_code, "driver_team": car.driver_team, "car_skin_id": car.car_skin_id, "num_cars": layout.num_cars, "track_id": layout.track,
        "track_config": layout.track_config, "weather": layout.weather, "interval_ms": layout.interval_ms,
    }


def parse(data: bytes) -> tuple[Layout, list[np.ndarray], list]:
    """Everything in a recording held in memory: layout, frames and extra frames of each car."""
    file = io.BytesIO(bytes(data))
    layout = scan(file, len(data))
    return layout, [frames(file, car) for car in layout.cars], [extra_frames(file, len(data), layout, i) for i in range(len(layout.cars))]


def open_file(path: str):
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside), store.get_file_info(inside).size


def _digest(file) -> str:
    file.seek(0)
    found = hashlib.sha256()
    while block := file.read(1 << 20):
        found.update(block)
    return found.hexdigest()


@dataclass
class _Part(InputPartition):
    path: str
    digest: str
    layout: Layout
    car: int
    lo: int
    hi: int


#: Columns of a car block on which the source takes equality filters.
PUSHED = ("car_index", "driver_name", "car_id", "nation_code", "driver_team", "car_skin_id")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.driver = options.get("driver_name")
        self.header = options.get("mode", "frames") == "header"
        self.range = int(options.get("frames_per_partition", RANGE))
        self.equal: dict[str, set] = {}

    def _selected(self, layout: Layout, index: int) -> bool:
        own = {"car_index": index, **{k: getattr(layout.car(index), k) for k in PUSHED if k != "car_index"}}
        return all({own[k]} == values for k, values in self.equal.items())

    def partitions(self):
        parts = []
        for path in self.paths:
            file, size = open_file(path)
            with file:
                layout, digest = scan(file, size), _digest(file)
            if not layout.cars:
                raise RecordingError(f"{path}: no cars")
            chosen = [i for i, car in enumerate(layout.cars) if self.driver is None or car.driver_name == self.driver]
            if not chosen:
                raise RecordingError(f'driver "{self.driver}" is not in {path}')
            for i in filter(lambda i: self._selected(layout, i), chosen):
                n, own = layout.car(i).frames, layout.alone(i)
                parts += [_Part(path, digest, own, i, lo, min(n, lo + self.range)) for lo in ([0] if self.header else range(0, n, self.range))]
        return parts

    def read(self, part: _Part | None):
        if part is None:  # no car was selected
            return
        file, size = open_file(part.path)
        with file:
            meta = car_meta(part.path, part.digest, part.layout, part.car)
            extra = extra_frames(file, size, part.layout, part.car)
            if self.header:
                layout = part.layout
                more = (layout.car(part.car).frames, extra[0] if extra else None, len(extra[1]) if extra else 0, layout.version, layout.current_recording_index, layout.num_frames, layout.num_track_objects, layout.patch_offset, layout.name(part.car))
                yield (part.path, size, *meta.values(), *more)
                return
            clutch = extra_columns(*extra)["clutch"][part.lo : part.hi] if extra else None
            yield table(meta, frames(file, part.layout.car(part.car), part.lo, part.hi), part.lo, clutch)


class _PushingReader(_Reader):
    """Spark takes a reader with pushFilters only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters):
        """Equality on a column of the car block selects cars before any frame is read; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.equal.setdefault(f.attribute[0], set()).add(f.value)
            else:
                yield f


class RecordingSource(DataSource):
    """Options: path or paths (one a line), driver_name, mode (frames or header), frames_per_partition, push_filters."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return HEADER_SCHEMA if self.options.get("mode", "frames") == "header" else SCHEMA

    def reader(self, schema):
        return (_PushingReader if self.options.get("push_filters") == "true" else _Reader)(self.options)


def from_json(text: str) -> Layout:
    raw = json.loads(text)
    return Layout(**{**raw, "cars": tuple(CarBlock(**c) for c in raw["cars"]), "driver_names": tuple(raw["driver_names"]), "extras": {int(k): tuple(v) for k, v in raw["extras"].items()}})


_LAYOUTS = "path string, size long, digest string, layout string, car int, driver_name string, frames long"


def layouts(spark: SparkSession, paths: list[str]):
    """A row for each car of each recording, with the layout of that car alone: found and hashed by tasks, one file each."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file, size = open_file(path)
                with file:
                    layout, digest = scan(file, size), _digest(file)
                if not layout.cars:
                    raise RecordingError(f"{path}: no cars")
                rows = [(path, size, digest, json.dumps(asdict(layout.alone(i))), i, car.driver_name, car.frames) for i, car in enumerate(layout.cars)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if k != 4 else pa.array(c, pa.int32()) for k, c in enumerate(zip(*rows, strict=True))], ["path", "size", "digest", "layout", "car", "driver_name", "frames"])

    listed = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    return listed.repartition(max(1, min(len(paths), 10_000)), "path").mapInArrow(run, _LAYOUTS)


def ranges(cars, step: int):
    """The cars of :func:`layouts` by ranges of frames lo to hi."""
    spread = cars.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(step).cast("long"))))
    return spread.withColumn("hi", F.least(F.col("frames"), F.col("lo") + F.lit(step)))


def dealt(cars, *keys: str):
    """Rows of a few hundred bytes that stand for much work, by a number of partitions that Spark doesn't reduce for their small size."""
    spark = cars.sparkSession
    return cars.repartition(max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: Rows from which a batch goes on alone.
BATCH = 10_000


def _joined(batches):
    """Batches of short cars put together, as each costs its own time on the way to Spark."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _decoded(columns: list[str] | None):
    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                layout, car = from_json(row["layout"]), row["car"]
                file, size = open_file(row["path"])
                with file:
                    extra = extra_frames(file, size, layout, car) if columns is None or "clutch" in columns else None
                    clutch = extra_columns(*extra)["clutch"][row["lo"] : row["hi"]] if extra else None
                    yield table(car_meta(row["path"], row["digest"], layout, car), frames(file, layout.car(car), row["lo"], row["hi"]), row["lo"], clutch, columns)

    return lambda batches: _joined(each(batches))


def _headers(batches):
    names = [part.strip().split()[0] for part in HEADER_SCHEMA.split(",")]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            layout, car = from_json(row["layout"]), row["car"]
            file, size = open_file(row["path"])
            with file:
                extra = extra_frames(file, size, layout, car)
            more = (layout.car(car).frames, extra[0] if extra else None, len(extra[1]) if extra else 0, layout.version, layout.current_recording_index, layout.num_frames, layout.num_track_objects, layout.patch_offset, layout.name(car))
            rows.append((row["path"], size, *car_meta(row["path"], row["digest"], layout, car).values(), *more))
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        kinds = [types[part.strip().split()[1]] for part in HEADER_SCHEMA.split(",")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, paths: list[str] | str, driver_name: str | None = None, mode: str = "frames", columns: list[str] | None = None, frames_per_partition: int = RANGE, drivers: dict[str, str | None] | None = None):
    """Frames (or, with mode header, a row for each car) of recordings; of frames perhaps only some ``columns`` are decoded.

    ``driver_name`` selects cars of all files, ``drivers`` (path to name or None) those of each; a file without the driver is an error.
    """
    paths = paths.split("\n") if isinstance(paths, str) else paths
    wanted = {p: (drivers or {}).get(p, driver_name) for p in paths}
    cars = layouts(spark, paths)
    if any(v is not None for v in wanted.values()):
        chosen = spark.createDataFrame(list(wanted.items()), "path string, wanted string")
        cars = cars.join(F.broadcast(chosen), "path").withColumn("own", F.col("wanted").isNull() | (F.col("driver_name") == F.col("wanted")))  # a row for each path
        missing = F.concat(F.lit('driver "'), F.col("wanted"), F.lit('" is not in '), F.col("path"))
        found = F.max("own").over(Window.partitionBy("path"))
        cars = cars.withColumn("found", found).where(F.when(~F.col("found"), F.raise_error(missing).cast("boolean")).otherwise(F.col("own"))).drop("wanted", "own", "found")
    if mode == "header":
        return cars.mapInArrow(_headers, HEADER_SCHEMA)
    parts = ranges(cars, frames_per_partition)
    schema = SCHEMA if columns is None else ", ".join(part.strip() for part in SCHEMA.split(",") if part.split()[0] in columns)
    names = [part.strip().split()[0] for part in schema.split(",")]
    return dealt(parts, "path", "car", "lo").mapInArrow(_decoded(names), schema)


def read_binary_files(spark: SparkSession, path: str):
    """The same frames through Spark's own file reader, for stores that only Spark opens; a file is one row there (2 GB at most)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                layout, decoded, extras = parse(data)
                digest = hashlib.sha256(data).hexdigest()
                for i, rows in enumerate(decoded):
                    clutch = extra_columns(*extras[i])["clutch"] if extras[i] else None
                    for lo in range(0, len(rows), RANGE):
                        yield table(car_meta(name, digest, layout, i), rows[lo : lo + RANGE], lo, None if clutch is None else clutch[lo : lo + RANGE])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
