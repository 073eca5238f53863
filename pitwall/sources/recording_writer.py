"""Recordings from tables: the counterpart of the reader, for round trips and for handing sessions on.

A recording holds the cars of one ``file``; each car's frames are encoded by the numpy dtype the reader decodes with.
One task builds one file, so a file's frames must fit its memory, as they do in the recorder.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitwall.config import WHEELS
from pitwall.sources import recording as r

#: Columns of the frames table. The wheel channels are those of the reader's; missing columns are written as 0.
KEYS = ("file", "car_index", "source_frame")
#: Length of driver chunk from which readers take it as one.
_LONG = 256


def _text(value) -> bytes:
    raw = ("" if value is None else str(value)).encode()
    return struct.pack("<I", len(raw)) + raw


def encode_frames(rows: dict[str, np.ndarray], n: int, wings: int) -> np.ndarray:
    out = np.zeros(n, dtype=r.record_type(wings))
    for name in ("position", "velocity"):
        for i, a in enumerate("xyz"):
            if f"{name}_{a}" in rows:
                out[name][:, i] = rows[f"{name}_{a}"]
    for i, a in enumerate("yxz"):  # stored in this order
        if f"rotation_{a}" in rows:
            out["rotation"][:, i] = rows[f"rotation_{a}"]
    for k, w in enumerate(WHEELS):
        for c in ("angular_velocity", "slip_angle", "slip_ratio", "nd_slip", "load"):
            if f"wheel_{w}_{c}" in rows:
                out[c][:, k] = rows[f"wheel_{w}_{c}"]
        for i, a in enumerate("xyz"):
            if f"wheel_{w}_position_{a}" in rows:
                out["wheel_position"][:, k, i] = rows[f"wheel_{w}_position_{a}"]
    for name in out.dtype.names:
        if out.dtype[name].shape == () and name in rows:
            out[name] = rows[name].astype(np.float64).astype(out.dtype[name]) if out.dtype[name].kind == "f" else rows[name].astype(np.int64).astype(out.dtype[name])
    return out


def _extra(version: int, rows: dict[str, np.ndarray], n: int) -> bytes:
    wipers, status, handbrake, clutch = r.EXTRA_PLACES.get(version, r.EXTRA_PLACES[6])
    raw = np.zeros((n, r.EXTRA_BYTES), dtype=np.uint8)
    for at, name in ((wipers, "wipers"), (handbrake, "handbrake"), (clutch, "clutch")):
        if name in rows:
            raw[:, at] = rows[name].astype(np.int64)
    if "raw_status" in rows:
        word = rows["raw_status"].astype(np.int64)
        raw[:, status], raw[:, status + 1] = word & 255, word >> 8
    return raw.tobytes()


def build(head: dict, cars: list[tuple[dict, dict[str, np.ndarray], int]]) -> bytes:
    """A file from its header (interval_ms, weather, track_id, track_config) and (texts, columns, frames) of each car.

    A car's texts are car_id, driver_name, nation_code, driver_team, car_skin_id; its extra_version (0: none) adds extra frames.
    """
    frames = max((n for _, _, n in cars), default=0)
    # Pieces are joined once: adding each to what is there copies the file for every car.
    out = [struct.pack("<Id", r.VERSION, head["interval_ms"]), _text(head["weather"]), _text(head["track_id"]), _text(head["track_config"])]
    out.append(struct.pack("<4I", len(cars), 0, frames, 0) + bytes(4 * frames))
    for meta, rows, n in cars:
        out += [_text(meta[k]) for k in ("car_id", "driver_name", "nation_code", "driver_team", "car_skin_id")]
        out += [struct.pack("<2I", n, meta.get("wings", 0)), encode_frames(rows, n, meta.get("wings", 0)).tobytes(), struct.pack("<I", 0)]
    if not any(meta.get("extra_version") for meta, _, _ in cars):
        return b"".join(out)
    at = sum(map(len, out))
    names = "".join(f"[CAR_{k}]\n{r.DRIVER_KEY}'{meta['driver_name']}'\r\n" for k, (meta, _, _) in enumerate(cars))
    out.append(_text(names + ";" * _LONG))
    for k, (meta, rows, n) in enumerate(cars):
        if version := meta.get("extra_version"):
            packed = zlib.compress(_extra(version, rows, n))
            out += [_text(f"{r.EXTRA_TAG.decode()}_v{version}:{k}"), struct.pack("<I", len(packed)), packed]
    return b"".join([*out, r.FOOTER, struct.pack("<2I", at, 1)])


_META = ("interval_ms", "weather", "track_id", "track_config")
_CAR = ("car_id", "driver_name", "nation_code", "driver_team", "car_skin_id", "wings", "extra_version")


def write(frames: DataFrame, folder: str) -> DataFrame:
    """Write a recording ``folder``/``file`` for each file; returns (path, size). A lost task writes its file again, whole."""
    names = frames.columns

    def one(rows: pa.Table) -> pa.Table:
        from pyarrow import fs

        order = np.lexsort((rows.column("source_frame").to_numpy(), rows.column("car_index").to_numpy()))
        rows = rows.take(pa.array(order)).combine_chunks()
        car = rows.column("car_index").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(car[1:] != car[:-1]) + 1, [len(car)]])
        # Columns are converted once for the file, a car has views of them. A missing value of a float channel is its NaN.
        columns = {c: rows.column(c).to_numpy() for c in names if pa.types.is_floating(rows.schema.field(c).type) or pa.types.is_integer(rows.schema.field(c).type)}
        metas = rows.select([c for c in _CAR if c in names]).take(pa.array(cuts[:-1])).to_pylist()
        cars = [(meta, {c: v[lo:hi] for c, v in columns.items()}, hi - lo) for meta, lo, hi in zip(metas, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        data = build({c: rows.column(c)[0].as_py() for c in _META}, cars)
        path = f"{folder.rstrip('/')}/{rows.column('file')[0].as_py()}"
        store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inside) as target:
            target.write(data)
        return pa.table({"path": [path], "size": pa.array([len(data)], pa.int64())})

    return frames.groupBy("file").applyInArrow(one, "path string, size long")
