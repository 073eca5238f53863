"""Synthetic recordings, written from the format description."""

import struct
import zlib

import numpy as np

from pitwall.sources import recording as r


def text(value: bytes | str) -> bytes:
    value = value.encode() if isinstance(value, str) else value
    return struct.pack("<I", len(value)) + value


def frame_values(car: int, n: int, lap_of) -> np.ndarray:
    rows = np.zeros(n, dtype=r.record_type(1))
    i = np.arange(n)
    rows["position"] = np.stack([i * 0.3 + car * 100 + 1.25, np.full(n, -2.5), 300.125 + i * 0.4], axis=1)
    rows["rotation"] = np.stack([np.sin(i / 50), np.full(n, -0.25), np.full(n, 0.5)], axis=1)
    speed = 25 + 15 * np.sin(i / 40)
    rows["velocity"] = np.stack([0.6 * speed, np.full(n, -0.125), 0.8 * speed], axis=1)
    rows["rpm"] = 5000 + 1000 * np.cos(i / 40)
    for c, base in (("slip_ratio", 0.0), ("slip_angle", 0.1), ("angular_velocity", 50.0), ("nd_slip", 0.2), ("load", 2000.0)):
        rows[c] = base + np.stack([np.sin(i / 25 + k) * (0.4 if c == "slip_ratio" else 1) for k in range(4)], axis=1)
    rows["steer"], rows["drivetrain_speed"] = 20 * np.sin(i / 30), 99.5
    lap = np.array([lap_of(k) for k in i])
    starts = np.array([np.flatnonzero(lap == x)[0] for x in lap])
    rows["lap_time_ms"], rows["last_lap_ms"], rows["best_lap_ms"] = ((i - starts) * 1000 / 60).astype(int), 5678, 4294967295
    rows["fuel"], rows["fuel_per_lap"], rows["gear_raw"] = 200 - i // 100, 10, 2 + (i // 40) % 5
    rows["gas"], rows["brake"] = np.where(np.sin(i / 40) > 0, 255, 0), np.where(np.sin(i / 40) < -0.3, 180, 0)
    rows["source_lap_number"], rows["status"], rows["boost"] = lap, 1 << 12 | 1 << 3 | 2 << 4 | 1 << 9, 99
    return rows


def build(drivers=("Ann", "Bob"), n=600, lap_frames=200, patch=True, versions=(6, 7), footer_version=1, frames=None) -> bytes:
    out = struct.pack("<Id", 16, 1000 / 60) + text("clear") + text("ring") + text("short") + struct.pack("<4I", len(drivers), 0, n, 1)
    out += bytes((4 + 12) * n)
    for car, name in enumerate(drivers):
        rows = frame_values(car, n, lambda k: k // lap_frames) if frames is None else frames
        out += text(f"car_{car}") + text(name) + text("TST") + text("Team") + text(f"skin_{car}") + struct.pack("<2I", len(rows), 1) + rows.tobytes() + struct.pack("<I", 1) + bytes(8)
    if not patch:
        return out
    at = len(out)
    ini = "[HEADER]\n" + "".join(f"[CAR_{k}]\nDRIVER_NAME='{d}'\r\n" for k, d in enumerate(drivers)) + ";" * 300
    out += text("small") + text(ini)
    for car in range(len(drivers)):
        version = versions[car % len(versions)]
        raw = np.zeros((n, 108), dtype=np.uint8)
        places = r.EXTRA_PLACES.get(version, r.EXTRA_PLACES[6])
        raw[:, places[0]], raw[:, places[2]], raw[:, places[3]] = 1 + np.arange(n) % 4, 70 + car, (200 - np.arange(n)) % 256
        word = car % 5 | 1 << 3 | 1 << 4 | 1 << 6
        raw[:, places[1]], raw[:, places[1] + 1] = word & 255, word >> 8
        packed = zlib.compress(raw.tobytes())
        out += text(f"EXT_PERCAR_v{version}:{car}".encode()) + text(packed)
    return out + r.FOOTER + struct.pack("<2I", at, footer_version)
