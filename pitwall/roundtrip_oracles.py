"""SQL over the test tables for what the round trips of :mod:`pitwall.roundtrips` must give back."""

from __future__ import annotations

from pitwall.config import DEFAULT, WHEELS
from pitwall.oracles import BRAKING, DERIVED, LAPS, LOCKUPS, METRICS, PASSES, RUN, SEGMENTED, SHIFTS, THROTTLE, TIMED, WHEELSPIN, _CATEGORY, _r
from pitwall.operators import channels, events, laps, segments, stats

SLIP = {"fl": (13, "event_id % 31 <> 0"), "fr": (17, "event_id % 31 > 1"), "rl": (23, "event_id % 37 <> 0"), "rr": (19, "event_id % 37 > 1")}
LOAD = {"fl": 7, "fr": 11, "rl": 13, "rr": 17}


def _d(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


REC = f"""
re AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id {RUN}) AS signups FROM events),
rec AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, user_id, event_id, 'AC_' || lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') || '0726-155603_R_car_track.rec' AS source_name, CAST(user_id // 12 AS INTEGER) AS car_index,
    'car ' || user_id AS car_id, 'driver ' || (user_id % 7) AS driver_name, 'team ' || (user_id % 3) AS driver_team, user_id % 3 AS wings,
    n AS sample_index, n AS source_frame, CAST(60 AS DOUBLE) AS interval_ms, CAST(signups // 2 AS BIGINT) AS source_lap_number,
    (epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id, signups ORDER BY ts, event_id))) // 1000 % 4294967296 AS lap_time_ms,
    1000 * (event_id * 11 % 5) AS last_lap_ms, 4294967295 - event_id % 5 AS best_lap_ms,
    sum({_d('event_id % 8')} / 4) OVER (PARTITION BY user_id ORDER BY ts, event_id {RUN}) AS position_x, {_d('event_id % 9')} / 8 AS position_y,
    sum({_d('event_id % 13')} / 2 + CASE WHEN event_id % 50 = 0 THEN 12 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id {RUN}) AS position_z,
    {_d('event_id % 64')} / 8 - 4 AS velocity_x, CAST(0 AS DOUBLE) AS velocity_y, {_d('event_id * 5 % 320')} / 8 AS velocity_z,
    {_d('event_id % 5')} / 4 AS rotation_x, {_d('event_id * 29 % 201 - 100')} / 32 AS yaw, {_d('event_id % 3')} / 4 AS rotation_z,
    {_d('least(255, k * 3)')} AS gas, {_d('greatest(0, event_id * 37 % 100 - 50) * 5')} AS brake, event_id * 5 % 256 AS clutch_raw, event_id % 200 AS handbrake, event_id % 4 AS wipers,
    CASE WHEN user_id // 12 % 3 < 2 THEN {_d('event_id * 5 % 256')} END AS clutch, event_id * 7 % 65536 AS raw_status, event_id * 3 % 65536 AS status,
    {_d('event_id % 21 - 10')} / 8 AS steer, event_id % 7 AS gear_raw, {_d('1000 + event_id * 17 % 1000')} AS rpm, {_d('event_id % 100')} AS drivetrain_speed, {_d('event_id % 11')} / 16 AS bodywork_noise,
    {_d('200 - n % 100')} AS fuel, CAST(3 AS DOUBLE) AS fuel_per_lap, {_d('event_id % 250')} AS boost,
    {", ".join(f"CASE WHEN {c} THEN {_d(f'event_id * {m} % 100 - 50')} / 64 END AS slip_{w}" for w, (m, c) in SLIP.items())},
    {", ".join(f"{_d(f'event_id * {m} % 2000')} AS load_{w}" for w, m in LOAD.items())}, {", ".join(f"{_d(f'event_id * {m} % 16')} / 16 AS angle_{w}" for w, (m, _) in SLIP.items())},
    {", ".join(f"{_d(f'event_id * {m} % 128')} AS turn_{w}" for w, m in LOAD.items())}, {", ".join(f"{_d(f'event_id * {m} % 9')} / 8 AS nd_{w}" for w, m in LOAD.items())},
    {", ".join(f"{_d(f'(event_id * {k} + {i}) % 32')} / 4 AS at_{w}_{a}" for k, w in enumerate(WHEELS, 1) for i, a in enumerate("xyz"))}
  FROM re),
cars AS (SELECT source_name, car_index, car_id, driver_name, driver_team, wings, count(*) AS frames FROM rec GROUP BY ALL)"""
#: The recorded sessions through the same steps as the other queries' raw frames.
CHAIN = "WITH " + REC + ", raw AS (SELECT * FROM rec)," + SEGMENTED + "," + TIMED.replace("{source}", "seg") + "," + DERIVED

_WHEELS = ", ".join(
    f"turn_{w} AS wheel_{w}_angular_velocity, angle_{w} AS wheel_{w}_slip_angle, slip_{w} AS wheel_{w}_slip_ratio, nd_{w} AS wheel_{w}_nd_slip, load_{w} AS wheel_{w}_load, at_{w}_x AS wheel_{w}_position_x, at_{w}_y AS wheel_{w}_position_y, at_{w}_z AS wheel_{w}_position_z"
    for w in WHEELS
)
_FILES = "(SELECT count(DISTINCT car_id) FROM rec r WHERE r.source_name = cars.source_name)"


def _g(column: str, digits: int) -> str:
    return f"printf('%.{digits}g', {column})"


def _line() -> str:
    """The text of a frame, value by value in the order of the format's labels."""
    nine, five = lambda c: _g(c, 9), lambda c: _g(c, 5)
    i = lambda c: f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"
    each = lambda name, write: [write(f"{name}_{w}") for w in WHEELS]
    zero = ["'0'"]
    flag = lambda word, bit: f"CASE WHEN {word} >> {bit} & 1 = 1 THEN 'true' ELSE 'false' END"
    slips = [f"coalesce({five(f'slip_{w}')}, 'nan')" for w in WHEELS]
    parts = [
        i("sample_index"), *[nine(f"position_{a}") for a in "xyz"], five("rotation_x"), five("yaw"), five("rotation_z"), *[five(f"velocity_{a}") for a in "xyz"], *zero * 24,
        *[nine(f"at_{w}_{a}") for w in WHEELS for a in "xyz"], *zero * 12, *each("turn", five), *each("angle", five), *slips, *each("nd", five), *each("load", five), *zero * 4, five("steer"), five("bodywork_noise"), five("drivetrain_speed"),
        *[i(c) for c in ("source_lap_number", "lap_time_ms", "last_lap_ms", "best_lap_ms", "fuel", "fuel_per_lap")], five("rpm"), *[i(c) for c in ("gear_raw", "gas", "brake", "boost")], *zero * 5,
        flag("status", 12), flag("status", 3), i("status >> 4 & 3"), *zero, flag("status", 9), *zero,
    ]
    extra = [i("clutch_raw"), i("handbrake"), i("wipers"), i("raw_status & 7"), flag("raw_status", 3), *[flag("raw_status", b) for b in (4, 5, 6, 7, 10, 11, 12, 13, 14, 15)]]
    return " || ',' || ".join(parts) + " || CASE WHEN car_index % 3 < 2 THEN ',' || " + " || ',' || ".join(extra) + " ELSE '' END"


_LABELS = ",".join(
    ["frame", *[f"{n}.{a}" for n in ("position", "rotation", "velocity") for a in "xyz"]]
    + [f"wheel{w}.{what}.{a}" for what in ("staticPosition", "staticRotation", "position", "rotation") for w in ("FL", "FR", "RL", "RR") for a in "xyz"]
    + [f"wheel{w}.{what}" for what in ("angularVelocity", "slipAngle", "slipRatio", "ndSlip", "load", "dirt") for w in ("FL", "FR", "RL", "RR")]
    + "steerAngle bodyworkNoise drivetrainSpeed currentLap currentLapTime lastLapTime bestLapTime fuel fuelPerLap rpm gear gas brake boost".split()
    + "damageFrontDeformation damageFront damageRear damageLeft damageRight lights horn cameraDir engineHealth gearboxBeingDamaged dirt".split()
)
_EXTRA = ",clutch,handbrake,wipers,turnSignals,lowBeams," + ",".join(f"extraOption{x}" for x in "ABCDEFGHIJ")
_PREAMBLE = " || chr(10) || ".join(
    f"'# {k} ' || {v}" for k, v in (
        ("formatVersion", "2"), ("numFrames", "frames"), ("carNumFrames", "frames"), ("recordingInterval", "60"), ("replayVersion", "16"), ("weather", "'clear'"), ("track", "'ring'"), ("trackConfig", "'short'"),
        ("numCars", _FILES), ("currentRecordingIndex", "0"), ("replayNumFrames", "(SELECT max(frames) FROM cars c WHERE c.source_name = cars.source_name)"), ("numTrackObjects", "0"), ("carID", "car_id"), ("driverName", "driver_name"),
        ("nationCode", "'TST'"), ("driverTeam", "driver_team"), ("carSkinID", "'plain'"), ("numWings", "wings"),
    )
)

# ------------------------------------------------------------------------------------------------- setup files

SETUPS = f"""
lines AS (
  SELECT replace(p_brand, '#', '_') || '.ini' AS source_file, CASE WHEN p_type < 'M' THEN 'wing_' ELSE 'TYRES ' END || p_type AS section, split_part(p_name, ' ', -1) AS parameter, p_partkey, p_size AS s, p_partkey % 8 AS kind FROM part),
entries AS (
  SELECT source_file, section, parameter, kind, s, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY source_file, section, parameter ORDER BY p_partkey DESC) AS n FROM lines) WHERE n = 1),
valued AS (
  SELECT *, CASE kind WHEN 0 THEN CASE WHEN s > 999 THEN substr(s::VARCHAR, 1, 3) ELSE lpad(s::VARCHAR, 3, '0') END WHEN 1 THEN s || '.50' WHEN 2 THEN 'True' WHEN 3 THEN 'soft ' || s WHEN 4 THEN s::VARCHAR WHEN 5 THEN '-' || s WHEN 6 THEN '1_0' || s ELSE '' END AS raw_value,
    CASE kind WHEN 0 THEN s::DOUBLE WHEN 1 THEN s + 0.5::DOUBLE WHEN 2 THEN 1::DOUBLE WHEN 4 THEN s::DOUBLE WHEN 5 THEN -s::DOUBLE WHEN 6 THEN ('10' || s)::DOUBLE END AS value_numeric,
    CASE kind WHEN 0 THEN s::VARCHAR WHEN 1 THEN s || '.5' WHEN 2 THEN 'True' WHEN 3 THEN 'soft ' || s WHEN 4 THEN s::VARCHAR WHEN 5 THEN '-' || s WHEN 6 THEN '10' || s ELSE '' END AS value_text, {_CATEGORY} AS category
  FROM entries)"""

# ------------------------------------------------------------------------------------------------- datasets

_SAMPLES = (
    "timestamp_s", "dt_s", "lap_time_s", "actual_distance_m", "progress AS normalized_actual_distance", "speed_kmh", "long_g", "lat_g", "yaw_rad", "yaw_rate_rad_s", "throttle", "brake_n", "fuel", "front_mean AS front_mean_slip_ratio",
    "front_min AS front_slip_ratio_min", "rear_max AS rear_slip_ratio_max", "rear_load AS rear_total_load",
)
_FLAGS = "is_moving, is_full_throttle, is_braking, is_front_lock_candidate, is_rear_wheelspin_candidate"
_CLASS = "CASE WHEN is_replay_fragment THEN 'fragment' WHEN NOT is_complete THEN 'incomplete' WHEN actual_distance_m < CAST(0.9 AS DOUBLE) * typical THEN 'pit_or_error' ELSE 'unclassified_complete' END AS lap_class"
_EVENTS = f"{CHAIN},{LAPS}, {BRAKING}, {THROTTLE}, {SHIFTS}, {LOCKUPS}, {WHEELSPIN}"
_TABLES = (("braking", "braking", "braking"), ("throttle", "throttle_e", "throttle_application"), ("shifts", "shifts", "gear_shift"), ("lockups", "lockups", "front_lockup_candidate"), ("wheelspin", "spins", "rear_wheelspin_candidate"))
_NUMBER = "CAST(substr(source_name, 4, 2) AS INTEGER) - 1"
_LAP_SQL = f"SELECT 'car ' || session_id AS car, lap_segment_index, sample_count, {_r('lap_time_s')} FROM l"
_MORE = "is_out_lap is_in_lap is_pit_lap".split()


def _counts() -> str:
    """Rows and columns of each table of a dataset."""
    rows = {"samples": "(SELECT count(*) FROM rec)", "laps": "(SELECT count(*) FROM l)", "sessions": "(SELECT count(DISTINCT session_id) FROM rec)", "quality/flags": "(SELECT count(*) FROM d WHERE step_m > 10)", "segments/passes": "(SELECT count(*) FROM p)"}
    width = {"samples": len(channels.SAMPLE_COLUMNS), "laps": len(laps.LAP_COLUMNS) + 4, "sessions": 23, "quality/flags": 8, "segments/passes": len(segments.PASS_COLUMNS), "setup/normalized": 10, "setup/diffs": 9}
    rows |= {f"events/{n}": f"(SELECT count(*) FROM {cte})" for n, cte, _ in _TABLES}
    width |= {f"events/{n}": len(events.BASE_COLUMNS) + len(c) for n, c in (("braking", events.BRAKING), ("throttle", events.THROTTLE), ("shifts", events.SHIFTS), ("lockups", events.WHEEL_EVENT), ("wheelspin", events.WHEEL_EVENT))}
    rows |= {"setup/normalized": "4", "setup/diffs": "3", "summaries/segment_statistics": "(SELECT count(*) FROM (SELECT DISTINCT segment_id, CASE WHEN place % 3 < 2 THEN place % 3 END FROM p JOIN placed USING (session_id)))"}
    width["summaries/segment_statistics"] = 5 + 9 * len(stats.METRICS) + 1
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST({n} AS BIGINT) AS rows, {width[t]}::BIGINT AS columns, true AS parquet" for t, n in rows.items())


PLACED = f"placed AS (SELECT session_id, dense_rank() OVER (ORDER BY source_name) - 1 AS place FROM (SELECT DISTINCT session_id, source_name FROM rec))"
_CONTEXT = f"""{CHAIN},{LAPS},{PASSES},{PLACED},
free AS (SELECT p.* FROM p JOIN placed USING (session_id) WHERE place % 3 = 2),
sized AS (SELECT *, count(*) FILTER (WHERE valid_for_comparison) OVER (PARTITION BY segment_id) AS valid FROM free)
SELECT 'sessions' AS name, NULL::VARCHAR AS key, CAST((SELECT count(DISTINCT session_id) FROM rec) AS DOUBLE) AS value
UNION ALL SELECT 'setups', NULL, (SELECT count(DISTINCT place % 3) FROM placed WHERE place % 3 < 2)
UNION ALL SELECT 'complete_laps', NULL, (SELECT count(*) FROM l WHERE is_complete) UNION ALL SELECT 'valid_laps', NULL, (SELECT count(*) FROM l WHERE is_valid)
UNION ALL SELECT 'flag_count', NULL, (SELECT count(*) FROM d WHERE step_m > 10) UNION ALL SELECT 'warning_count', NULL, (SELECT count(*) FROM d WHERE step_m > 10) UNION ALL SELECT 'error_count', NULL, 0
UNION ALL SELECT 'best_lap', NULL, round(lap_time_s, 6) FROM (SELECT lap_time_s FROM l WHERE is_complete ORDER BY lap_time_s LIMIT 10)
UNION ALL SELECT 'median_time_s', 'none:' || segment_id, round(median(segment_time_s), 6) FROM sized WHERE valid_for_comparison OR valid = 0 GROUP BY segment_id"""

ORACLES = {
    "recording_frames": f"""WITH {REC} SELECT source_name, car_index, source_frame, sample_index, source_lap_number, lap_time_ms, last_lap_ms, best_lap_ms, gear_raw, CAST(status AS INTEGER) AS status, yaw, gas, brake, clutch, steer, rpm, drivetrain_speed, bodywork_noise, fuel, fuel_per_lap, boost,
  position_x, position_y, position_z, rotation_x, yaw AS rotation_y, rotation_z, velocity_x, velocity_y, velocity_z, {_WHEELS} FROM rec""",
    "recording_columns": f"WITH {REC} SELECT source_name, car_id, sample_index, rpm, load_rr AS wheel_rr_load FROM rec",
    "recording_source": f"WITH {REC} SELECT source_name, car_index, driver_name, sample_index, rpm FROM rec WHERE driver_name = 'driver 3' AND car_index = 1",
    "recording_binary_files": f"WITH {REC} SELECT source_name, car_id, sample_index, clutch, lap_time_ms FROM rec",
    "recording_headers": f"""WITH {REC} SELECT source_name, car_index, car_id, driver_name, 'TST' AS nation_code, driver_team, 'plain' AS car_skin_id, CAST({_FILES} AS INTEGER) AS num_cars, 'ring' AS track_id, 'short' AS track_config, 'clear' AS weather, CAST(60 AS DOUBLE) AS interval_ms, frames AS frame_count,
  CASE WHEN car_index % 3 < 2 THEN CAST(6 + car_index % 3 AS INTEGER) END AS extra_version, CASE WHEN car_index % 3 < 2 THEN frames ELSE 0 END AS extra_frame_count, 16::INTEGER AS replay_version, 0::BIGINT AS current_recording_index,
  (SELECT max(frames) FROM cars c WHERE c.source_name = cars.source_name) AS replay_num_frames, 0::BIGINT AS num_track_objects, true AS has_patch, driver_name AS patch_driver_name FROM cars""",
    "driver_selection": f"WITH {REC} SELECT source_name, car_id, driver_name, sample_index FROM rec WHERE driver_name = 'driver ' || ((CAST(substr(source_name, 4, 2) AS INTEGER) - 1) % 7)",
    "frame_csv_lines": f"WITH {REC} SELECT source_name, car_index, sample_index AS frame, {_line()} AS line FROM rec",
    "frame_csv_preamble": f"WITH {REC} SELECT source_name, car_index, '{_LABELS}' || CASE WHEN car_index % 3 < 2 THEN '{_EXTRA}' ELSE '' END AS labels, {_PREAMBLE} AS preamble FROM cars",
    "frame_csv_files": f"""WITH {REC}, f AS (SELECT * FROM cars WHERE source_name = (SELECT min(source_name) FROM rec)),
stems AS (SELECT *, row_number() OVER (PARTITION BY driver_name ORDER BY car_index) AS k, count(*) OVER (PARTITION BY driver_name) AS cars_of FROM f),
twice AS (SELECT *, 0 AS round FROM stems UNION ALL SELECT *, 1 FROM stems)
SELECT replace(source_name, '.rec', '') || '_' || driver_name || CASE WHEN k + round * cars_of > 1 THEN ' (' || (k + round * cars_of) || ')' ELSE '' END || '.csv' AS file, frames + 19 AS lines FROM twice""",
    "setup_entries": f"WITH {SETUPS} SELECT source_file, section, parameter, raw_value, value_numeric, value_text FROM valued",
    "setup_normalized": f"WITH {SETUPS} SELECT replace(source_file, '.ini', '') AS setup_label, source_file, section, parameter, value_text, category, 16::INTEGER AS id_length FROM valued",
    "setup_bundle": f"""WITH {SETUPS}, files AS (SELECT source_file, row_number() OVER (ORDER BY source_file) AS n FROM (SELECT DISTINCT source_file FROM lines))
SELECT 'both' AS setup_label, source_file, CASE n WHEN 2 THEN 'SP:' ELSE '' END || section AS section, parameter, value_text, category, 1::BIGINT AS setups FROM valued JOIN files USING (source_file) WHERE n <= 2""",
    "segment_definitions": """WITH one AS (
  SELECT r_name AS segment_id, r_name AS segment_name, NULL::VARCHAR AS parent_segment_id, r_regionkey * 0.2::DOUBLE AS segment_start, r_regionkey * 0.2::DOUBLE + 0.2::DOUBLE AS segment_end FROM region
  UNION ALL SELECT n_name, CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) ELSE n_name END, r_name, n_nationkey / 100.0::DOUBLE, n_nationkey / 100.0::DOUBLE + 0.05::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT one.*, 'normalized_progress' AS coordinate, way FROM one, (VALUES ('driver'), ('table')) ways(way)""",
    "dataset_spec": f"""WITH {REC} SELECT source_name AS recording, CASE n % 3 WHEN 0 THEN 'even.ini' WHEN 1 THEN 'odd.ini' END AS setup, CASE n % 3 WHEN 1 THEN 'odd' END AS setup_label, CASE WHEN n % 4 = 0 THEN 'label ' || n END AS session_label, 'segments.json' AS segments
FROM (SELECT DISTINCT source_name, {_NUMBER} AS n FROM rec)""",
    "preprocess_samples": f"{CHAIN} SELECT 'car ' || session_id AS car, sample_index, source_frame, lap_segment_index, source_lap_number, gear_physical, {_FLAGS}, NULL::BOOLEAN AS is_in_pit, {_r(*_SAMPLES, 'coalesce(clutch / 255, 0) AS clutch_n')} FROM d",
    "preprocess_laps": f"""{_EVENTS} SELECT 'car ' || session_id AS car, lap_segment_index, source_lap_number, is_complete, is_valid, is_replay_fragment, {_r('lap_time_s', 'official_lap_time_s', 'start_fuel - end_fuel AS fuel_used', 'actual_distance_m', 'max_speed_kmh', 'braking_pct', 'full_throttle_time_s')},
  start_sample, end_sample, sample_count, {_CLASS}, (SELECT count(*) FROM braking x WHERE x.lap_id = l.lap_id) AS braking_event_count, (SELECT count(*) FROM shifts x WHERE x.lap_id = l.lap_id) AS shift_count,
  (SELECT count(*) FROM lockups x WHERE x.lap_id = l.lap_id) AS lockup_event_count, (SELECT count(*) FROM spins x WHERE x.lap_id = l.lap_id) AS wheelspin_event_count FROM l""",
    "preprocess_sessions": f"""{CHAIN},{LAPS},{PLACED},
rolled AS (SELECT session_id, count(*) AS frame_count, max(timestamp_s) AS duration FROM d GROUP BY session_id),
counted AS (SELECT session_id, count(*) AS lap_count_total, count(*) FILTER (WHERE is_complete) AS lap_count_complete FROM l GROUP BY session_id),
heads AS (SELECT DISTINCT session_id, source_name, car_index, car_id, driver_name, driver_team FROM rec)
SELECT car_id AS car, CASE WHEN place % 4 = 0 THEN 'label ' || place ELSE replace(source_name, '.rec', '') END || CASE WHEN (SELECT count(*) FROM heads h WHERE h.source_name = heads.source_name) > 1 THEN ' (' || driver_name || ')' ELSE '' END AS session_label, source_name, 'acreplay' AS source_format,
  strftime(strptime(substr(source_name, 4, 13), '%d%m%y-%H%M%S'), '%Y-%m-%d %H:%M:%S') AS recorded_at, car_index, 'ring' AS track_id, driver_name, driver_team, 'clear' AS weather, CAST(60 AS DOUBLE) AS sample_interval_ms, frame_count, lap_count_total, lap_count_complete,
  {_r('duration AS session_duration_s')}, place % 3 < 2 AS has_setup, (SELECT count(*) FROM heads h WHERE h.source_name = heads.source_name) AS num_cars
FROM heads JOIN rolled USING (session_id) JOIN counted USING (session_id) JOIN placed USING (session_id)""",
    "preprocess_events": f"{_EVENTS} " + " UNION ALL ".join(f"SELECT 'car ' || session_id AS car, '{kind}' AS event_type, start_sample, end_sample, {_r('duration_s', 'start_distance_m')} FROM {cte}" for _, cte, kind in _TABLES),
    "preprocess_passes": f"{CHAIN},{LAPS},{PASSES} SELECT 'car ' || session_id AS car, source_lap_number, segment_id, sample_count, {_r('segment_time_s', 'minimum_speed_kmh', 'brake_duration_s', 'actual_path_length_m')}, valid_for_comparison FROM p",
    "preprocess_flags": f"{CHAIN} SELECT 'car ' || session_id AS car, 'warning' AS severity, 'POSITION_JUMP' AS code, sample_index AS sample_start FROM d WHERE step_m > 10",
    "preprocess_setups": "SELECT * FROM (VALUES ('even', 'even.ini', 'WING_1', 'VALUE', '3', 'aero'), ('even', 'even.ini', 'FUEL', 'VALUE', '20', 'fuel'), ('odd', 'odd.ini', 'WING_1', 'VALUE', '5', 'aero'), ('odd', 'odd.ini', 'DIFF', 'POWER', 'True', 'differential')) t(setup_label, source_file, section, parameter, value_text, category)",
    "preprocess_diffs": "SELECT * FROM (VALUES ('WING_1', 'VALUE', '3', '5', 2::DOUBLE, false), ('FUEL', 'VALUE', '20', NULL, NULL, false), ('DIFF', 'POWER', NULL, 'True', NULL, false)) t(section, parameter, base_value, comparison_value, absolute_numeric_change, values_equal)",
    "preprocess_manifest": f"{_EVENTS},{PASSES},{PLACED} {_counts()}",
    "manifest_options": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in DEFAULT.to_dict().items()) + ") t(name, value)",
    "thresholds": """SELECT * FROM (VALUES ('position_jump_threshold_m', 10::DOUBLE), ('moving_speed_threshold_kmh', 50), ('brake_active_threshold', 0.10), ('full_throttle_threshold', 0.98), ('pedal_zero_threshold', 0.05), ('brake_gap_close_s', 0.15), ('minimum_brake_event_s', 0.20),
  ('minimum_brake_entry_speed_kmh', 50), ('lockup_slip_ratio_threshold', -0.25), ('lockup_minimum_speed_kmh', 80), ('wheelspin_slip_ratio_threshold', 0.08), ('wheelspin_minimum_throttle', 0.50), ('wheelspin_minimum_speed_kmh', 30), ('throttle_event_threshold', 0.05),
  ('minimum_throttle_event_s', 0.10), ('wheel_event_gap_close_s', 0.045), ('minimum_wheel_event_s', 0.030), ('time_reset_tolerance_ms', 5), ('duplicate_distance_tolerance_m', 1e-6)) t(name, value)""",
    "manifest_sources": f"""WITH {REC}, f AS (SELECT DISTINCT source_name, {_NUMBER} AS n FROM rec)
SELECT source_name AS name, 'ac_replay' AS type, 64::BIGINT AS hash_length FROM f UNION ALL SELECT CASE n % 3 WHEN 0 THEN 'even.ini' ELSE 'odd.ini' END, 'ac_setup_ini', 64 FROM f WHERE n % 3 < 2""",
    "preprocess_context": _CONTEXT,
    "summarize_context": _CONTEXT,
    "dataset_validation": """WITH t(name) AS (VALUES ('samples'), ('events/braking'), ('events/throttle'), ('events/shifts'), ('events/lockups'), ('events/wheelspin'), ('laps'), ('sessions'), ('quality/flags'), ('setup/normalized'), ('setup/diffs'), ('segments/passes'), ('summaries/segment_statistics'))
SELECT 'whole' AS dataset, 'check table:' || name AS name, 'pass' AS value FROM t UNION ALL SELECT * FROM (VALUES ('whole', 'status', 'ok'), ('whole', 'check manifest', 'pass'), ('whole', 'check required_tables', 'pass'),
  ('damaged', 'status', 'error'), ('damaged', 'check manifest', 'pass'), ('damaged', 'check required_tables', 'fail'), ('damaged', 'check table:laps', 'pass'), ('damaged', 'check table:samples', 'fail'), ('damaged', 'warning', 'MISSING_TABLES'),
  ('damaged', 'warning', 'ROW_COUNT_MISMATCH'), ('damaged', 'warning', 'MISSING_TABLE_FILE'), ('absent', 'status', 'error'), ('absent', 'check manifest', 'fail'), ('absent', 'warning', 'MISSING_MANIFEST'))""",
    "merge_laps": f"{CHAIN},{LAPS}, both_l AS ({_LAP_SQL}) SELECT * FROM both_l UNION ALL SELECT car, lap_segment_index, sample_count, lap_time_s + 1 FROM both_l WHERE lap_segment_index % 2 = 0",
    "merge_manifest": "SELECT * FROM (VALUES ('tables', 'laps'), ('schema_version', '2'), ('merged_id', 'True'), ('old_file', 'False')) t(name, value)",
    "table_formats": "SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS price, kind, (SELECT count(*) FROM part) AS stored_rows, path FROM part, (VALUES ('auto', 'a/part.parquet'), ('parquet', 'a/part.parquet'), ('csv', 'a/part.csv')) f(kind, path)",
    "table_export": f"{CHAIN},{LAPS} SELECT 'car ' || session_id AS car, lap_segment_index, {_r('lap_time_s')}, (SELECT count(*) FROM l) AS exported FROM l",
    "overwrite_guard": "SELECT * FROM (VALUES ('refused', 'FileExistsError', true), ('failed', 'FileNotFoundError', true), ('versions', 'ValueError', true)) t(name, outcome, old_file)",
    "commands": f"""WITH {REC} SELECT * FROM (VALUES ('inspect', 0::BIGINT, (SELECT count(*) FROM cars WHERE source_name = (SELECT min(source_name) FROM rec)), NULL::VARCHAR), ('validate', 0, NULL, 'ok'), ('summarize', 0, NULL, NULL), ('export', 0, (SELECT count(*) FROM cars), 'ok'), ('merge', 0, NULL, 'ok'),
  ('merge again', 2, NULL, NULL), ('preprocess', 0, NULL, 'ok'), ('no table', 2, NULL, NULL), ('no dataset', 2, NULL, 'error'), ('no recording', 1, NULL, NULL)) t(command, code, rows, status)""",
    "preprocess_columns": "SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, '{channels.EXPORT_NAMES.get(c, c)}', '{'boolean' if c.startswith('is_') else 'bigint' if c in ('sample_index', 'source_frame', 'lap_segment_index', 'source_lap_number', 'gear_raw', 'gear_physical') else 'string' if c in ('session_id', 'lap_id', 'progress_source') else 'double'}')" for n, c in enumerate(channels.SAMPLE_COLUMNS)) + ") t(place, name, type)",
}
