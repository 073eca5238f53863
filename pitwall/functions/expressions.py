"""Column expressions without state: ids, pedals, gears, wheel aggregates, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_SEPARATOR = "\u001f"
#: Prefixes of setup sections and their categories, tried in order (fixed values).
SETUP_CATEGORIES = (
    ("WING", "aero"), ("INTERNAL_GEAR", "gearing"), ("FINAL_RATIO", "gearing"), ("DIFF", "differential"),
    ("BRAKE", "brakes"), ("FRONT_BIAS", "brakes"), ("TRACTION_CONTROL", "driver_aids"), ("ABS", "driver_aids"),
    ("FUEL", "fuel"), ("TYRES", "tyres"), ("PRESSURE", "tyres"), ("CAMBER", "alignment"), ("TOE", "alignment"),
    ("ARB", "suspension"), ("SPRING", "suspension"), ("DAMP", "dampers"), ("BUMP_STOP", "suspension"),
    ("PACKER", "suspension"), ("ROD_LENGTH", "ride_height"),
)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts; a missing part counts as the text None."""
    return F.substring(F.sha2(F.concat_ws(ID_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


def yes(condition: Column) -> Column:
    """A condition over missing values is false, never unknown."""
    return F.coalesce(condition, F.lit(False))


def pedal(raw: Column) -> Column:
    """0..255 to 0..1; missing is released."""
    return F.coalesce(F.least(F.greatest(raw / F.lit(255.0), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def physical_gear(raw: Column) -> Column:
    """Recorded gears count from reverse 0 and neutral 1; both are no driving gear."""
    return F.when(raw >= 2, raw - 1).otherwise(F.lit(0)).cast("long")


def _present(*columns: Column) -> Column:
    return sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def row_sum(*columns: Column) -> Column:
    """Sum of what is present; missing only if all are."""
    return F.when(_present(*columns) > 0, sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0))))


def row_mean(*columns: Column) -> Column:
    return row_sum(*columns) / F.nullif(_present(*columns), F.lit(0))


def setup_category(section: Column) -> Column:
    upper = F.upper(section)
    out = None
    for prefix, category in SETUP_CATEGORIES:
        out = F.when(upper.startswith(prefix), category) if out is None else out.when(upper.startswith(prefix), category)
    return out.otherwise("other")


def recorded_at(file_name: Column) -> Column:
    """The time in a recording's file name (day, month, two-digit year, time), or null; years 69 to 99 are 19yy."""
    stamp = F.regexp_extract(file_name, r"(?i)(?:^|_)AC_(\d{6}-\d{6})_", 1)
    two = F.substring(stamp, 5, 2).try_cast("int")
    full = F.concat(F.substring(stamp, 1, 4), F.when(two >= 69, "19").otherwise("20"), F.substring(stamp, 5, 9))
    return F.try_to_timestamp(F.when(stamp != "", full), F.lit("ddMMyyyy-HHmmss"))
