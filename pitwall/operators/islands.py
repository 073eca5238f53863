"""Runs of true flags (gaps and islands), with short gaps closed first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAP = ("session_id", "lap_id")


def gap_samples(seconds: float, by: tuple[str, ...] = LAP) -> Column:
    """A gap in samples of the lap's median step, rounded half to even, at least 1."""
    step = F.greatest(F.median("dt_s").over(Window.partitionBy(*by)), F.lit(1e-6))
    return F.greatest(F.lit(1), F.bround(F.lit(seconds) / step)).cast("long")


def close_gaps(df: DataFrame, flag: str, most: Column | int, by: tuple[str, ...] = LAP, order: str = "sample_index") -> DataFrame:
    """Set ``flag`` in runs of false of at most ``most`` rows that have true on both sides."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("__row", F.row_number().over(w)).withColumn("__most", F.lit(most) if isinstance(most, int) else most)
    here = F.when(F.col(flag), F.col("__row"))
    df = df.withColumn("__before", F.max(here).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__after", F.min(here).over(w.rowsBetween(0, Window.unboundedFollowing)))
    filled = F.col(flag) | F.coalesce(F.col("__after") - F.col("__before") - 1 <= F.col("__most"), F.lit(False))
    return df.withColumn(flag, filled).drop("__row", "__before", "__after", "__most")


def true_runs(df: DataFrame, flag: str, by: tuple[str, ...] = LAP, order: str = "sample_index") -> DataFrame:
    """Keep the rows with ``flag`` and number their runs in ``run_id``, from 1 in each group."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    df = df.withColumn("__start", F.when(starts, 1).otherwise(0))
    return df.withColumn("run_id", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(flag)).drop("__start")
