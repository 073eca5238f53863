"""Setup tables (one row for each setup, section and parameter) and their pairwise differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.functions.expressions import setup_category

SETUP = "setup_id string, setup_label string, source_file string, source_hash string, section string, parameter string, raw_value string, value_numeric double, value_text string, category string"
DIFF_COLUMNS = ("base_setup_id", "comparison_setup_id", "section", "parameter", "category", "base_value", "comparison_value", "absolute_numeric_change", "values_equal")


def with_category(table: DataFrame, section: str = "section") -> DataFrame:
    return table.withColumn("category", setup_category(F.col(section)))


def differences(table: DataFrame, order: str = "ord") -> DataFrame:
    """For every ordered pair of setups the keys of either, with both values; ``order`` ranks rows as read.

    Setups are ordered by their first row, and of a repeated key the first row counts. Pairs are
    expanded on the keys that a setup has, so the work follows the result's size.
    """
    first = table.withColumn("__n", F.row_number().over(Window.partitionBy("setup_id", "section", "parameter").orderBy(order))).where("__n = 1").drop("__n")
    setups = table.groupBy("setup_id").agg(F.min(order).alias("__at"))
    a, b = setups.select(F.col("setup_id").alias("base_setup_id"), F.col("__at").alias("__a")), setups.select(F.col("setup_id").alias("comparison_setup_id"), F.col("__at").alias("__b"))
    pairs = a.join(b, F.col("__a") < F.col("__b")).select("base_setup_id", "comparison_setup_id")
    row = F.struct("value_numeric", "value_text", "category")
    base = pairs.join(first.select(F.col("setup_id").alias("base_setup_id"), "section", "parameter", row.alias("x")), "base_setup_id")
    comparison = pairs.join(first.select(F.col("setup_id").alias("comparison_setup_id"), "section", "parameter", row.alias("y")), "comparison_setup_id")
    keys = ["base_setup_id", "comparison_setup_id", "section", "parameter"]
    both = base.join(comparison, keys, "full_outer")
    return both.select(
        *keys, F.coalesce("y.category", "x.category").alias("category"), F.col("x.value_text").alias("base_value"), F.col("y.value_text").alias("comparison_value"),
        (F.col("y.value_numeric") - F.col("x.value_numeric")).alias("absolute_numeric_change"), F.coalesce(F.col("x.value_text") == F.col("y.value_text"), F.lit(False)).alias("values_equal"),
    )
