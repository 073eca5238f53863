"""Setup files (INI) as rows of section, parameter and value, and segment definitions (JSON)."""

from __future__ import annotations

import configparser
import hashlib
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.functions.expressions import SETUP_CATEGORIES, stable_id

SCHEMA = "source_path string, source_file string, source_hash string, ord long, section string, parameter string, raw_value string, value_numeric double, value_text string"


def parsed_value(text: str) -> int | float | bool | str:
    """Number, else true or false, else the text, as Python reads them."""
    text = text.strip()
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.lower() == "true" if text.lower() in ("true", "false") else text


def category(section: str) -> str:
    return next((c for p, c in SETUP_CATEGORIES if section.upper().startswith(p)), "other")


def entries(content: bytes) -> list[tuple[str, str, str, float | None, str]]:
    """(section, parameter, raw value, number or None, text); keys keep their case, a repeated key's last value counts."""
    ini = configparser.ConfigParser(interpolation=None, strict=False)
    ini.optionxform = str
    ini.read_string(content.decode("utf-8-sig"))
    out = []
    for section in ini.sections():
        for key, raw in ini.items(section):
            value = parsed_value(raw or "")
            out.append((section, key, raw, float(value) if isinstance(value, int | float) else None, str(value)))
    return out


def _rows(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            digest, name = hashlib.sha256(content).hexdigest(), PurePosixPath(path).name
            rows = [(path, name, digest, n, *entry) for n, entry in enumerate(entries(content))]
            if rows:
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
                names = [part.strip().split()[0] for part in SCHEMA.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Entries of setup files, whatever store Spark reads them from."""
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_rows, SCHEMA)


def normalised(table: DataFrame, label: str | None = None) -> DataFrame:
    """The stored setup columns; an id comes from name and content, the label defaults to the file's stem."""
    from pitwall.functions.expressions import setup_category

    stem = F.regexp_replace("source_file", r"(?<=.)\.[^.]*$", "")
    return table.select(
        stable_id(F.col("source_file"), F.col("source_hash")).alias("setup_id"), (F.lit(label) if label else stem).alias("setup_label"), "source_file", "source_hash",
        "section", "parameter", "raw_value", "value_numeric", "value_text", setup_category(F.col("section")).alias("category"), "ord",
    )


def bundle(spark: SparkSession, ini: str, sp: str | None = None, label: str | None = None) -> DataFrame:
    """A setup and its companion file, whose sections get the prefix SP: and the setup's id and label."""
    main = normalised(read_files(spark, ini), label)
    if sp is None:
        return main
    head = main.select(F.col("setup_id").alias("__id"), F.col("setup_label").alias("__label")).limit(1)
    second = normalised(read_files(spark, sp), label).join(F.broadcast(head))  # a single row
    second = second.withColumn("setup_id", F.col("__id")).withColumn("setup_label", F.col("__label")).withColumn("section", F.concat(F.lit("SP:"), "section"))
    return main.unionByName(second.withColumn("ord", F.col("ord") + F.lit(1 << 32)).drop("__id", "__label"))


def load_definitions(spark: SparkSession, path: str) -> dict:
    """A segment definition file; its coordinate must be known."""
    from pitwall.operators.segments import COORDINATES
    from pitwall.sources.files import Files

    data = Files(spark).load(path)
    if not isinstance(data.get("segments"), list):
        raise ValueError("a definition file needs a list of segments")
    if data.get("coordinate", "actual_distance_m") not in COORDINATES:
        raise ValueError(f"unsupported segment coordinate: {data['coordinate']}")
    return data
