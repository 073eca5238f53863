"""Helpers shared by the corpus operators: the shared folder, input columns, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space between words: code points 9 to 13 and 32, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a temporary folder; on a cluster that is an
    error, as executors elsewhere could not read what is written there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        ours = sc._jsc.sc().getCheckpointDir()
        found = ours.get() if ours.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pitwall-shared-")
        sc.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found, True)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; :func:`remove`, :func:`discard` or the end of the driver deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, name: str, compression: str = "snappy", **options: int) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the table back; :func:`discard` deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression=compression, **options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no later plan reads, and let Spark drop the shuffle files of plans that are gone."""
    for table in tables:
        remove(table.sparkSession, table._scratch)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def isolated(docs: DataFrame, **needed: str) -> DataFrame:
    """The whole row as struct ``row`` (fields c0, c1, ... by position) and each ``needed`` column under its keyword.

    Nothing but these names can be met afterwards, so that columns of the input may have any name, also one that an
    operator uses inside or that differs from another in case only. A needed column is found by its exact name,
    else by the only name equal but for case.
    """
    by_position = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return by_position.select(F.struct(*by_position.columns).alias("row"), *[F.col(f"c{position(docs, name)}").alias(k) for k, name in needed.items()])


def position(docs: DataFrame, name: str) -> int:
    """Where the column ``name`` stands."""
    exact = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(exact) != 1:
        raise ValueError(f"one column {name!r} is needed, {len(exact)} were found")
    return exact[0]


def restored(df: DataFrame, docs: DataFrame, replaced: dict[str, Column] | None = None, added: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` from ``row``, some ``replaced``, and those ``added``, which take the place of columns so named in any case."""
    replaced, added = replaced or {}, added or {}
    at = {position(docs, name): value for name, value in replaced.items()}
    new = {name.lower() for name in added}
    kept = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in new or i in at]
    values = [at[i] if i in at else F.col("row")[f"c{i}"] for i, _ in kept] + [*added.values()]
    return df.select(*[v.alias(f"o{k}") for k, v in enumerate(values)]).toDF(*[c for _, c in kept], *added)


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, whatever else ``docs`` has."""
    return isolated(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def checkpointed(df: DataFrame) -> DataFrame:
    """A small intermediate table of which no later step may recompute the lineage."""
    return written(df, "step")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with state per task: ``make`` runs once in the worker and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            out = one(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Bound the bytes of the Arrow batches sent to Python by what runs inside, for tables with rows of megabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def utf8_parts(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a string column without a copy for each row, and its n + 1 offsets (nulls: empty)."""
    import numpy as np

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(data if data is not None else b""), at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that are broadcast at most: 16 MB as rows of one long.
BROADCAST_KEYS = 1_000_000


def only(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Join ``df`` with ``keys`` (a distinct ``column`` and perhaps another long); broadcasts them only if counted to be few."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, column)
