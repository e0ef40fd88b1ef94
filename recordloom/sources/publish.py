"""Outputs that appear at once: each run writes its own folder, and a pointer file names the run that counts.

A run that fails, in a task, in the driver or by its own checks, leaves the pointer where it was; the same run started again
replaces its folder. Rows are counted, and checks are made, while the output is written, so nothing is read again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.checks import GateError

_POINTER = "_current"


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def _set_pointer(spark: SparkSession, path: str, payload: dict) -> None:
    """The pointer is written apart and renamed over the old one, so that a reader sees either."""
    gateway, fs = spark.sparkContext._gateway, spark._jvm.org.apache.hadoop.fs
    target, system = _file_system(spark, f"{path}/{_POINTER}")
    part, _ = _file_system(spark, f"{path}/{_POINTER}-{uuid.uuid4().hex}")
    stream = system.create(part, True)
    stream.write(bytearray(json.dumps(payload).encode()))
    stream.close()
    kinds = getattr(fs, "Options$Rename")
    overwrite = gateway.new_array(kinds, 1)
    overwrite[0] = kinds.OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(part, target, overwrite)


def published(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: run, format and rows; None if nothing has been published."""
    target, system = _file_system(spark, f"{path.rstrip('/')}/{_POINTER}")
    if not system.exists(target):
        return None
    stream = system.open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def publish(
    df: DataFrame,
    path: str,
    run: str,
    forbidden: dict[str, Column] | None = None,
    hidden: tuple[str, ...] = (),
    format: str = "parquet",
    **options: str,
) -> int:
    """Write ``df`` as one run of the output at ``path`` and make it the current one; returns the number of rows.

    ``forbidden`` are conditions that no row may meet; if one does, the output stays as it was and a GateError tells how
    often. ``hidden`` columns serve these conditions and are not written.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    forbidden = forbidden or {}
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(broken).alias(name) for name, broken in forbidden.items()])
    observed.drop(*hidden).write.format(format).options(**options).mode("overwrite").save(f"{path}/run={run}")
    found = seen.get
    broken = {name: found[name] for name in forbidden if found.get(name)}
    if broken:
        raise GateError(f"{path}: run {run} is not published: {broken}")
    rows = found.get("rows", 0)
    _set_pointer(spark, path, {"run": run, "format": format, "rows": rows})
    return rows


def read_published(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The current run of an output."""
    current = published(spark, path)
    if current is None:
        raise GateError(f"{path}: nothing has been published")
    return spark.read.format(current["format"]).options(**options).load(f"{path.rstrip('/')}/run={current['run']}")
