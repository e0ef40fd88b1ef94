"""Registration of snapshots as they arrive in a landing folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from recordloom.session import stage
from recordloom.sources import content_index as I
from recordloom.sources import manifests as M
from recordloom.sources.listing import list_empty_files, path_exists

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
_REJECT_SCHEMA = "path string, rule string, batch bigint"
#: Files of one batch at most: what is looked up in the index, and broadcast for it, is bounded.
BATCH_FILES = 100_000


def report_empty_files(spark: SparkSession, landing: str, reject_table: str) -> None:
    """Add the landed files without content to the rejects, each once. They never enter a stream, so they are listed apart."""
    empty = list_empty_files(spark, landing, ".csv").select("path", F.lit("empty").alias("rule"))
    if path_exists(spark, reject_table):
        empty = empty.join(spark.read.schema(_REJECT_SCHEMA).parquet(reject_table).select("path"), "path", "left_anti")
    fresh = stage(empty, "empty_files")
    if not fresh.isEmpty():
        # Batches of a stream count from 0; a number of its own keeps a run apart from all others.
        fresh.write.parquet(f"{reject_table}/batch=-{time.time_ns()}")


def land_new_files(
    spark: SparkSession,
    landing: str,
    root: str,
    manifest_table: str,
    reject_table: str,
    sources: DataFrame,
    checkpoint: str,
    index: str | None = None,
) -> StreamingQuery:
    """Register every file not seen before below ``<landing>/<source>/`` and store new content.

    Each batch writes the manifests of its files to its own folder of the manifest table, and the files that it
    cannot register, with the reason, to one of the reject table: every landed file is in one of the two. Files without
    content are reported first, whether or not any batch follows. ``index`` (by default beside ``root``) tells which content is
    stored; a batch reads only the parts of it that its own hashes fall in. A batch
    that is run again after a failure replaces its folders and finds its content stored, so the outcome is the same.
    Only names and sizes travel in the stream; contents are read by the hashing tasks.
    """
    index = index or root.rstrip("/") + "_index"
    report_empty_files(spark, landing, reject_table)
    if not path_exists(spark, index) and path_exists(spark, root):
        I.build_index(spark, root, index)

    def register(batch: DataFrame, batch_id: int) -> None:
        files = batch.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
        hashed = stage(M.hash_files(files), "landed")
        M.landing_rejects(hashed, sources).write.mode("overwrite").parquet(f"{reject_table}/batch={batch_id}")
        registered = M.register_snapshots(hashed.where(F.col("header_line")), files, sources)
        folder = f"{manifest_table}/batch={batch_id}"
        registered.write.mode("overwrite").parquet(folder)
        written = spark.read.schema(registered.schema).parquet(folder)
        fresh = M.new_content(written, I.stored_among(spark, written, index))
        M.store_content(fresh, root).write.format("noop").mode("overwrite").save()
        I.add_to_index(written, index, batch_id)

    stream = (
        spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
        .options(recursiveFileLookup="true", pathGlobFilter="*.csv", maxFilesPerTrigger=str(BATCH_FILES)).load(landing)
    )
    return (
        stream.writeStream.foreachBatch(register).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )
