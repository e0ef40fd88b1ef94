"""Acquisition manifests: reading, newest artifacts, hashing, verification, registration."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import ship_package
from recordloom.sources.documents import DOCUMENT_BYTES, read_json
from recordloom.sources.listing import dealt, file_name, is_data, list_folders
from recordloom.sources.listing import open_stream as _open

ACQUIRE = "acquire-csv"
FREEZE = "freeze-metadata"

MANIFEST_SCHEMA = (
    "manifest_version bigint, operation string, source_slug string, dataset_id string, title string, "
    "artifact string, receipt struct<bytes: bigint, requested_url: string, response_url: string, "
    "response_headers: map<string,string>, retrieved_at: string, sha256: string, status: bigint>, "
    "details struct<columns: bigint, rows_updated_at: bigint, publication_date: bigint, "
    "view_last_modified: bigint>"
)
HASH_SCHEMA = "path string, sha256 string, bytes bigint, header_line boolean"
_CHUNK = 1 << 20
_BATCH_BYTES = 4 << 20


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest document; ``manifest`` is its file name."""
    return read_json(spark, path, MANIFEST_SCHEMA).withColumn("manifest", file_name(F.col("path"))).drop("path")


def latest_artifacts(manifests: DataFrame) -> DataFrame:
    """(source, operation, artifact, retrieved_at): greatest retrieval time as text.

    Equal times go to the greatest artifact name. Map-side aggregation, one row per source crosses.
    """
    at = F.col("receipt.retrieved_at")
    latest = manifests.groupBy(F.col("source_slug").alias("source"), "operation").agg(
        F.max(F.struct(at.alias("retrieved_at"), F.col("artifact"))).alias("newest")
    )
    return latest.select("source", "operation", "newest.artifact", "newest.retrieved_at")


def latest_profiles(profiles: DataFrame, name: str = "profile_file") -> DataFrame:
    """The profile rows whose file name is the greatest of their source."""
    newest = profiles.groupBy("source").agg(F.max(name).alias(name))
    return profiles.join(newest, ["source", name], "left_semi")


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, bytes, modified) of the files with content below the folder ``root``; no content is read.

    As with Spark's readers, names that begin with ``_`` or ``.`` are passed over, and ``glob`` has Hadoop's syntax. Folders are
    listed by tasks, and the files are dealt to as many parts as reading them takes.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    wanted = is_data(F.col("path")) & file_name(F.col("path")).rlike(rf"(?s)^(?:{pattern})\z") & (F.col("bytes") > 0)
    files = dealt(list_folders(spark, [root], is_data(F.col("path"))).where(wanted))
    return files.select("path", "bytes", F.date_trunc("millisecond", "modified").alias("modified"))


def _hash_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            digest, size, comma, header = hashlib.sha256(), 0, False, None
            with _open(path) as stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
                    if header is None:  # the first line may be longer than a chunk
                        first, newline, _ = chunk.partition(b"\n")
                        comma = comma or b"," in first
                        header = comma if newline else None
            rows.append((path, digest.hexdigest(), size, bool(header)))
        yield pd.DataFrame(rows, columns=["path", "sha256", "bytes", "header_line"])


def hash_files(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes, header_line) of each listed file.

    ``list_files`` spreads the files by size over the tasks; a file is read in chunks, so its size does not
    matter to memory. ``header_line`` tells whether its first line, however long, looks like a CSV header.
    """
    ship_package(files.sparkSession)
    return files.select("path").mapInPandas(_hash_paths, HASH_SCHEMA)


def write_files(contents: DataFrame, root: str) -> DataFrame:
    """Write each (artifact, content) row as one file below ``root``, in the tasks; lists what was written.

    A file appears under its name when it is complete, so a task that is run again starts over.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        base = root if "://" in root else "file://" + root.removeprefix("file:")
        for batch in batches:
            for artifact, content in zip(batch["artifact"], batch["content"]):
                system, name = fs.FileSystem.from_uri(f"{base.rstrip('/')}/{artifact}")
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name + ".part") as sink:
                    sink.write(content)
                system.move(name + ".part", name)
            yield batch[["artifact"]]

    ship_package(contents.sparkSession)
    return contents.select("artifact", "content").mapInPandas(write, "artifact string")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` of a file found by listing it."""
    bare = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    return F.substring(path, F.locate(bare + "/", path) + len(bare) + 1, F.length(path))


def verify_artifacts(spark: SparkSession, manifests: DataFrame, root: str) -> DataFrame:
    """(manifest, artifact, rule): artifacts that are missing or differ in hash or byte count."""
    stored = hash_files(list_files(spark, root)).select(
        relative_path(F.col("path"), root).alias("artifact"), "sha256", "bytes"
    )
    return artifact_violations(manifests, stored)


def artifact_violations(manifests: DataFrame, stored: DataFrame) -> DataFrame:
    expected = manifests.select(
        "manifest",
        "artifact",
        F.col("receipt.sha256").alias("expected_sha256"),
        F.col("receipt.bytes").alias("expected_bytes"),
    )
    joined = expected.join(stored, "artifact", "left")
    same = F.col("sha256").eqNullSafe(F.col("expected_sha256")) & F.col("bytes").eqNullSafe(
        F.col("expected_bytes")
    )
    rule = F.when(F.col("sha256").isNull(), "missing").when(~same, "integrity_mismatch")
    return joined.select("manifest", "artifact", rule.alias("rule")).where(F.col("rule").isNotNull())


def snapshot_violations(hashed: DataFrame) -> DataFrame:
    """Landed files without a recognizable CSV header line, and empty ones."""
    rule = F.when(F.col("bytes") == 0, "empty").when(~F.col("header_line"), "no_csv_header")
    return hashed.select("path", rule.alias("rule")).where(F.col("rule").isNotNull())


def source_of(path: Column) -> Column:
    """The source a landed file ``<landing>/<source>/<file>`` belongs to."""
    return F.element_at(F.split(path, "/"), -2)


def landing_rejects(hashed: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, rule): landed files that cannot be registered. Every other file gets a manifest.

    A file is reported once, under the first rule that it breaks: empty, no_csv_header or unknown_source.
    """
    known = sources.select(F.col("source").alias("_known")).distinct()
    joined = hashed.join(known, source_of(F.col("path")) == F.col("_known"), "left")
    rule = (
        F.when(F.col("bytes") == 0, "empty")
        .when(~F.col("header_line"), "no_csv_header")
        .when(F.col("_known").isNull(), "unknown_source")
    )
    return joined.select("path", rule.alias("rule")).where(F.col("rule").isNotNull())


def metadata_violations(metadata: DataFrame, sources: DataFrame) -> DataFrame:
    """Metadata documents (source, id) that name another dataset than their contract."""
    joined = metadata.join(sources, "source", "left")
    wrong = ~F.coalesce(F.col("id") == F.col("dataset_id"), F.lit(False))
    return joined.where(wrong).select("source", F.lit("other_dataset").alias("rule"))


def register_snapshots(
    hashed: DataFrame, files: DataFrame, sources: DataFrame, operation: str = ACQUIRE, suffix: str = ".csv"
) -> DataFrame:
    """Manifest rows for landed files ``<landing>/<source>/<file>``, one per observed file.

    The artifact is named by its content, so equal files share one. Files of unknown sources have no place to go;
    ``landing_rejects`` reports them.
    """
    folder = "raw" if operation == ACQUIRE else "metadata"
    observed = hashed.join(files.select("path", "modified"), "path")
    known = observed.withColumn("source", source_of(F.col("path"))).join(sources, "source")
    artifact = F.concat(F.lit(f"data/{folder}/"), "dataset_id", F.lit("/"), "sha256", F.lit(suffix))
    utc = F.to_utc_timestamp("modified", F.current_timezone())
    retrieved = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return known.select(
        F.lit(1).cast("bigint").alias("manifest_version"),
        F.lit(operation).alias("operation"),
        F.col("source").alias("source_slug"),
        "dataset_id",
        artifact.alias("artifact"),
        F.struct(
            "bytes",
            F.col("path").alias("requested_url"),
            F.col("path").alias("response_url"),
            retrieved.alias("retrieved_at"),
            "sha256",
        ).alias("receipt"),
        F.concat_ws(
            "-", F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'"), F.lit(operation), "source",
            F.substring("sha256", 1, 12),
        ).alias("manifest"),
        "path",
    )


def new_content(registered: DataFrame, manifests: DataFrame) -> DataFrame:
    """(artifact, path): one landed file for each artifact that is not stored yet."""
    fresh = registered.join(manifests.select("artifact").distinct(), "artifact", "left_anti")
    return fresh.groupBy("artifact").agg(F.min("path").alias("path"))


def _copier(root: str):
    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        base = root if "://" in root else "file://" + root.removeprefix("file:")
        for batch in batches:
            for artifact, path in zip(batch["artifact"], batch["path"]):
                system, name = fs.FileSystem.from_uri(f"{base.rstrip('/')}/{artifact}")
                system.create_dir(name.rpartition("/")[0], recursive=True)
                # A retried task starts over under the temporary name, so no part of a file is seen.
                with _open(path) as source, system.open_output_stream(name + ".part") as sink:
                    while chunk := source.read(_CHUNK):
                        sink.write(chunk)
                system.move(name + ".part", name)
            yield batch[["artifact"]]

    return copy


def store_content(content: DataFrame, root: str) -> DataFrame:
    """Copy new content to its artifact path below ``root``, in the tasks; lists what was stored."""
    ship_package(content.sparkSession)
    return content.select("artifact", "path").mapInPandas(_copier(root), "artifact string")


def describe_documents(contents: DataFrame) -> DataFrame:
    """(artifact, sha256, bytes, id) of JSON documents (artifact, content): each content is read once, in the JVM.

    ``id`` is the text of the document's own key; null if it has none or is not an object.
    """
    document = F.from_json(F.col("content").cast("string"), "id string")
    return contents.select(
        "artifact", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes"), document["id"].alias("id")
    )


class KeyReader:
    """The value of one top-level key of a JSON object that is fed in pieces; of repeated keys the last counts."""

    _MARKS = re.compile(rb'[{}\[\],:"\\]')

    def __init__(self, key: str) -> None:
        self.key, self.depth, self.quoted, self.escaped, self.sound = key, 0, False, False, True
        self.name: bytearray | None = None
        self.raw: bytearray | None = None
        self.names, self.found = True, None

    def feed(self, piece: bytes) -> None:
        last = 0  # what lies before it has gone to the name or value that is being read
        at = 0
        while at < len(piece):
            if self.escaped:  # the character behind a backslash
                self.escaped, at = False, at + 1
                continue
            mark = self._MARKS.search(piece, at)
            if mark is None:
                break
            char, at = mark.group(), mark.end()
            if char == b"\\":
                self.escaped = self.quoted
            elif char == b'"':
                self.quoted = not self.quoted
                if self.depth == 1 and self.names:
                    if self.quoted:
                        self.name, last = bytearray(), at
                    elif self.name is not None:
                        self.name += piece[last : at - 1]
                        self.label = json.loads(b'"' + self.name + b'"')
                        self.name = None
            elif not self.quoted:
                if char in b"{[":
                    self.depth += 1
                    self.sound = self.sound and (self.depth > 1 or char == b"{")
                elif self.depth == 1 and char == b":":
                    self.names = False
                    if self.label == self.key:
                        self.raw, last = bytearray(), at
                elif self.depth == 1 and char in b",}":
                    if self.raw is not None:
                        self.raw += piece[last : at - 1]
                        text = self.raw.decode().strip()
                        value = json.loads(text)
                        self.found, self.raw = value if value is None or isinstance(value, str) else text, None
                    self.names = True
                if char in b"}]":
                    self.depth -= 1
        for part in (self.name, self.raw):
            if part is not None:
                part += piece[last:]

    @property
    def value(self) -> str | None:
        return self.found if self.sound and not self.depth and not self.quoted else None


def _describe_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            digest, size, reader = hashlib.sha256(), 0, KeyReader("id")
            with _open(path) as stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
                    if reader is not None:
                        try:
                            reader.feed(chunk)
                        except ValueError:  # not JSON: it names no dataset
                            reader = None
            rows.append((path, digest.hexdigest(), size, reader.value if reader else None))
        yield pd.DataFrame(rows, columns=["path", "sha256", "bytes", "id"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    paths, contents, size = [], [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _open(path) as stream:
                contents.append(stream.read())
            paths.append(path)
            size += len(contents[-1])
            if size >= _BATCH_BYTES:
                yield batch_of()
                paths, contents, size = [], [], 0
    if paths:
        yield batch_of()


def stored_documents(files: DataFrame, root: str, whole: int = DOCUMENT_BYTES) -> DataFrame:
    """``read_documents`` of files that ``list_files`` has listed below ``root``: no list of them passes through the driver."""
    ship_package(files.sparkSession)
    artifact = relative_path(F.col("path"), root).alias("artifact")
    read = files.where(F.col("bytes") <= whole).select("path").mapInArrow(_contents, "path string, content binary")
    large = files.where(F.col("bytes") > whole).select("path").mapInPandas(_describe_paths, "path string, sha256 string, bytes bigint, id string")
    return describe_documents(read.select(artifact, "content")).unionByName(large.select(artifact, "sha256", "bytes", "id"))


def read_documents(spark: SparkSession, root: str, glob: str = "*.json", whole: int = DOCUMENT_BYTES) -> DataFrame:
    """(artifact, sha256, bytes, id) of the JSON documents stored below ``root``; every file is opened once.

    Documents of at most ``whole`` bytes are values of a column. Larger ones are read in chunks by the tasks: hash and key alike.
    Spark lists the folder in the driver, so ``stored_documents`` serves stores of many files.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=glob).load(root)
    artifact = relative_path(F.col("path"), root).alias("artifact")
    small = describe_documents(files.where(F.col("length") <= whole).select(artifact, "content"))
    ship_package(spark)
    large = files.where(F.col("length") > whole).select("path").mapInPandas(_describe_paths, "path string, sha256 string, bytes bigint, id string")
    return small.unionByName(large.select(artifact, "sha256", "bytes", "id"))


def document_violations(manifests: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(manifest, artifact, rule) for frozen metadata among ``manifests``, whose stored ``documents`` are described.

    Rules: missing, integrity_mismatch (hash or byte count), and other_dataset (the document names another dataset
    than its source's contract, or none). A document may break the last two. One join finds all three.
    """
    frozen = manifests.where(F.col("operation") == FREEZE).select(
        "manifest", "artifact", F.col("source_slug").alias("source"),
        F.col("receipt.sha256").alias("expected_sha256"), F.col("receipt.bytes").alias("expected_bytes"),
    )
    joined = frozen.join(documents, "artifact", "left").join(sources.select("source", "dataset_id"), "source", "left")
    same = F.col("sha256").eqNullSafe(F.col("expected_sha256")) & F.col("bytes").eqNullSafe(F.col("expected_bytes"))
    own = F.coalesce(F.col("id") == F.col("dataset_id"), F.lit(False))
    rules = F.when(F.col("sha256").isNull(), F.array(F.lit("missing"))).otherwise(
        F.array_compact(F.array(F.when(~same, "integrity_mismatch"), F.when(~own, "other_dataset")))
    )
    return joined.select("manifest", "artifact", F.explode(rules).alias("rule"))


def frozen_metadata_violations(spark: SparkSession, manifests: DataFrame, root: str, sources: DataFrame) -> DataFrame:
    """``document_violations`` of the metadata documents stored below ``root``."""
    return document_violations(manifests, stored_documents(list_files(spark, root, "*.json"), root), sources)
