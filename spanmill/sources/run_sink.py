"""A sink for runs that is all or nothing, and takes a run once.

df.write.format("spanmill_run").option("path", ...).option("run_id", ...).mode("append").save(): every task writes Parquet files of its own
name; the commit names the files of the successful tasks in one manifest, which appears by a rename. Readers see what manifests name:
neither a failed job's files nor those of a repeated task. A run id that has a manifest stays as it is; mode("overwrite") puts a new manifest in its place.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "run_id string, run_type string, prompt_version string, files array<struct<path:string,rows:long>>"


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: list


class RunWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.run_id, self.overwrite = options["path"].rstrip("/"), options["run_id"], overwrite
        self.kind, self.version = options.get("run_type", "main"), options.get("prompt_version", "v1")
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.run_id):
            raise ValueError("a run_id has letters, digits, '_', '.' and '-'")
        self.attempt = uuid.uuid4().hex  # of the job: tasks add their own

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = place(self.path)
        name, writer, rows = f"files/{self.run_id}-{self.attempt}/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if writer is None:
                    fs.create_dir(f"{base}/files/{self.run_id}-{self.attempt}", recursive=True)
                    writer = pa.parquet.ParquetWriter(fs.open_output_stream(f"{base}/{name}"), batch.schema, compression="zstd")
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written([(name, rows)] if writer is not None else [])

    def commit(self, messages: list) -> None:
        fs, base = place(self.path)
        target = f"{base}/runs/{self.run_id}.json"
        there = fs.get_file_info(target).type != pyarrow.fs.FileType.NotFound
        if there and not self.overwrite:
            self._drop(fs, base)
            return
        files = [{"path": p, "rows": n} for m in messages if m is not None for p, n in m.files]
        fs.create_dir(f"{base}/runs", recursive=True)
        fs.create_dir(f"{base}/staged", recursive=True)
        with fs.open_output_stream(staged := f"{base}/staged/{self.attempt}.json") as f:
            f.write(json.dumps({"run_id": self.run_id, "run_type": self.kind, "prompt_version": self.version, "files": files}).encode())
        fs.move(staged, target)

    def abort(self, messages: list) -> None:
        self._drop(*place(self.path))

    def _drop(self, fs: pyarrow.fs.FileSystem, base: str) -> None:
        own = f"{base}/files/{self.run_id}-{self.attempt}"
        if fs.get_file_info(own).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(own)


class RunSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spanmill_run"

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        return RunWriter(self.options, overwrite)


def write_once(records: DataFrame, path: str, run_id: str, run_type: str = "main", version: str = "v1", overwrite: bool = False) -> None:
    """records as a run: a second call with the same id changes nothing, unless it overwrites, and writes nothing either."""
    fs, base = place(path.rstrip("/"))
    if not overwrite and fs.get_file_info(f"{base}/runs/{run_id}.json").type != pyarrow.fs.FileType.NotFound:
        return
    records.sparkSession.dataSource.register(RunSink)
    out = records.write.format("spanmill_run").option("path", path).option("run_id", run_id).option("run_type", run_type).option("prompt_version", version)
    out.mode("overwrite" if overwrite else "append").save()


def vacuum(spark: SparkSession, path: str, older_than: float = 86400.0) -> int:
    """Deletes what no manifest names and has not changed for so many seconds: files of replaced runs, and of tasks that ended after
    their job was given up. Returns how many folders went."""
    import time

    fs, base = place(path.rstrip("/"))
    named = {f["path"].split("/")[1] for r in manifests(spark, path).select("files").collect() for f in r["files"]}
    gone = 0
    for d in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/files", allow_not_found=True)):
        own = [x.mtime_ns or 0 for x in fs.get_file_info(pyarrow.fs.FileSelector(d.path))]
        if d.base_name not in named and max([d.mtime_ns or 0, *own]) / 1e9 <= time.time() - older_than:
            fs.delete_dir(d.path)
            gone += 1
    return gone


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each committed run."""
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/runs")


def read_runs(spark: SparkSession, path: str, schema: str, *run_ids: str) -> DataFrame:
    """The rows of committed runs (all, or those named) with their run_id, run_type and prompt_version."""
    known = manifests(spark, path)
    known = known.filter(F.col("run_id").isin(*run_ids)) if run_ids else known
    files = known.select("run_id", "run_type", "prompt_version", F.explode("files").alias("f")).collect()  # names of files
    if not files:
        return spark.createDataFrame([], schema + ", run_id string, run_type string, prompt_version string")
    base = path.rstrip("/")
    rows = spark.read.schema(schema).parquet(*[f"{base}/{r['f']['path']}" for r in files]).withColumn("__file", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
    dirs = {(r["f"]["path"].split("/")[1], r["run_id"], r["run_type"], r["prompt_version"]) for r in files}
    told = spark.createDataFrame(sorted(dirs), "__dir string, run_id string, run_type string, prompt_version string")
    return rows.join(told, F.col("__file") == F.col("__dir")).drop("__file", "__dir")
