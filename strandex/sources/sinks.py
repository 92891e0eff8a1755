"""Sinks: single files that appear whole, partitioned results, and the run manifest."""

from __future__ import annotations

import json
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and renames over it, so that a reader sees the old file or the new one."""
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, part = _file(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(content))
    out.close()
    _replace(spark, f"{path}.part", path)


def _replace(spark: SparkSession, part: str, path: str) -> None:
    """An atomic rename where the file system has one that overwrites."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI.create(jvm.org.apache.hadoop.fs.Path(path).toString()), spark._jsc.hadoopConfiguration()) if "://" in path or path.startswith("file:") else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path), options)


def write_file(df: DataFrame, path: str, order: str) -> None:
    """One tab-separated file with a header, in the order of a column, that appears whole. For merged
    results, a row per gene and setting: the sort is distributed, its parts go through one task in turn."""
    spark, folder = df.sparkSession, f"{path}.parts"
    fs, parts = _file(spark, folder)
    df.orderBy(order).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(folder)
    written = [s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")]
    if not written:
        raise OSError(f"nothing was written to {folder}")
    _replace(spark, written[0].toString(), path)
    fs.delete(parts, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for the files of one call, in the cluster's shared folder (spark.checkpoint.dir); in local mode without one, our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_manifest(spark: SparkSession, path: str, settings: dict) -> None:
    """Written once; a later run with other settings is refused, naming what changed."""
    text = read_text(spark, path)
    if text is None:
        return write_text(spark, path, json.dumps(settings, sort_keys=True, indent=1))
    old = json.loads(text)
    new = json.loads(json.dumps(settings))
    if changed := sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k)):
        raise ValueError(f"the folder belongs to a run with other settings: {changed}")


def file_name(key: str) -> str:
    """A key as a file name."""
    return quote(key, safe="")


def write_results(df: DataFrame, path: str, by: str = "gene_id", overwrite: bool = False) -> None:
    """Parquet partitioned by a key. ``overwrite`` replaces only the partitions that are written."""
    rows = df.repartition(by).write.partitionBy(by)
    if overwrite:
        rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        rows.mode("append").parquet(path)


def write_tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """A folder of tab-separated parts with a header, ordered by a column over the parts."""
    (df.orderBy(order) if order else df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
