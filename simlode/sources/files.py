"""Small driver-side files (manifests) on whatever file system Spark uses."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have ``path``, which need not exist yet, deleted when the driver's JVM ends."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)  # only what exists can be marked
    fs.deleteOnExit(p)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries below ``path``; empty if it does not exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_bytes(spark, path).decode("utf-8"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def commit_json(spark: SparkSession, path: str, value: Any) -> None:
    """Write ``value`` beside ``path`` and rename it there.

    The rename fails if ``path`` exists, so of two writers of one version
    exactly one commits.
    """
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(tmp, p):
        fs.delete(tmp, False)
        raise FileExistsError(path)
