"""Saved collections, indexes and codebooks: versioned Parquet with a manifest and checksums.

A save writes a new version folder and then its manifest, by rename; a reader
takes the newest manifest. A save that dies leaves the last version as it was.
Loading verifies schema version, dimension, row count and a checksum of the
content, and raises ``ValueError`` for whatever differs.

The checksum is the exclusive-or of the rows' SHA-256 digests together with the
count, so it does not depend on the order or the number of files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from simlode.sources import files

SCHEMA_VERSION = "1.0.0"


def _named(df: DataFrame, m: dict) -> tuple[DataFrame, dict]:
    """Version 0: columns ``key, embedding`` and no metadata, as the collection's are not yet named."""
    names = {"key": "id", "embedding": "vector"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    if m["kind"] == "collection" and "metadata" not in df.columns:
        df = df.withColumn("metadata", F.lit("{}"))
    return df, {**m, "vector": names.get(m["vector"], m["vector"])}


#: What :func:`migrate` does to the rows and manifest of an older schema version; it gives those of the next.
MIGRATIONS = {"0.9.0": ("1.0.0", _named)}


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Row count and checksum."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.bit_xor(F.conv(F.substring("d", 1 + 16 * i, 16), 16, -10).cast("long")) for i in range(4)]
    n, *x = df.select(digest.alias("d")).agg(F.count(F.lit(1)), *parts).first()
    return n, "".join(f"{(y or 0) & (2**64 - 1):016x}" for y in x)


def newest(spark: SparkSession, path: str) -> int:
    return max((int(n.removesuffix(".json")) for n in files.children(spark, f"{path}/manifests") if n.endswith(".json")), default=0)


def save(df: DataFrame, path: str, kind: str = "collection", vector_col: str | None = "vector", partition_by: str | None = None, extra: dict | None = None) -> int:
    """Write a version; its number. ``partition_by`` lays out cells for pruning."""
    spark = df.sparkSession
    version = newest(spark, path) + 1
    place = f"data/{version:010d}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{place}")
    back = spark.read.schema(df.schema).parquet(f"{path}/{place}").select(*df.columns)
    count, checksum = fingerprint(back)
    sizes = [None, None] if vector_col is None else list(back.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first())
    if sizes[0] != sizes[1]:
        raise ValueError("vectors of several dimensions")
    files.commit_json(spark, f"{path}/manifests/{version:010d}.json", {"schema_version": SCHEMA_VERSION, "kind": kind, "version": version, "place": place, "rows": count, "checksum": checksum, "dimension": sizes[0], "vector": vector_col, "columns": df.schema.jsonValue(), "partition_by": partition_by, "extra": extra or {}})
    return version


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    at = version or newest(spark, path)
    if not at:
        raise ValueError(f"nothing saved below {path}")
    return files.read_json(spark, f"{path}/manifests/{at:010d}.json")


def load(spark: SparkSession, path: str, version: int | None = None, kind: str | None = None, verify: bool = True) -> DataFrame:
    """The rows of a version, the newest unless given."""
    m = manifest(spark, path, version)
    if m.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"schema version {m.get('schema_version')}, not {SCHEMA_VERSION}")
    if kind and m["kind"] != kind:
        raise ValueError(f"a {m['kind']}, not a {kind}")
    return _read(spark, path, m, verify)


def _read(spark: SparkSession, path: str, m: dict, verify: bool) -> DataFrame:
    schema = StructType.fromJson(m["columns"])
    df = spark.read.schema(schema).parquet(f"{path}/{m['place']}").select(*schema.names)
    if verify:
        try:
            count, checksum = fingerprint(df)
            wrong = df.where(F.size(m["vector"]) != m["dimension"]).limit(1).count() if m["vector"] and m["dimension"] is not None else 0
        except Exception as e:
            raise ValueError(f"unreadable: {e}") from e
        if count != m["rows"] or checksum != m["checksum"] or wrong:
            raise ValueError("content does not match its manifest")
    return df


def migrate(spark: SparkSession, path: str) -> int:
    """Write the newest version anew, if it is of an older schema version, step by step to the current one; rows are checked first."""
    m = manifest(spark, path)
    if m["schema_version"] == SCHEMA_VERSION:
        return m["version"]
    if m["schema_version"] not in MIGRATIONS:
        raise ValueError(f"no migration from schema version {m['schema_version']}")
    df, at = _read(spark, path, m, True), m["schema_version"]
    while at != SCHEMA_VERSION:
        at, step = MIGRATIONS[at]
        df, m = step(df, m)
    return save(df, path, m["kind"], m["vector"], m["partition_by"], m["extra"])
