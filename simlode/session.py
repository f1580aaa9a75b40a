"""Session helpers: building a session, the shared folder, and loading tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from simlode.sources import files


def build_session(master: str = "local[*]", app: str = "simlode", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow), whose executors have the package."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the cluster names none (tests, a laptop) a local folder is made once
    and set on the context, which is right only because driver and executors
    are then one machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named is None and current is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="simlode-")
    if current is None:
        context.setCheckpointDir(named)
    return (named or current).rstrip("/")


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    files.delete_at_end(spark, path)
    return path


def settle(df: DataFrame, purpose: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends in replicated storage, so a lost executor repeats only
    what reads the result. The files live as long as the driver, unless the
    caller gave a ``work_path`` and deletes it.
    """
    path = path or work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What queries made and run within it shuffle is deleted when each ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that their Python finds it wherever it runs."""
    context = spark.sparkContext
    if getattr(context, "_simlode_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    # The driver serves this file as long as it lives.
    tmp = tempfile.mkdtemp(prefix="simlode-package-")
    atexit.register(shutil.rmtree, tmp, True)
    with zipfile.ZipFile(f"{tmp}/simlode_package.zip", "w") as z:
        for folder, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("simlode", os.path.relpath(full, home)))
    context.addPyFile(f"{tmp}/simlode_package.zip")
    context._simlode_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over at least as many tasks as there are cores.

    For work in Python that is large against the bytes it reads. A scan that
    has the tasks already, as any large one does, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    if files.is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
