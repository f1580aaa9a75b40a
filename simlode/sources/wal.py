"""JSON-line mutation logs: append, read, quarantine, snapshot and truncate.

Lines are ``{"op", "id", "vector", "metadata", "timestamp"}``. Our own logs also
carry ``seq`` in the data, so reading them is an ordinary distributed scan. A
foreign log has only the order of its lines; its files are read in splits, and
lines are numbered within their file by the splits before theirs and their place
in their own (``seq`` = line number within the file, blank lines included).

Defined cases: blank lines are skipped; what is not a JSON object with a string
``op``, or an insert without id or vector, or a delete without id, is
quarantined with its text instead of ending the read; unknown operations are
kept, as replay ignores them; a missing log is empty; a snapshot that cannot be
read raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simlode.operators.mutation_log import replay
from simlode.sources import dataset, files

LINE = T.StructType([T.StructField("op", T.StringType()), T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType()), T.StructField("timestamp", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("_bad", T.StringType())])


def parse(lines: DataFrame, text: str = "value") -> DataFrame:
    """The other columns and ``op, id, vector, metadata, timestamp, seq, bad`` (the text, if it is no sound line)."""
    keep = [c for c in lines.columns if c != text]
    p = F.from_json(F.col(text), LINE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.where(F.trim(F.col(text)) != "").select(*keep, F.col(text).alias("_text"), p.alias("p"))
    sound = F.col("p._bad").isNull() & F.col("p.op").isNotNull() & F.trim(F.col("_text")).startswith("{")
    sound = sound & ~((F.col("p.op") == "insert") & (F.col("p.id").isNull() | F.col("p.vector").isNull())) & ~((F.col("p.op") == "delete") & F.col("p.id").isNull())
    fields = [F.col(f"p.{c}").alias(c) for c in ("op", "id", "vector", "metadata", "timestamp", "seq")]
    return rows.select(*keep, *fields, F.when(~F.coalesce(sound, F.lit(False)), F.col("_text")).alias("bad"))


def read_foreign(spark: SparkSession, path: str) -> DataFrame:
    """A log without ``seq``: lines numbered within their file, as ``source, seq`` and the fields."""
    # Lines in the order of their splits: the id grows with the place in a split, whose number is in its upper bits.
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value")
    # One row a split travels; splits of a file are few, so their sums are one short window a file.
    splits = lines.groupBy("source", "start").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = lines.join(splits, ["source", "start"]).withColumn("line", F.col("earlier") + F.col("place") - F.col("first") + 1)
    return parse(numbered.select("source", "line", "value")).drop("seq").withColumn("seq", F.col("line").cast("long")).drop("line")


def append(lines: DataFrame, path: str) -> None:
    """Add lines, each with its ``seq``, to a log folder."""
    lines.select(F.to_json(F.struct(*[c for c in ("op", "id", "vector", "metadata", "timestamp", "seq") if c in lines.columns])).alias("value")).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log folder written by :func:`append`."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "op string, id string, vector array<float>, metadata string, timestamp double, seq long, bad string")
    return parse(spark.read.text(path))


class DurableCollection:
    """A snapshot and a log below one folder.

    ``rotate`` writes the state as a new snapshot version whose manifest names
    the last ``seq`` it holds; the log is cut only after that, and replay skips
    lines up to that ``seq``, so dying at any point loses and repeats nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _through(self) -> int:
        if not dataset.newest(self.spark, f"{self.path}/snapshot"):
            return 0
        return dataset.manifest(self.spark, f"{self.path}/snapshot")["extra"]["through"]

    def last_seq(self) -> int:
        seen = read(self.spark, f"{self.path}/log").agg(F.max("seq")).first()[0]
        return max(seen or 0, self._through())

    def append(self, lines: DataFrame) -> None:
        append(lines, f"{self.path}/log")

    def _segments(self) -> list[str]:
        return [f"{self.path}/log/{n}" for n in files.children(self.spark, f"{self.path}/log") if not n.startswith(("_", "."))]

    def _lines(self, segments: list[str]) -> DataFrame:
        if not segments:
            return read(self.spark, f"{self.path}/none")
        return parse(self.spark.read.text(segments))

    def state(self, segments: list[str] | None = None) -> DataFrame:
        """The rows stored; of the whole log, or of some of its files."""
        log = self._lines(self._segments() if segments is None else segments).where("bad IS NULL")
        if not dataset.newest(self.spark, f"{self.path}/snapshot"):
            return replay(log, payload=["metadata"])
        snapshot = dataset.load(self.spark, f"{self.path}/snapshot")
        return replay(log.where(F.col("seq") > self._through()), snapshot, payload=["metadata"])

    def rotate(self) -> int:
        """Snapshot the state and cut the log; the snapshot's version.

        Only the files that went into the snapshot are cut, so lines appended
        meanwhile stay.
        """
        segments = self._segments()
        through = max(self._lines(segments).agg(F.max("seq")).first()[0] or 0, self._through())
        version = dataset.save(self.state(segments).select("id", "vector", "metadata"), f"{self.path}/snapshot", "snapshot", extra={"through": through})
        for s in segments:
            files.delete(self.spark, s)
        return version
