"""A keyed table kept current by a stream of inserts, updates, deletes and clears.

Bucketed copy-on-write. The table is hashed by key into buckets; their number
is doubled, with one rewriting of all, whenever the stored rows could be more
than ``rows_a_bucket`` each, so a bucket stays as large as it was meant to be.
A batch of changes is reduced to the latest change of each key, routed
to its bucket by the same hash, and merged with the stored rows of the touched
buckets only; those get replacement files under a new version folder, the
others keep theirs. A version exists once its manifest does, and manifests are
put in place by rename, so a reader sees all of a batch or nothing of it and a
lost executor or driver leaves the last version intact.

Changes need not come in order. Each stored row keeps the order (timestamp,
then arrival number) of the change that made it, deletes stay as tombstones and
every group's last clear is kept with its order, so late and repeated changes
give the same state whichever batch they come in.

Columns of a change: ``grp string, key string, kind string (put, del, clear),
ts double, seq bigint``; any further columns are the payload of the row.

Defined cases: changes with a null ``ts``, ``kind`` or (except for clears)
``key`` are ignored; a NaN ``ts`` counts as none; changes with equal group, key
and ``ts`` are one change, of which the smallest ``seq`` stays; a clear removes
what is not later than itself, so also a change of its own ``ts``; groups may be null and are
then one group; an empty batch commits nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simlode.sources import files

FIXED = ("grp", "key", "kind", "ts", "seq")
ROWS_A_BUCKET = 1 << 20


def _latest(payload: list[str]) -> Column:
    """The change that counts among several of one key: last by ts, then the first delivered."""
    return F.max_by(F.struct("kind", "ts", "seq", *payload), F.struct(F.col("ts"), -F.col("seq")))


class ChangeTable:
    """One table below ``path``; ``payload`` names the columns kept beside the key, ``buckets`` is their number at first."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, payload: T.StructType | None = None, rows_a_bucket: int = ROWS_A_BUCKET):
        self.spark, self.path, self.rows_a_bucket = spark, path.rstrip("/"), rows_a_bucket
        self.payload = payload or T.StructType([])
        if set(self.payload.names) & {*FIXED, "bucket"}:
            raise ValueError(f"payload columns may not be called {', '.join([*FIXED, 'bucket'])}")
        self.buckets = self.manifest()["buckets"] if self.version() else buckets

    @property
    def schema(self) -> T.StructType:
        fixed = [T.StructField("grp", T.StringType()), T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("ts", T.DoubleType()), T.StructField("seq", T.LongType())]
        return T.StructType([*fixed, *self.payload.fields])

    def version(self) -> int:
        """The newest committed version, 0 for none."""
        names = files.children(self.spark, f"{self.path}/manifests")
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        at = self.version() if version is None else version
        if not at:
            return {"version": 0, "buckets": self.buckets, "files": {}, "clears": None, "most": 0}
        return files.read_json(self.spark, f"{self.path}/manifests/{at:010d}.json")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("grp", "key"), F.lit(buckets)).cast("int")

    def _rows(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in places])

    def apply(self, changes: DataFrame) -> int:
        """Merge one batch and commit it; the version that then holds."""
        old = self.manifest()
        new = old["version"] + 1
        names = self.payload.names
        sound = changes.where(F.col("ts").isNotNull() & ~F.isnan("ts") & F.col("kind").isin("put", "del", "clear"))
        home = f"data/{new:010d}-{uuid.uuid4().hex}"  # a batch tried again does not meet its leavings

        # Clears: one row a group, combined on the map side.
        clears = sound.where("kind = 'clear'").select("grp", "ts", "seq")
        if old["clears"]:
            clears = clears.unionByName(self.spark.read.schema("grp string, ts double, seq bigint").parquet(f"{self.path}/{old['clears']}"))
        last = F.max_by(F.struct("ts", "seq"), F.struct(F.col("ts"), -F.col("seq")))
        clears.groupBy("grp").agg(last.alias("c")).select("grp", "c.ts", "c.seq").write.parquet(f"{self.path}/{home}/clears")

        # Latest change of each key, combined on the map side, then routed.
        wanted = sound.where("kind <> 'clear' AND key IS NOT NULL").select("grp", "key", "kind", "ts", "seq", *names)
        latest = wanted.groupBy("grp", "key").agg(_latest(names).alias("n")).select("grp", "key", "n.*")
        routed = f"{self.path}/{home}/routed"
        latest.write.parquet(routed)
        latest = self.spark.read.schema(self.schema).parquet(routed)
        most = old["most"] + latest.count()  # of the stored rows: keys that were there already count twice
        buckets = old["buckets"]
        while most > buckets * self.rows_a_bucket:
            buckets *= 2
        latest = latest.withColumn("bucket", self._bucket(buckets))
        if buckets != old["buckets"]:
            touched, places = list(range(buckets)), list(old["files"].values())
        else:
            touched = sorted(r.bucket for r in latest.select("bucket").distinct().collect())  # at most `buckets` numbers
            places = [old["files"][str(b)] for b in touched if str(b) in old["files"]]
        merged = latest
        if places:
            merged = self._merge(self._rows(places).withColumn("bucket", self._bucket(buckets)), latest)
        if touched:
            # A few buckets a task, each bucket in one sorted file.
            (merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "grp", "key")
             .write.partitionBy("bucket").parquet(f"{self.path}/{home}/rows"))
        files.delete(self.spark, routed)
        if buckets != old["buckets"]:  # some buckets may have no row; what is stored is known anew
            made = set(files.children(self.spark, f"{self.path}/{home}/rows"))
            kept = {str(b): f"{home}/rows/bucket={b}" for b in touched if f"bucket={b}" in made}
            most = self._rows(sorted(kept.values())).count()
        else:
            kept = {**old["files"], **{str(b): f"{home}/rows/bucket={b}" for b in touched}}
        files.commit_json(self.spark, f"{self.path}/manifests/{new:010d}.json", {"version": new, "buckets": buckets, "files": kept, "clears": f"{home}/clears", "most": most})
        self.buckets = buckets
        return new

    def _merge(self, base: DataFrame, latest: DataFrame) -> DataFrame:
        """Sort-merge of stored rows with the latest changes of the same buckets."""
        names = ["kind", "ts", "seq", *self.payload.names]
        b = base.select("bucket", "grp", "key", F.struct(*names).alias("b"))
        n = latest.select("bucket", "grp", "key", F.struct(*names).alias("n")).hint("merge")
        on = (b.bucket == n.bucket) & b.grp.eqNullSafe(n.grp) & (b.key == n.key)
        newer = F.col("b").isNull() | F.col("n.ts").__gt__(F.col("b.ts")) | ((F.col("n.ts") == F.col("b.ts")) & (F.col("n.seq") < F.col("b.seq")))
        win = F.when(F.col("n").isNotNull() & newer, F.col("n")).otherwise(F.col("b"))
        both = b.join(n, on, "full_outer")
        return both.select(F.coalesce(b.grp, n.grp).alias("grp"), F.coalesce(b.key, n.key).alias("key"), win.alias("w"), F.coalesce(b.bucket, n.bucket).alias("bucket")).select("grp", "key", "w.*", "bucket")

    def rows(self, version: int | None = None) -> DataFrame:
        """The current rows: ``grp, key, seq, ts`` and the payload."""
        m = self.manifest(version)
        stored = self._rows(sorted(m["files"].values())).where("kind = 'put'")
        if m["clears"]:
            clears = self.spark.read.schema("grp string, ts double, seq bigint").parquet(f"{self.path}/{m['clears']}").toDF("cgrp", "cts", "cseq")
            gone = F.col("cts") >= F.col("ts")
            stored = stored.join(clears, F.col("grp").eqNullSafe(F.col("cgrp")) & gone, "left_anti")
        return stored.select("grp", "key", "seq", "ts", *self.payload.names)

    def since(self, version_ts: float) -> tuple[bool, DataFrame]:
        """Whether a clear came after a time, and ``grp, key, kind, ts`` and the payload of what changed after it, deletes included."""
        m = self.manifest()
        changed = self._rows(sorted(m["files"].values())).where(F.col("ts") > version_ts).select("grp", "key", "kind", "ts", *self.payload.names)
        if not m["clears"]:
            return False, changed
        clears = self.spark.read.schema("grp string, ts double, seq bigint").parquet(f"{self.path}/{m['clears']}")
        return bool(clears.where(F.col("ts") > version_ts).limit(1).collect()), changed

    def vacuum(self, keep: int = 1) -> None:
        """Drop manifests but the newest ``keep`` and the bucket folders none of those names."""
        versions = sorted(int(n.removesuffix(".json")) for n in files.children(self.spark, f"{self.path}/manifests") if n.endswith(".json"))
        kept = versions[-keep:]
        used = {p for v in kept for m in [self.manifest(v)] for p in [*m["files"].values(), m["clears"]]}
        for v in versions[:-keep]:
            files.delete(self.spark, f"{self.path}/manifests/{v:010d}.json")
        for home in files.children(self.spark, f"{self.path}/data"):
            if int(home.split("-")[0]) > kept[-1]:
                continue  # a batch that is being written
            for b in files.children(self.spark, f"{self.path}/data/{home}/rows"):
                if b.startswith("bucket=") and f"data/{home}/rows/{b}" not in used:
                    files.delete(self.spark, f"{self.path}/data/{home}/rows/{b}")
