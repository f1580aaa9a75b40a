"""Has this key been seen before? Partitioned cuckoo tables of short fingerprints.

Keys are hashed to 64 bits on the JVM; only hashes and record numbers travel.
They are partitioned by hash, and each partition keeps a chain of cuckoo tables
of 16-bit fingerprints, four to a bucket, with two candidate buckets a key:
about 2.2 bytes a key instead of the key. When a table saturates, one of twice
the size is linked behind it. Records are answered in order of arrival, and each
new key is inserted once answered.

:class:`KeyTables` keeps the tables in files, a folder a partition, under
manifests that are put in place by rename. A batch reads and replaces the
tables of the partitions its keys fall into and no key of any batch before it.

Wrong answers can only be false positives, as a fingerprint may belong to
another key. ``confirmed`` checks exactly the records that the tables take for
seen, and ``audit`` reports the rate of wrong answers among them and overall.
Keys wrongly taken for seen have not been inserted; :meth:`KeyTables.absorb`
does it, so that each key has a fingerprint of its own and may be removed.

Removing: a key is in one table of its chain. If one table matches, a copy of
the fingerprint is taken out there, and others that share it keep theirs. If
several match, taking one out might lose another key; then the removed key's
hash is noted beside the tables (a rare case) and the tables stay.

A key repeated very often would send all its rows to one partition. So each
Arrow batch first answers repeats within itself (any row but the key's first in
that batch has certainly been seen) and sends on one row a key.

Defined cases: null and empty keys are answered "not seen" and stored nowhere;
record numbers must be unique and ordered by arrival, null ones take no part;
equal keys compare byte for byte; an empty store or an empty stream is allowed;
other columns of either table are not read, whatever their names; a key to be
removed that no table matches is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlode.session import settle, work_path
from simlode.sources import files

#: Rows a partition is meant to hold; more rows mean more partitions.
ROWS_A_PARTITION = 1 << 20
SLOTS, KICKS, LOAD = 4, 500, 0.94


class CuckooTable:
    """One table of ``2**bits`` buckets; keys are (bucket bits, fingerprint)."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.slots = np.zeros((1 << bits, SLOTS), np.uint16)
        self.count = 0
        self._turn = 0

    def other(self, bucket, fingerprint):
        """The second candidate bucket; applied twice it gives the first again."""
        return (bucket ^ (fingerprint * 0x5BD1E995)) & self.mask

    def contains(self, bucket: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        b = bucket & self.mask
        f = fingerprint[:, None]
        return (self.slots[b] == f).any(1) | (self.slots[self.other(b, fingerprint.astype(np.int64))] == f).any(1)

    def add(self, bucket: int, fingerprint: int) -> bool:
        """False if it is full; then nothing is changed."""
        b = bucket & self.mask
        moved = []
        for at in (b, self.other(b, fingerprint)):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = fingerprint
                self.count += 1
                return True
        for _ in range(KICKS):
            self._turn = (self._turn * 5 + 1) & 0xFFFF
            slot = self._turn >> 4 & (SLOTS - 1)
            old = int(self.slots[b, slot])
            moved.append((b, slot, old))
            self.slots[b, slot] = fingerprint
            fingerprint, b = old, self.other(b, old)
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = fingerprint
                self.count += 1
                return True
        for at, slot, old in reversed(moved):
            self.slots[at, slot] = old
        return False

    def add_many(self, bucket: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        """Adds what fits; which ones did. Most go in at once, the rest one by one."""
        done = np.zeros(len(bucket), bool)
        b = bucket & self.mask
        for side in (b, self.other(b, fingerprint.astype(np.int64))):
            for slot in range(SLOTS):
                left = np.flatnonzero(~done & (self.slots[side, slot] == 0))
                # Of those that want one slot, the first gets it.
                _, first = np.unique(side[left], return_index=True)
                take = left[first]
                self.slots[side[take], slot] = fingerprint[take]
                done[take] = True
        self.count += int(done.sum())
        full = False
        for i in np.flatnonzero(~done).tolist():
            if full or self.count >= LOAD * self.slots.size:
                break
            done[i] = self.add(int(bucket[i]), int(fingerprint[i]))
            full = not done[i]
        return done

    def remove(self, bucket: int, fingerprint: int) -> bool:
        b = bucket & self.mask
        for at in (b, self.other(b, fingerprint)):
            held = np.flatnonzero(self.slots[at] == fingerprint)
            if len(held):
                self.slots[at, held[0]] = 0
                self.count -= 1
                return True
        return False


class CuckooFilter:
    """A chain of tables that grows by linking one of twice the size.

    Hashes are int64. ``remove`` may only be called for keys that were added.
    """

    def __init__(self, expected: int = 1024):
        buckets = max(64, int(expected / (SLOTS * 0.9)))
        self.tables = [CuckooTable(max(6, (buckets - 1).bit_length()))]
        self.dropped = np.empty(0, np.int64)  # removed keys whose fingerprint could not be told from another's, sorted

    @staticmethod
    def parts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.asarray(hashes, np.int64).view(np.uint64)
        fingerprint = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return (h & np.uint64(0xFFFFFFFFFF)).astype(np.int64), fingerprint

    @property
    def bytes(self) -> int:
        return sum(t.slots.nbytes for t in self.tables) + self.dropped.nbytes

    def __len__(self) -> int:
        return sum(t.count for t in self.tables) - len(self.dropped)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        bucket, fingerprint = self.parts(hashes)
        found = np.zeros(len(bucket), bool)
        for t in self.tables:
            found |= t.contains(bucket, fingerprint)
        return found & ~np.isin(hashes, self.dropped) if len(self.dropped) else found

    def add(self, hashes: np.ndarray) -> None:
        """Adds distinct keys that have not been added before; each gets a fingerprint of its own."""
        if len(self.dropped):  # theirs still stand
            back = np.isin(hashes, self.dropped)
            self.dropped = np.setdiff1d(self.dropped, hashes[back])
            hashes = hashes[~back]
        bucket, fingerprint = self.parts(hashes)
        while len(bucket):
            t = self.tables[-1]
            room = max(0, int(LOAD * t.slots.size) - t.count)
            done = np.zeros(len(bucket), bool)
            done[:room] = t.add_many(bucket[:room], fingerprint[:room])
            bucket, fingerprint = bucket[~done], fingerprint[~done]
            if len(bucket):
                self.tables.append(CuckooTable(t.bits + 1))

    def remove(self, key_hash: int) -> bool:
        h = np.array([key_hash], np.int64)
        if not self.contains(h)[0]:
            return False
        bucket, fingerprint = self.parts(h)
        held = [t for t in self.tables if t.contains(bucket, fingerprint)[0]]
        if len(held) == 1:
            return held[0].remove(int(bucket[0]), int(fingerprint[0]))
        self.dropped = np.union1d(self.dropped, h)
        return True

    def packed(self) -> list[tuple[int, bytes]]:
        """Bits and slots of each table in turn, then -1 and the hashes noted as removed."""
        return [*((t.bits, t.slots.tobytes()) for t in self.tables), (-1, self.dropped.tobytes())]

    @classmethod
    def unpacked(cls, rows: list[tuple[int, bytes]]) -> CuckooFilter:
        out = cls.__new__(cls)
        out.tables, out.dropped = [], np.empty(0, np.int64)
        for bits, slots in rows:
            if bits < 0:
                out.dropped = np.frombuffer(slots, np.int64).copy()
                continue
            t = CuckooTable(0)
            t.bits, t.mask = bits, (1 << bits) - 1
            t.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
            t.count = int(np.count_nonzero(t.slots))
            out.tables.append(t)
        return out


def answer_part(hashes: np.ndarray, numbers: np.ndarray, cuckoo: CuckooFilter, step: int = 8192) -> np.ndarray:
    """Whether each record, in order of its number, finds its key; new keys are added."""
    order = np.argsort(numbers, kind="stable")
    seen = np.zeros(len(order), bool)
    for at in range(0, len(order), step):
        rows = order[at : at + step]
        h = hashes[rows]
        known = cuckoo.contains(h)
        # Within the step, a key's first record stores it; those behind it find it.
        _, first = np.unique(h, return_index=True)
        new = np.zeros(len(rows), bool)
        new[first] = True
        seen[rows] = known | ~new
        cuckoo.add(h[new & ~known])
    return seen


def _key(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


REMOVE, ADD, ASK = 1, 2, 3
_ROUTED = "part int, kind int, n long, h long"


class KeyTables:
    """The tables of all partitions below ``path``.

    ``expected`` keys in all set the number of partitions when the store is
    made; later batches may bring more, the chains grow then.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = ROWS_A_PARTITION, parts: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        m = self.manifest()
        self.parts = m["parts"] or parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // ROWS_A_PARTITION))
        self.expected = m["expected"] or max(1, expected // self.parts)

    def manifest(self) -> dict:
        names = [n for n in files.children(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        return files.read_json(self.spark, f"{self.path}/manifests/{names[-1]}") if names else {"version": 0, "parts": 0, "expected": 0, "files": {}}

    def _routed(self, df: DataFrame, column: str, kind: int, number: Column) -> DataFrame:
        """One row a key and Arrow batch, and the repeats there, with the partition of each."""

        def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                order = pdf.sort_values("n", kind="stable")
                again = order["h"].duplicated().to_numpy()
                if kind == ASK:
                    yield order.assign(part=np.where(again, -1, order["part"]))
                else:
                    yield order[~again]

        hashed = df.select(_key(column).alias("k"), number.cast("long").alias("n")).where("k IS NOT NULL AND k <> '' AND n IS NOT NULL").select(F.xxhash64("k").alias("h"), "n")
        return hashed.select(F.pmod(F.xxhash64("h"), F.lit(self.parts)).cast("int").alias("part"), F.lit(kind).alias("kind"), "n", "h").mapInPandas(once, _ROUTED)

    def seen(self, records: DataFrame, number: str, key: str, first: DataFrame | None = None, first_key: str | None = None) -> DataFrame:
        """``n``: the numbers of the records that the tables take for seen; their new keys are inserted.

        Keys of ``first`` are inserted before the records are answered.
        """
        routed = self._routed(records, key, ASK, F.col(f"`{number}`"))
        if first is not None:
            routed = self._routed(first, first_key or key, ADD, F.lit(0)).unionByName(routed)
        return self._commit(routed)

    def add(self, keys: DataFrame, key: str) -> None:
        """Insert keys that are not in the tables yet; one that is repeated in ``keys`` counts once."""
        self._commit(self._routed(keys, key, ADD, F.lit(0)))

    def absorb(self, records: DataFrame, number: str, key: str, checked: DataFrame) -> None:
        """Insert the keys of the records that :func:`confirmed` found wrongly taken for seen."""
        wrong = checked.where("NOT right").select(F.col("n").alias("_n"))
        self.add(records.join(wrong, records[number].cast("long") == wrong["_n"], "left_semi").select(_key(key).alias("k")), "k")

    def remove(self, keys: DataFrame, key: str) -> None:
        """Remove keys that have been inserted; one that is repeated in ``keys`` counts once."""
        self._commit(self._routed(keys, key, REMOVE, F.lit(0)))

    def vacuum(self) -> None:
        """Drop all manifests but the newest and what that does not name; answers given before can no longer be read."""
        names = [n for n in files.children(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        kept = {*self.manifest()["files"].values()}
        for n in names[:-1]:
            files.delete(self.spark, f"{self.path}/manifests/{n}")
        for home in files.children(self.spark, f"{self.path}/data"):
            if int(home.split("-")[0]) > int(names[-1].removesuffix(".json")):
                continue  # a batch that is being written
            for part in files.children(self.spark, f"{self.path}/data/{home}"):
                if f"data/{home}/{part}" not in kept:
                    files.delete(self.spark, f"{self.path}/data/{home}/{part}")

    def _commit(self, routed: DataFrame) -> DataFrame:
        spark, old, expected = self.spark, self.manifest(), self.expected
        routed = settle(routed, "keys")
        touched = sorted(r.part for r in routed.where("part >= 0").select("part").distinct().collect())  # at most ``parts`` numbers
        work = routed.where("part >= 0").withColumn("bits", F.lit(None).cast("int")).withColumn("slots", F.lit(None).cast("binary"))
        places = [f"{self.path}/{old['files'][str(p)]}" for p in touched if str(p) in old["files"]]
        if places:
            tables = spark.read.schema("own int, turn long, bits int, slots binary").parquet(*places)
            work = work.unionByName(tables.select(F.col("own").alias("part"), F.lit(0).alias("kind"), F.col("turn").alias("n"), F.lit(0).cast("long").alias("h"), "bits", "slots"))
        # A partition is streamed: its tables, its keys to insert first and one batch are all that is in memory.
        lined = work.repartition(max(1, len(touched)), "part").sortWithinPartitions("part", "kind", "n")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, cuckoo, stored, wait, kept = None, None, [], [], 0

            def ready() -> None:
                """Before the first record, and at the end: what is to be removed and inserted."""
                nonlocal cuckoo, wait
                if cuckoo is None:
                    cuckoo = CuckooFilter.unpacked(stored) if stored else CuckooFilter(expected)
                for kind in (REMOVE, ADD):
                    some = [h for k, h in wait if k == kind]
                    keys = np.unique(np.concatenate(some)) if some else np.empty(0, np.int64)
                    if kind == ADD:
                        cuckoo.add(keys)
                    for h in keys.tolist() if kind == REMOVE else ():
                        cuckoo.remove(h)
                wait = []

            def done() -> pd.DataFrame:
                ready()
                rows = cuckoo.packed()
                return pd.DataFrame({"part": part, "own": part, "turn": range(len(rows)), "bits": [b for b, _ in rows], "slots": [s for _, s in rows], "n": None})

            for batch in batches:
                for p, pdf in batch.groupby("part", sort=True):
                    if p != part:
                        if part is not None:
                            yield done()
                        part, cuckoo, stored, wait = int(p), None, [], []
                    kind = pdf["kind"].to_numpy()
                    stored += [(int(b), bytes(s)) for b, s in zip(pdf["bits"][kind == 0], pdf["slots"][kind == 0])]
                    for k in (REMOVE, ADD):
                        if (kind == k).any():
                            wait.append((k, pdf["h"][kind == k].to_numpy(np.int64)))
                    if (kind == ASK).any():
                        ready()
                        h, n = (pdf[c][kind == ASK].to_numpy(np.int64) for c in ("h", "n"))
                        found = n[answer_part(h, n, cuckoo)]
                        yield pd.DataFrame({"part": -1, "own": -1, "turn": None, "bits": None, "slots": None, "n": found})
            if part is not None:
                yield done()

        home = f"data/{old['version'] + 1:010d}-{uuid.uuid4().hex}"  # a batch tried again does not meet its leavings
        lined.mapInPandas(run, "part int, own int, turn long, bits int, slots binary, n long").write.partitionBy("part").parquet(f"{self.path}/{home}")
        made = {str(p): f"{home}/part={p}" for p in touched}
        files.commit_json(spark, f"{self.path}/manifests/{old['version'] + 1:010d}.json", {"version": old["version"] + 1, "parts": self.parts, "expected": self.expected, "files": {**old["files"], **made}})
        again = routed.where("part < 0").select("n")
        answered = f"{self.path}/{home}/part=-1"
        return spark.read.schema("n long").parquet(answered).unionByName(again) if files.exists(spark, answered) else again


def seen_before(records: DataFrame, stored: DataFrame, number: str, key: str, stored_key: str | None = None, parts: int | None = None) -> DataFrame:
    """``n``: the numbers of the records that the tables take for seen, with tables made for this from ``stored``."""
    spark = records.sparkSession
    rows = records.count() + stored.count()  # of Parquet, from the footers
    return KeyTables(spark, work_path(spark, "tables"), rows, parts).seen(records, number, key, stored, stored_key or key)


def confirmed(records: DataFrame, stored: DataFrame, flagged: DataFrame, number: str, key: str, stored_key: str | None = None) -> DataFrame:
    """``n, right``: each flagged record, and whether its key really occurred before.

    Keys are first held against the 64-bit hashes of the flagged ones and only
    those that agree are compared as text. What is gathered per key is one row,
    combined on the map side.
    """
    hashed = lambda df, column, *more: df.select(_key(column).alias("k"), *more).where("k IS NOT NULL AND k <> ''").withColumn("h", F.xxhash64("k"))
    rows = hashed(records, key, F.col(f"`{number}`").cast("long").alias("n"))
    suspect = settle(rows.join(flagged, "n", "left_semi"), "suspect")
    hashes = suspect.select("h").distinct()
    old = hashed(stored, stored_key or key).join(hashes, "h", "left_semi").select("h", "k", F.lit(True).alias("stored"), F.lit(None).cast("long").alias("n"))
    new = rows.join(hashes, "h", "left_semi").select("h", "k", F.lit(False).alias("stored"), "n")
    first = old.unionByName(new).groupBy("h", "k").agg(F.max("stored").alias("stored"), F.min("n").alias("first"))
    return suspect.join(first, ["h", "k"]).select("n", (F.col("stored") | (F.col("first") < F.col("n"))).alias("right"))


def audit(records: DataFrame, key: str, flagged: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: records asked, answered "seen", wrongly so, and both rates."""
    asked = records.where(F.col(f"`{key}`").isNotNull() & (F.col(f"`{key}`") != "")).agg(F.count(F.lit(1)).alias("asked"))
    sums = checked.agg(F.count(F.lit(1)).alias("flagged"), F.coalesce(F.sum(F.when(F.col("right"), 0).otherwise(1)), F.lit(0)).alias("wrong"))
    unseen = F.col("asked") - F.col("flagged") + F.col("wrong")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return asked.join(F.broadcast(sums), F.lit(True)).select("asked", "flagged", "wrong", rate(F.col("wrong"), F.col("asked")).alias("wrong_rate"), rate(F.col("wrong"), unseen).alias("false_positive_rate"))
