"""A keyed store in which the first insert of a key wins, written by batches or by a stream, safe to repeat.

    store/data/part=<token>/bucket=<n>/*.parquet     what one commit added, dealt by owner
    store/commits/<version>.json                     what a version adds and removes, and which batch it was

A row is in the store when a commit names its folder. A commit is a new file whose name is the next version; making it fails if
another writer made it first, and the loser then starts over against what that one stored. So readers see whole batches, a writer
that dies leaves a folder nobody reads (vacuum removes it), and of two writers with one key the earlier commit wins. A commit
remembers its batch (source, number): a batch that comes again, after a restart, changes nothing.

A batch meets the store's keys in one semi-join (the batch is the small side, which Spark broadcasts if it is small enough);
only key columns are read. compact() rewrites all folders into one per call and lists the state anew, so neither files nor
commits pile up. Rows with a null key are left out."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()


class Conflict(Exception):
    """Another writer made this version."""


class KeyedStore:
    """key: columns that are unique in the store; owner: column that lookups go by; order: which of a batch's rows with one key is first."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], owner: str, order: list[str], buckets: int = 16):
        self.spark, self.path, self.key, self.owner, self.order, self.buckets = spark, path.rstrip("/"), key, owner, order, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(f"{self.path}/commits"))

    # --- versions ---

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._hadoop(f"{self.path}/commits/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, version: int, facts: dict) -> None:
        """Makes the file of a version, or raises Conflict. A local file is linked into place, elsewhere a rename does not replace a file."""
        final, part = f"{self.path}/commits/{version:012}.json", f"{self.path}/commits/.{uuid.uuid4().hex}"
        out = self._fs.create(self._hadoop(part), True)
        out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                strip = lambda p: self._hadoop(p).toUri().getPath()
                try:
                    os.link(strip(part), strip(final))
                except FileExistsError:
                    raise Conflict(version) from None
            else:
                with _LOCK:
                    if self._fs.exists(self._hadoop(final)) or not self._fs.rename(self._hadoop(part), self._hadoop(final)):
                        raise Conflict(version)
        finally:
            self._fs.delete(self._hadoop(part), False)

    def state(self) -> dict:
        """version (-1: none), folders, and the last batch of each source."""
        names = [n for n in self._names("commits") if n.endswith(".json")]
        version, folders, batches, loaded = -1, [], {}, []
        for n in reversed(names):  # back to the last version that lists everything
            loaded.append((int(n[:-5]), self._load(n)))
            if loaded[-1][1].get("whole"):
                break
        for version, facts in reversed(loaded):
            folders = facts["add"] if facts.get("whole") else [*folders, *facts["add"]]
            batches = {**({} if facts.get("whole") else batches), **facts["batches"]}
        return {"version": version, "folders": folders, "batches": batches}

    # --- reading ---

    def read(self, state: dict | None = None) -> DataFrame | None:
        """All rows, or None if there are none yet."""
        every = self._every((state or self.state())["folders"])
        return None if every is None else every.drop("part", "bucket")

    def _every(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else None

    def of_owner(self, value) -> DataFrame | None:
        """Rows of one owner, in order: one bucket of each folder is read."""
        every = self._every(self.state()["folders"])
        if every is None:
            return None
        bucket = self.spark.range(1).select(self._bucket(F.lit(value).cast(dict(every.dtypes)[self.owner]))).first()[0]
        return every.filter((F.col("bucket") == bucket) & (F.col(self.owner) == value)).drop("part", "bucket").orderBy(*self.order, *self.key)

    def owners(self) -> DataFrame | None:
        rows = self.read()
        return None if rows is None else rows.select(self.owner).distinct()

    # --- writing ---

    def _bucket(self, owner):
        return F.pmod(F.xxhash64(owner), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        token = f"part={uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(F.col(self.owner))).write.partitionBy("bucket").parquet(f"{self.path}/data/{token}")
        return token

    def fresh(self, batch: DataFrame, state: dict) -> DataFrame:
        """Of each key of the batch that is not stored the first row."""
        rest = [c for c in batch.columns if c not in self.key]
        rows = batch.dropna(subset=self.key)
        first = rows.groupBy(*self.key).agg(F.min_by(F.struct(*rest), F.struct(*self.order, *[F.to_json(F.struct(*rest))])).alias("_r"))
        rows = first.select(*self.key, "_r.*").select(*batch.columns)
        stored = self.read(state)
        if stored is None:
            return rows
        known = stored.select(*self.key).join(rows.select(*self.key), self.key, "left_semi")
        return rows.join(known, self.key, "left_anti")

    def insert(self, batch: DataFrame, source: str, number: int, tries: int = 50) -> dict:
        """Adds what is new of a batch. Returns version, added, and whether the batch had been stored before (batches of a source come in order)."""
        for _ in range(tries):
            state = self.state()
            if state["batches"].get(source, -1) >= number:
                return {"version": state["version"], "added": 0, "repeated": True}
            token = self._write(self.fresh(batch, state))
            added = self._count(token)
            if not added:
                self._fs.delete(self._hadoop(f"{self.path}/data/{token}"), True)
            try:
                self._save(state["version"] + 1, {"add": [token] if added else [], "batches": {source: number}})
                return {"version": state["version"] + 1, "added": added, "repeated": False}
            except Conflict:
                self._fs.delete(self._hadoop(f"{self.path}/data/{token}"), True)
        raise RuntimeError(f"{tries} writers came first")

    def _count(self, token: str) -> int:
        files = [n for n in self._names(f"data/{token}") if n.startswith("bucket=")]
        return self.spark.read.parquet(f"{self.path}/data/{token}").count() if files else 0

    def sink(self, source: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: repeated batches change nothing."""

        def run(batch: DataFrame, number: int) -> None:
            self.insert(batch, source, number)

        return run

    def compact(self, tries: int = 50) -> dict:
        """All rows into one folder, listed whole. Rows stored meanwhile make it start over."""
        for _ in range(tries):
            state = self.state()
            if len(state["folders"]) <= 1:
                return state
            token = self._write(self.read(state).repartition(self.buckets, self._bucket(F.col(self.owner))))
            try:
                self._save(state["version"] + 1, {"whole": True, "add": [token], "batches": state["batches"]})
                return self.state()
            except Conflict:
                self._fs.delete(self._hadoop(f"{self.path}/data/{token}"), True)
        raise RuntimeError(f"{tries} writers came first")

    def vacuum(self) -> list[str]:
        """Removes folders that no version of now names, and commits before the last that lists everything. Not while others read or write."""
        names = [n for n in self._names("commits") if n.endswith(".json")]
        whole = [n for n in names if self._load(n).get("whole")]
        for n in names[: names.index(whole[-1])] if whole else []:
            self._fs.delete(self._hadoop(f"{self.path}/commits/{n}"), False)
        gone = sorted(set(self._names("data")) - set(self.state()["folders"]))
        for f in gone:
            self._fs.delete(self._hadoop(f"{self.path}/data/{f}"), True)
        return gone
