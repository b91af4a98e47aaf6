"""Sharding by size-tiered compaction.

A store is a folder of immutable runs and of versioned manifests. An arrival is appended as a run of
small shards. A run's tier is the power of `fanout` that its mean shard has of the smallest size; when a
tier holds `fanout` runs they are merged into one with shards of the target size, or fewer, larger ones.
Runs whose shards have reached the target are sealed and never written again, so every row is written
about once per tier. Runs are as few as arrivals in the lowest tiers, so the manifest stays small however
large the store is; the rows never pass the driver, and merging needs no shuffle.

A version exists once its manifest has been renamed into place; the rename fails if another writer has
been faster, and the commit is then tried again on top of it. A merge deletes nothing, so that other
writers' runs that wait for their commit, older versions and their readers stay whole. vacuum clears runs
that none of the kept versions names and that are older than an age.

Defined cases: null values, repeated rows and any further columns are kept as they are; an arrival
without rows makes a version without a new run; an empty store reads as an empty table.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import unused

TARGET_BYTES, SMALLEST_BYTES, FANOUT = 128 << 20, 64 << 10, 4
TRIES = 20


@dataclass(frozen=True)
class Run:
    """A folder of shards."""

    name: str
    shards: int
    bytes: int
    rows: int

    def tier(self, fanout: int = FANOUT, target: int = TARGET_BYTES) -> int | None:
        """None: sealed."""
        mean = self.bytes / max(1, self.shards)
        return None if mean >= target / 2 else max(0, int(math.log(max(mean, 1) / SMALLEST_BYTES, fanout)))


class MergedByAnother(RuntimeError):
    pass


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, sole_user: bool = False):
        """sole_user: nobody else writes to the store or reads older versions, so a merge may delete what it replaces."""
        self.sole_user = sole_user
        self.spark, self.path, self.schema, self.target, self.fanout = spark, path.rstrip("/"), schema, target_bytes, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        for folder in ("runs", "manifests", "staged"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))

    # manifests

    def version(self) -> int:
        """The newest version; 0 before the first."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        return max((int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**x) for x in json.loads(text)["runs"]]

    def _put(self, version: int, runs: list[Run]) -> bool:
        """Whether this writer made the version: the rename does not overwrite."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft = self._path(f"{self.path}/staged/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(x) for x in runs]}).encode()))
        out.close()
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf) if draft.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        try:
            context.rename(draft, self._path(f"{self.path}/manifests/{version:012d}.json"), options)
            return True
        except Exception as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" not in str(e):
                raise
            return False

    def commit(self, add: list[Run], remove: set[str] = frozenset()) -> int:
        """A new version with these runs instead of those; raises if another writer has removed one of them."""
        for _ in range(TRIES):
            at = self.version()
            held = self.runs(at)
            if missing := remove - {x.name for x in held}:
                raise MergedByAnother(f"merged by another writer: {sorted(missing)}")
            if self._put(at + 1, [x for x in held if x.name not in remove] + add):
                return at + 1
        raise RuntimeError(f"no commit in {TRIES} tries")

    # writing

    def _measured(self, name: str, rows: int | None = None) -> Run | None:
        found = [x for x in self._fs.listStatus(self._path(f"{self.path}/runs/{name}")) if x.getPath().getName().endswith(".parquet")]
        if rows is None:
            rows = self._read([name]).count()
        return Run(name, len(found), sum(x.getLen() for x in found), rows) if rows else None

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Appends the rows of df as a run; with `arrival`, as a run for each value of that column, in
        order of the values, written in one pass."""
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        if arrival is None:
            df.select(*self.schema.names).write.parquet(staged)
            parts = [("", staged)]
        else:
            own = unused("arrival_", self.schema.names)
            df.select(*self.schema.names, F.col(arrival).alias(own)).write.partitionBy(own).parquet(staged)
            found = [x.getPath() for x in self._fs.listStatus(self._path(staged)) if x.isDirectory()]
            parts = sorted((x.getName().split("=", 1)[1].zfill(20), x.toString()) for x in found if "=" in x.getName())
        for _, part in parts:
            name = uuid.uuid4().hex
            self._fs.rename(self._path(part), self._path(f"{self.path}/runs/{name}"))
            run = self._measured(name)
            self.commit([run] if run else [])
            self.compact()
        self._fs.delete(self._path(staged), True)
        return self.version()

    def due(self) -> list[Run] | None:
        """The runs of the lowest tier that is full."""
        tiers: dict[int, list[Run]] = {}
        for run in self.runs():
            if (tier := run.tier(self.fanout, self.target)) is not None:
                tiers.setdefault(tier, []).append(run)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)

    def compact(self) -> None:
        """Merges full tiers until none is left. Each merge leaves fewer runs: those of a tier are below half
        the target, so the merged one has at most half as many shards as there were runs."""
        while runs := self.due():
            name, old = uuid.uuid4().hex, [x.name for x in runs]
            self._read(old).coalesce(max(1, round(sum(x.bytes for x in runs) / self.target))).write.parquet(f"{self.path}/runs/{name}")
            try:
                self.commit([self._measured(name, sum(x.rows for x in runs))], set(old))
            except MergedByAnother:
                old = [name]
            if self.sole_user or old == [name]:
                for x in old:
                    self._fs.delete(self._path(f"{self.path}/runs/{x}"), True)

    def vacuum(self, keep_versions: int = 10, older_than: float = 7 * 86400) -> None:
        """Clears the runs that none of the last versions names and that were written more than `older_than`
        seconds ago: longer than any append or merge takes from its first file to its commit, and than
        any reader of an older version goes on."""
        at, now = self.version(), self.spark._jvm.java.lang.System.currentTimeMillis()
        live = {x.name for v in range(max(1, at - keep_versions + 1), at + 1) for x in self.runs(v)}
        for x in self._fs.listStatus(self._path(f"{self.path}/runs")):
            if x.getPath().getName() not in live and now - x.getModificationTime() > 1000 * older_than:
                self._fs.delete(x.getPath(), True)

    # reading

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/runs/{x}" for x in names])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default)."""
        runs = self.runs(version)
        return self._read([x.name for x in runs]) if runs else self.spark.createDataFrame([], self.schema)
