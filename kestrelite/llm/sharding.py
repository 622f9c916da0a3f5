"""Sharding: size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. While a tier holds ``FAN_IN`` runs of similar size, they are merged
into the next tier, up to target-sized files, which are never touched again. Every change ends with one atomic commit: the
manifest of the next version is written under a temporary name and renamed without overwriting, so a reader sees all of a
commit or nothing, and of two writers of a version one fails, reads the winner's manifest and commits on top of it. A lost
writer leaves only files that no manifest names; ``vacuum`` removes them once they are older than a grace period, which must
be longer than any append takes. The store needs a file system whose rename does not replace (HDFS; not plain object stores).

Sizes are bytes of the rows' strings, so plans do not depend on compression. Arrivals are cut to the small size by rows, from
their mean size. A merge reads and writes its own shards only. The manifest holds one line per shard, so it grows with the
number of target-sized files, not with rows.

Defined cases: nulls weigh 0 bytes; repeated rows are all stored; any columns may come, also no text at all, as rows are stored
whole; input columns named ``shard`` or ``version`` come back with ``_input`` added; an empty table commits a manifest of no rows; rows with a null id arrive first.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import new_path

#: Bytes of text of a finished file and of an arriving shard, and how many similar runs make a merge.
TARGET, SMALL, FAN_IN = 64 << 20, 4 << 20, 4
#: Merges that run in one job, commits that are tried against other writers, and seconds for which unnamed files are left alone.
MERGES, TRIES, GRACE = 32, 20, 24 * 3600


class Store:
    """A folder of shards and manifests, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, small: int = SMALL, fan_in: int = FAN_IN) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.small, self.fan_in = target, small, fan_in
        self._jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ---- manifests

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path("_manifests")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("_manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest by default: version, schema (JSON) and shards."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"_manifests/v{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """Publish the next version; fails if another writer has published it first."""
        made = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        final = self._path(f"_manifests/v{made['version']:08d}.json")
        temporary = self._path(f"_manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary)
        stream.write(bytearray(json.dumps(made, indent=1).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        nothing = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temporary, final, nothing)
        except Py4JJavaError as e:
            self.fs.delete(temporary, False)
            if not self.fs.exists(final):
                raise
            raise FileExistsError(f"version {made['version']} was committed by another writer") from e
        return made

    def _commit_on_top(self, change: Callable[[dict], tuple[list[dict], str | None] | None]) -> dict:
        """Commit what ``change`` makes of the latest manifest, again on top of any writer that was faster."""
        for _ in range(TRIES):
            base = self.manifest()
            made = change(base)
            if made is None:
                return base
            try:
                return self.commit(base, *made)
            except FileExistsError:
                continue
        raise FileExistsError(f"{TRIES} commits were overtaken by other writers")

    # ---- writing

    def _write(self, rows: DataFrame, per_file: int = 0) -> list[dict]:
        """Write one file per partition of ``rows`` (more past ``per_file`` rows), without a shuffle, and describe them as shards."""
        batch = uuid.uuid4().hex[:12]
        folder = f"{self.path}/data/{batch}"
        rows.write.option("maxRecordsPerFile", per_file).parquet(folder)
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(f"data/{batch}"))]
        if not any(n.endswith(".parquet") for n in names):
            return []
        found = self.spark.read.schema(rows.schema).parquet(folder)
        found = found.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), weight(found).alias("bytes"))
        sizes = found.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")).collect()  # one line a shard
        return [{"path": f"data/{batch}/{r['file']}", "rows": r["rows"], "bytes": int(r["bytes"])} for r in sizes]

    def rows_of_small(self, rows: DataFrame) -> int:
        """Rows that fill a small shard, by the mean size of a row."""
        n, size = rows.agg(F.count(F.lit(1)), F.sum(weight(rows))).first()
        return max(1, self.small * n // size) if n and size else 0

    def append(self, rows: DataFrame, per_file: int | None = None) -> dict:
        """Add arrivals as small shards, one or more per partition of ``rows``, and commit."""
        new = self._write(rows, self.rows_of_small(rows) if per_file is None else per_file)
        return self._commit_on_top(lambda base: (base["shards"] + new, rows.schema.json()))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._read(self.manifest(version))

    def _read(self, made: dict, shards: list[dict] | None = None) -> DataFrame:
        use = made["shards"] if shards is None else shards
        schema = StructType.fromJson(json.loads(made["schema"])) if made["schema"] else StructType()
        if not use:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['path']}" for s in use])

    # ---- compaction

    def tier(self, size: int) -> int:
        """0 up to the small size, one more for each factor of ``fan_in``; finished files have none above."""
        k, limit = 0, self.small * 1.5
        while size > limit and limit < self.target:
            k, limit = k + 1, limit * self.fan_in
        return k

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of similar shards to merge: whole runs of ``fan_in`` or more in a tier, cut at the target size."""
        groups: list[list[dict]] = []
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target * 3 // 4:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        for own in tiers.values():
            group, size = [], 0
            for s in sorted(own, key=lambda s: (s["bytes"], s["path"])):
                if group and size + s["bytes"] > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            if len(group) >= self.fan_in:
                groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> dict:
        """Merge until no tier is full; one commit. Only the merged shards are read and written."""
        base = self.manifest()
        shards = list(base["shards"])
        while groups := self.plan(shards):
            for k in range(0, len(groups), MERGES):
                # each merge is one task over at most a target size of text; a job runs many of them
                merges = [self._read(base, g).coalesce(1) for g in groups[k : k + MERGES]]
                new = self._write(functools.reduce(DataFrame.unionAll, merges))
                gone = {s["path"] for g in groups[k : k + MERGES] for s in g}
                shards = [s for s in shards if s["path"] not in gone] + new
        before, after = {s["path"] for s in base["shards"]}, {s["path"] for s in shards}
        if before == after:
            return base

        def change(latest: dict) -> tuple[list[dict], str | None] | None:
            here = {s["path"] for s in latest["shards"]}
            if not before - after <= here:
                return None  # another writer has merged some of them: its merge stands, ours is left to vacuum
            kept = [s for s in latest["shards"] if s["path"] not in before - after]
            return kept + [s for s in shards if s["path"] not in before], latest["schema"]

        return self._commit_on_top(change)

    def vacuum(self, keep_versions: int = 2, grace: float = GRACE) -> None:
        """Delete files older than ``grace`` seconds that none of the last ``keep_versions`` manifests names, and older manifests.

        A concurrent append's files, written and not yet committed, are younger than that and stay.
        """
        until = int((time.time() - grace) * 1000)
        candidates = []
        if self.fs.exists(self._path("data")):
            for batch in self.fs.listStatus(self._path("data")):
                name = batch.getPath().getName()
                candidates += [(f"data/{name}/{f.getPath().getName()}", f) for f in self.fs.listStatus(batch.getPath()) if f.getModificationTime() <= until]
        # manifests are read after the listing, so that what was committed meanwhile counts as named
        known = self.versions()
        used = {s["path"] for v in known[-keep_versions:] for s in self.manifest(v)["shards"]}
        for name, file in candidates:
            if name not in used:
                self.fs.delete(file.getPath(), True)
        for v in known[:-keep_versions]:
            self.fs.delete(self._path(f"_manifests/v{v:08d}.json"), False)


def weight(rows: DataFrame) -> Column:
    """Bytes of a row: those of its strings, and eight for each other column."""
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in rows.schema)}
    size = F.lit(8 * sum(t not in ("string", "binary") for t in kinds.values())).cast("long")
    for c, t in kinds.items():
        if t in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return size


def shard(docs: DataFrame, arrivals: int = 3, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """Store ``docs`` as ``arrivals`` appends, compacting and vacuuming after each; its rows with ``shard`` and ``version``.

    ``shard`` is the file that holds the row, as the last manifest names it.
    """
    store = Store(docs.sparkSession, path or new_path(docs.sparkSession, "shards"))
    batch = F.coalesce(F.pmod(F.xxhash64(key), F.lit(arrivals)), F.lit(0))
    per_file = store.rows_of_small(docs)
    for k in range(arrivals):
        store.append(docs.where(batch == k), per_file)
        store.compact()
        # a store of our own has no other writer whose files could be taken for lost ones
        store.vacuum(1 if path is None else 2, 0 if path is None else GRACE)
    made = store.manifest()
    clash = {"shard", "version"} & set(docs.columns)
    shown = [F.col(f"`{c}`").alias(f"{c}_input" if c in clash else c) for c in docs.columns]
    rows = store._read(made)
    file = F.element_at(F.split("_metadata.file_path", "/"), -1) if made["shards"] else F.lit(None).cast("string")
    return rows.select(*shown, file.alias("shard"), F.lit(made["version"]).alias("version"))
