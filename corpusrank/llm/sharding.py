"""Size-tiered sharding in DataFrame operations: arrivals become small immutable shards, similarly sized runs are merged.

A run is the folder that one append or one merge wrote; its Parquet files are shards and never change. When
FANOUT runs have similar shard sizes (the largest at most RATIO times the smallest), one job reads them and
writes files of about target_bytes: scan partitions are joined by coalesce, so no row is shuffled. Runs whose
shards reach half the target are full and are not written again, so a row is rewritten about
log_FANOUT(target / arriving shard) times. Between merges fewer than FANOUT runs wait in each size class.

Every append and merge commits a new version: a manifest file that lists the live runs is written aside and
renamed to its number; the rename fails if another writer took the number. A reader sees a whole version or
none of it. Rows for each shard (file, bytes, rows) are kept as a table beside each run, not on the driver;
the driver sees one entry for each run.

Writers do not block each other: a writer whose number was taken reads the manifest again and commits on top of it
(a merge only if its runs are still listed). Vacuum spares runs younger than a grace period, since a writer may be
about to commit them.

Defined cases: an empty arrival commits a version without a run; rows are never looked into, so nulls, empty and very
long texts, ties, repeated rows and columns of any name are kept as they are; arrivals must have the columns and types
of the first one, others are refused.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
FANOUT = 4
RATIO = 4.0
#: A run that no version lists is left alone for so long, and a commit is tried so often against other writers.
GRACE_SECONDS = 86_400
TRIES = 50


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark._jvm

    # -- manifest ---------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("_manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "runs": [{"name", "rows", "shards", "bytes"}]} of a version, the latest by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "runs": []}
        at = self._path(f"_manifest/{known[-1] if version is None else version:012d}.json")
        stream = self._fs().open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        fs = self._fs()
        aside = self._path(f"_manifest/.{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        no_overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        no_overwrite[0] = rename.NONE
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(self._path(f"_manifest/{manifest['version']:012d}.json")), no_overwrite)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise CommitConflict(f"version {manifest['version']} exists") from e
            raise
        return manifest["version"]

    # -- runs -------------------------------------------------------------------------------------------------

    def _write_run(self, df: DataFrame, **options) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(f"{self.root}/{name}")
        back = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        meta = back.metadataColumn("_metadata")
        shards = back.select(meta["file_name"].alias("shard"), meta["file_size"].alias("bytes"))
        shards.groupBy("shard").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows")).write.parquet(f"{self.root}/_shards/{name}")
        total = self.spark.read.schema("shard string, bytes long, rows long").parquet(f"{self.root}/_shards/{name}")
        rows, count, size = total.agg(F.sum("rows"), F.count("*"), F.sum("bytes")).first()
        return {"name": name, "rows": rows or 0, "shards": count, "bytes": size or 0}

    def _commit_on(self, change) -> int:
        """Commit change(runs of the latest version, its schema) -> (runs, schema), again on top of other writers' versions; None: give up."""
        for _ in range(TRIES):
            last = self.manifest()
            made = change(last["runs"], last["schema"])
            if made is None:
                return last["version"]
            try:
                return self._commit({"version": last["version"] + 1, "schema": made[1], "runs": made[0]})
            except CommitConflict:
                continue
        raise CommitConflict(f"no version number was free in {TRIES} tries")

    def append(self, df: DataFrame) -> int:
        """Write df as one run of small shards (one for each of its partitions) and commit; returns the version."""
        kinds = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema]

        def add(runs: list[dict], schema: str | None):
            if schema and kinds(T.StructType.fromJson(json.loads(schema))) != kinds(df.schema):
                raise ValueError("the arrival's columns are not those of the store")
            return runs + ([run] if run and run["rows"] else []), schema or df.schema.json()

        run = None
        add([], self.manifest()["schema"])
        run = self._write_run(df)
        return self._commit_on(add)

    def _similar(self, runs: list[dict]) -> list[dict] | None:
        """The first class of at least `fanout` runs that are not full and have similar shard sizes."""
        size = lambda r: r["bytes"] / r["shards"]
        waiting = sorted((r for r in runs if size(r) < self.target / 2), key=size)
        for i, first in enumerate(waiting):
            like = [r for r in waiting[i:] if size(r) <= RATIO * size(first)]
            if len(like) >= self.fanout:
                return like
        return None

    def compact(self) -> int:
        """Merge classes of similar runs until none is left; one version for each merge; returns the last version."""
        while like := self._similar((last := self.manifest())["runs"]):
            total, rows = sum(r["bytes"] for r in like), sum(r["rows"] for r in like)
            files = max(1, round(total / self.target))
            merged = self._scan(last, like).coalesce(files)
            most = -(-rows * 5 // (files * 4))  # a file over 1.25 times its share is split
            run = self._write_run(merged, maxRecordsPerFile=most)
            gone = {r["name"] for r in like}

            def replace(runs: list[dict], schema: str, gone=gone, run=run):
                if not gone <= {r["name"] for r in runs}:  # another writer merged some of them: vacuum takes this run
                    return None
                return [r for r in runs if r["name"] not in gone] + [run], schema

            self._commit_on(replace)
        return self.manifest()["version"]

    def _scan(self, manifest: dict, runs: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{r['name']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("the store is empty")
        return self._scan(manifest, manifest["runs"])

    def shards(self, version: int | None = None) -> DataFrame:
        """run, shard, bytes, rows of a version."""
        runs = [r["name"] for r in self.manifest(version)["runs"]]
        out = self.spark.createDataFrame([], "run string, shard string, bytes long, rows long")
        for name in runs:
            one = self.spark.read.schema("shard string, bytes long, rows long").parquet(f"{self.root}/_shards/{name}")
            out = out.unionByName(one.withColumn("run", F.lit(name)))
        return out

    def vacuum(self, retain: int = 1, grace_seconds: float = GRACE_SECONDS) -> int:
        """Delete runs that none of the last `retain` versions lists and that are older than the grace period, and older manifests; returns how many runs went.

        grace_seconds must be longer than any append or merge takes; 0 is only safe for the store's one writer.
        """
        known = self.versions()
        live = {r["name"] for v in known[-retain:] for r in self.manifest(v)["runs"]}
        fs, gone, newest = self._fs(), 0, (time.time() - grace_seconds) * 1000
        for status in fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in live and status.getModificationTime() <= newest:
                fs.delete(status.getPath(), True)
                fs.delete(self._path(f"_shards/{name}"), True)
                gone += 1
        for v in known[:-retain]:
            fs.delete(self._path(f"_manifest/{v:012d}.json"), False)
        return gone
