"""Tables of versions: a commit replaces the buckets of rows that it touches and becomes visible as a whole, once, or not at all."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table unless it says otherwise; seconds after which the claim of a writer that is gone counts no more.
BUCKETS, STALE_SECONDS = 16, 600


class StoreError(RuntimeError):
    """code tells what went wrong: CONFLICT, MANIFEST_CHANGED, CONFIGURATION_CHANGED, VERSION_UNKNOWN."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code} {detail}".strip())
        self.code = code


@dataclass(frozen=True)
class Snapshot:
    """A version with the hashes of its manifest and of the configuration that it was taken under."""

    version: int
    manifest_hash: str
    configuration_hash: str


def bundle_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Store:
    """Tables below one path on a file system that renames without overwriting.

    data/ has a folder for each commit and table with the rows of the buckets that it touched; manifests/ a file for each version, its number and its attempt's hash in the name, that
    says which folder holds each bucket of each table. A commit writes its data, then renames its manifest into place: that is
    when readers see its rows, its receipt and its event, all at once. Data of a commit that failed before is never referred to.
    One attempt commits once: the same attempt again returns the version that it made. Writers that prepared on the same version: the first wins, the other gets CONFLICT and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm.org.apache.hadoop
        self._at = lambda p: jvm.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))

    def _names(self) -> list[str]:
        """The manifests' names by version."""
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))) if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The latest manifest, or that of a version."""
        names = self._names()
        if version is None and not names:
            return {"version": 0, "tables": {}}
        found = names[-1:] if version is None else [n for n in names if int(n.split("-")[0]) == version]
        if not found:
            raise StoreError("VERSION_UNKNOWN", str(version))
        return json.loads(self._get(self._at(f"manifests/{found[0]}")))

    def committed(self, attempt: str) -> int | None:
        """The version that an attempt made."""
        mark = hashlib.sha256(attempt.encode()).hexdigest()[:32]
        return next((int(n.split("-")[0]) for n in self._names() if n.split("-")[1] == f"{mark}.json"), None)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version: whatever is committed meanwhile, the rows stay those of that version."""
        held = self.manifest(version)["tables"].get(table)
        if not held:
            raise StoreError("VERSION_UNKNOWN", table)
        schema = T.StructType.fromJson(held["schema"])
        by_folder: dict[str, list[int]] = {}
        for b, folder in held["buckets"].items():
            by_folder.setdefault(folder, []).append(int(b))
        parts = [self.spark.read.schema(schema).parquet(*(f"{self.path}/{folder}/bucket={b}" for b in sorted(bs))) for folder, bs in sorted(by_folder.items())]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def commit(self, attempt: str, changes: dict[str, Change], receipt: dict | None = None) -> int:
        """Apply the changes to their tables in one version and return it; an attempt that committed before changes nothing.

        receipt is any JSON that belongs to the attempt; it is part of the manifest.
        """
        done = self.committed(attempt)
        if done is not None:
            return done
        base = self.manifest()
        version, tables, own = base["version"] + 1, dict(base["tables"]), uuid.uuid4().hex
        for name, change in changes.items():
            tables[name] = self._write(name, change, base, f"data/{version:08d}-{own}/{name}")
        body = {"version": version, "attempt": attempt, "receipt": receipt, "parent": bundle_hash(base), "tables": tables}
        mark = hashlib.sha256(attempt.encode()).hexdigest()[:32]
        temp, claim = self._at(f"manifests/{own}.tmp"), self._at(f"manifests/{version:08d}.claim")
        self._put(temp, json.dumps(body, sort_keys=True))
        # the version is claimed by a file that only one writer can make; who has it sees whether another commit came first
        if not self._claimed(claim, own):
            raise StoreError("CONFLICT", f"version {version}")
        try:
            if self.manifest()["version"] != base["version"] or self._get(claim) != own or not self._fs.rename(temp, self._at(f"manifests/{version:08d}-{mark}.json")):
                raise StoreError("CONFLICT", f"version {version}")
        finally:
            self._fs.delete(claim, False)
        return version

    def _put(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claimed(self, claim, own: str) -> bool:
        """Make the claim; one that a lost writer left STALE_SECONDS ago is taken over."""
        if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS:
            self._fs.delete(claim, False)
        try:
            self._put(claim, own)
        except Py4JJavaError:
            return False
        return True

    def _write(self, name: str, change: Change, base: dict, folder: str) -> dict:
        held, rows = base["tables"].get(name), change.rows
        bucket = F.pmod(F.xxhash64(*(F.col(k) for k in change.keys)), F.lit(self.buckets)).cast("int")
        new = rows.withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if held and touched:
            old = self.read(name, base["version"]).withColumn("bucket", bucket).where(F.col("bucket").isin(touched))
            new = old.join(rows.select(*change.keys).distinct(), list(change.keys), "left_anti").select(*new.columns).unionByName(new)
        if touched:
            new.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        buckets = dict(held["buckets"]) if held else {}
        buckets.update({str(b): folder for b in touched})
        return {"schema": json.loads(rows.schema.json()), "buckets": buckets}

    def snapshot(self, configuration: object, version: int | None = None) -> Snapshot:
        body = self.manifest(version)
        return Snapshot(body["version"], bundle_hash(body), bundle_hash(configuration))

    def validated(self, snapshot: Snapshot, configuration: object) -> Snapshot:
        """The snapshot, or an error if its manifest or the configuration is another than when it was taken."""
        if bundle_hash(self.manifest(snapshot.version)) != snapshot.manifest_hash:
            raise StoreError("MANIFEST_CHANGED", str(snapshot.version))
        if bundle_hash(configuration) != snapshot.configuration_hash:
            raise StoreError("CONFIGURATION_CHANGED")
        return snapshot

    def receipts(self) -> DataFrame:
        """version, attempt, receipt (JSON) of every commit, in the order of versions."""
        rows = [(b["version"], b["attempt"], json.dumps(b["receipt"], sort_keys=True)) for b in (json.loads(self._get(self._at(f"manifests/{n}"))) for n in self._names())]
        return self.spark.createDataFrame(rows, "version int, attempt string, receipt string")


@dataclass(frozen=True)
class Change:
    """Rows for a table, which supersede all rows with their keys; others stay. With a group as its key a change replaces whole groups.

    A row with a null key is never superseded. Rows may repeat keys: all of them stay.
    """

    rows: DataFrame
    keys: tuple[str, ...]


def upsert(rows: DataFrame, *keys: str) -> Change:
    return Change(rows, keys)


def commit_stream(stream: DataFrame, store: Store, name: str, changes: Callable[[DataFrame], dict[str, Change]], state: str) -> None:
    """Run a stream to its end; each batch is one commit of the store, keyed by the stream's name and the batch's number, so that a batch that is run again changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            store.commit(f"{name}:{number}", changes(held), {"stage": name, "batch": number, "rows": held.count()})
        finally:
            held.unpersist()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def active_claims(attempts: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """The latest attempt of each artifact (projection, kind, entity), active unless the artifact is among the lost (projection, kind, entity) since (at): history stays, belief changes.

    attempts: projection, kind, entity, receipt_hash, at and attempt, which breaks ties.
    """
    keys = ["projection", "kind", "entity"]
    last = attempts.groupBy(*keys).agg(F.max(F.struct("at", "attempt", "receipt_hash")).alias("l"), F.count("*").alias("attempts"))
    out = last.select(*keys, "l.receipt_hash", "l.at", "attempts")
    if lost is None:
        return out.withColumn("active", F.lit(True))
    gone = lost.groupBy(*keys).agg(F.max("at").alias("gone_at"))
    return out.join(gone, keys, "left").withColumn("active", F.col("gone_at").isNull() | (F.col("gone_at") < F.col("at"))).drop("gone_at")
