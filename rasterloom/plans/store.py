"""Collections as versioned snapshots, and batches and jobs over them.

A write makes a new snapshot folder and commits it by a small pointer file of the next number, which
only one writer can create. Readers take the newest pointer whose snapshot can be read. An update that
finds its number taken reads again and repeats its change, so no update is lost.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import JOBS as KEPT_JOBS
from ..operators.catalog import newest, probe
from .dag import cache_key, canonical_key, execute, validate


class Conflict(Exception):
    """Another writer has committed meanwhile."""


class Collection:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/commit-*")) or []
        return sorted(int(s.getPath().getName().rpartition("-")[2]) for s in found)

    def _snapshot(self, version: int) -> str:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/commit-{version:010d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _readable(self, name: str) -> bool:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/{name}/_SUCCESS")):
            return False
        try:
            self.spark.read.parquet(f"{self.path}/{name}").schema  # reads a footer
        except Exception:  # noqa: BLE001 - broken in whatever way
            return False
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or ``version``; the one before where its snapshot is broken; empty where there is none."""
        for v in reversed(self.versions()):
            if (version is None or v <= version) and self._readable(name := self._snapshot(v)):
                return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, after: int | None = None, keep: int = 2) -> int:
        """Commit ``df`` as the version after ``after`` (the newest where None). Raises :class:`Conflict` where there is one already."""
        known = self.versions()
        version = (after if after is not None else known[-1] if known else 0) + 1
        name = f"v{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        fs, path = self._fs()
        pointer = path(f"{self.path}/commit-{version:010d}")
        part = path(f"{self.path}/.tmp-{uuid.uuid4().hex}")
        stream = fs.create(part)
        stream.write(bytearray(name.encode()))
        stream.close()
        # the pointer is created once: first an empty file of its own name as a lock, then the whole one over it
        lock = path(f"{self.path}/.lock-{version:010d}")
        if fs.exists(pointer) or not fs.createNewFile(lock):
            fs.delete(part, False)
            fs.delete(path(f"{self.path}/{name}"), True)
            raise Conflict(f"version {version} of {self.path} is taken")
        fs.rename(part, pointer)
        for old in self.versions()[:-keep]:
            fs.delete(path(f"{self.path}/{self._snapshot(old)}"), True)
            fs.delete(path(f"{self.path}/commit-{old:010d}"), False)
        return version

    def update(self, change, tries: int = 10) -> DataFrame:
        """Read, change, write; again where another writer was faster."""
        for left in reversed(range(tries)):
            known = self.versions()
            try:
                return self.read(self.write(change(self.read()), known[-1] if known else 0))
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Whole or not at all: a temporary file beside it, then a rename over what was there."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".tmp-{uuid.uuid4().hex}")
    stream = fs.create(part)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    if fs.exists(to):
        fs.delete(to, False)
    fs.rename(part, to)


CACHE = "key string, result_id string, image_id long, w int, h int, data binary, meta string, size_bytes long, created_at double, last_access double, present boolean"


def run_batch(spark: SparkSession, images: DataFrame, nodes: list[dict], cache: Collection, now: float | None = None) -> DataFrame:
    """Run a graph over ``images(image_id, id, w, h, data)``, each content once: cached results are
    taken, only misses are computed, and what was computed is added to the cache.

    Returns (image_id, key, result_id, cache_hit, status, error). The graph is validated before the cache is asked.
    """
    now = time.time() if now is None else now
    if errors := validate(nodes):
        return images.select("image_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("result_id"), F.lit(False).alias("cache_hit"), F.lit("error").alias("status"), F.lit("; ".join(errors)).alias("error"))
    plan = cache_key(canonical_key(nodes))
    keyed = images.withColumn("key", F.sha2(F.concat(F.col("id").cast("binary"), F.lit(b"\0"), F.lit(plan.encode()), F.lit(b"\0")), 256))
    asked = probe(keyed, cache.read()).select("image_id", "key", "w", "h", "data", "cache_hit", "result_id")
    misses = asked.where("NOT cache_hit").dropDuplicates(["key"])
    made = execute(misses.select("image_id", "w", "h", "data"), nodes).join(misses.select("image_id", "key"), "image_id")
    made = made.select("key", F.sha2(F.concat("key", F.lit(uuid.uuid4().hex)), 256).alias("result_id"), "image_id", "w", "h", "data", "meta", F.octet_length("data").cast("long").alias("size_bytes"), F.lit(now).alias("created_at"), F.lit(now).alias("last_access"), F.lit(True).alias("present"))
    run = f"{cache.path}/runs/{uuid.uuid4().hex}"
    asked.select("image_id", "key", "cache_hit").write.parquet(f"{run}/asked")  # before the cache changes
    made.write.parquet(f"{run}/made")
    made = spark.read.parquet(f"{run}/made")
    cache.update(lambda old: old.unionByName(made))
    final = cache.read().where("present").select("key", "result_id")
    out = spark.read.parquet(f"{run}/asked").join(final, "key", "left")
    out = out.select("image_id", "key", "result_id", "cache_hit", F.when(F.col("result_id").isNotNull(), "ok").otherwise("error").alias("status"), F.lit(None).cast("string").alias("error"))
    out.write.parquet(f"{run}/results")
    fs, path = cache._fs()
    for part in ("asked", "made"):
        fs.delete(path(f"{run}/{part}"), True)
    return spark.read.parquet(f"{run}/results")


def run_operation(spark: SparkSession, images: DataFrame, operation: str, params: dict, cache: Collection, now: float | None = None) -> DataFrame:
    """One node over ``images(image_id, id, w, h, data)``, cached by content, operation and parameters: (image_id, result_id, cache_hit, status, error, meta)."""
    out = run_batch(spark, images, [{"id": "only", "type": operation, "params": params, "inputs": []}], cache, now)
    meta = cache.read().select("key", "meta").dropDuplicates(["key"])
    return out.join(meta, "key", "left").drop("key")


JOBS = "id string, pipeline_name string, nodes string, image_ids array<long>, total int, done int, status string, created_at double, finished_at double, results map<bigint, struct<result_id: string, cache_hit: boolean, status: string, error: string>>"


def enqueue_job(spark: SparkSession, jobs: Collection, nodes: list[dict], image_ids: list[int], name: str = "", now: float | None = None) -> str:
    """A queued job; the newest hundred are kept."""
    now, id_ = time.time() if now is None else now, uuid.uuid4().hex
    ids = list(dict.fromkeys(image_ids))
    row = spark.createDataFrame([(id_, name, json.dumps(nodes), ids, len(ids), 0, "queued", now, None, {})], JOBS)
    jobs.update(lambda old: newest(old.unionByName(row), [F.desc("created_at"), F.desc("id")], KEPT_JOBS))
    return id_


def get_job(jobs: Collection, id_: str):
    return jobs.read().where(F.col("id") == id_).first()


def _change_job(spark: SparkSession, jobs: Collection, id_: str, change) -> dict | None:
    """``change`` a job's fields; it sees them as they are when it is committed."""

    def all_(old):
        hit = old.where(F.col("id") == id_).collect()  # one row
        new = [tuple((r.asDict(True) | change(r.asDict(True)))[c] for c in old.columns) for r in hit]
        return old.where(F.col("id") != id_).unionByName(spark.createDataFrame(new, JOBS))

    found = jobs.update(all_).where(F.col("id") == id_).first()
    return found.asDict(True) if found else None


def cancel_job(spark: SparkSession, jobs: Collection, id_: str, now: float | None = None) -> dict | None:
    """A queued or running job stops before its next part."""
    at = time.time() if now is None else now
    return _change_job(spark, jobs, id_, lambda j: {"status": "cancelled", "finished_at": at} if j["status"] in ("queued", "running") else {})


def run_job(spark: SparkSession, jobs: Collection, images: DataFrame, cache: Collection, id_: str, part: int = 1_000) -> dict | None:
    """Run a queued job over ``images``, ``part`` at a time and these in parallel; progress is committed after each part. A cancelled job stays cancelled."""
    job = _change_job(spark, jobs, id_, lambda j: {"status": "running"} if j["status"] == "queued" else {})
    if job is None or job["status"] != "running":
        return job
    nodes, ids = json.loads(job["nodes"]), job["image_ids"]
    for start in range(0, len(ids), part):
        some = ids[start : start + part]
        out = run_batch(spark, images.where(F.col("image_id").isin(some)), nodes, cache)
        rows = {r["image_id"]: {c: r[c] for c in ("result_id", "cache_hit", "status", "error")} for r in out.collect()}  # at most ``part``
        rows |= {i: {"result_id": None, "cache_hit": False, "status": "error", "error": "no such image"} for i in some if i not in rows}

        def add(j, rows=rows):
            return {"results": {**j["results"], **rows}, "done": len({**j["results"], **rows})} if j["status"] == "running" else {}

        if (job := _change_job(spark, jobs, id_, add))["status"] != "running":
            return job
    ended = lambda j: {"status": "partial" if any(r["status"] == "error" for r in j["results"].values()) else "done", "finished_at": time.time()} if j["status"] == "running" else {}
    return _change_job(spark, jobs, id_, ended)
