"""Shared plumbing of the training-data operators: session settings, scratch tables, hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that goes to a Python worker; bounds a worker's memory for long texts.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> str:
    """Bound the Arrow batches and return the shared folder for cut lineage.

    The folder comes from ``spark.checkpoint.dir``. Only where the session names none and runs on this
    machine alone, as in local tests, one is made; on a cluster a missing name is an error, as all its
    machines must share the folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rasterloom-"))
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Written tables in the shared folder that live until the ``with`` block ends.

    A table is committed before it is read, so losing an executor costs at most the tasks it was
    running. What leaves the block must have been cut off with :meth:`keep`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{prepare(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.delete(self.root)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            self.delete(path)

    def sweep(self) -> None:
        """Let Spark's cleaner see that nothing refers to the shuffles of written tables any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    @staticmethod
    def keep(df: DataFrame) -> DataFrame:
        """A reliable checkpoint; Spark's cleaner removes it once no plan refers to it."""
        return df.checkpoint(eager=True)


def slices(batches, most: int = 1 << 20):
    """The batches' rows in batches of about ``most`` bytes, one row at least: what Python makes of a batch is many times its size."""
    for b in batches:
        rows = max(1, b.num_rows * most // max(1, b.nbytes))
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def trimmed(run):
    """``run`` over batches, then what the task freed goes back to the system: workers idle on beside later stages."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays (wraps around by design)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    return F.translate(col, ASCII_UP, ASCII_LOW)


def hash_sample(df: DataFrame, total: int, size: int, seed: int, *keys: str) -> DataFrame:
    """The ``size`` rows with the smallest hashes of ``keys``. ``total`` counts the rows, so that a bound on
    the hash leaves about twice as many to order, however many tasks there are."""
    h = F.xxhash64(F.lit(seed), *keys)
    bound = int(min(1.0, 2 * size / max(1, total)) * 2**64) - 2**63 - 1
    return df.where(h <= bound).orderBy(h, *keys).limit(size)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``(id, component)``, component the
    smallest id reachable. Only ids on an edge appear.

    Min-label hooking with pointer jumping: each round every vertex takes the smallest label among
    itself and its neighbours (an aggregation, combined map-side, so hubs are no hot keys), then
    the label of its label. Rounds are logarithmic for stars and short chains. Each round is a
    written table; the driver sees one count a round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.table(both.where("a <> b").distinct())
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        # hang the old root, too, so that whole trees move at once
        roots = hooked.where("mid < was").groupBy(F.col("was").alias("id")).agg(F.min("mid").alias("better"))
        hooked = hooked.join(roots, "id", "left").select("id", "was", F.least("mid", "better").alias("mid"))
        hooked = scratch.table(hooked)
        jump = hooked.select(F.col("id").alias("mid"), F.col("mid").alias("top"))
        moved = scratch.table(hooked.join(jump, "mid", "left").select("id", "was", F.least("mid", "top").alias("component")))
        changed = moved.where("component <> was").limit(1).count()
        for old in (labels, hooked):
            scratch.drop(old)
        labels = moved.select("id", "component")
        labels._scratch_path = moved._scratch_path
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
