"""Line dedup with levelled sorted runs of line hashes.

A run is a Parquet table of line keys, dealt into buckets by key and sorted within them, holding a
key's number of documents and the largest id. A new batch of documents is grouped by key and
merge-anti-joined with the runs: keys that they have settled (seen in ``min_docs`` documents, whose
keeper has a larger id) fall out, the rest become a run of their own. ``fanout`` runs of a level are
merged into one of the next. As runs and batch are bucketed alike, the runs are neither shuffled nor
sorted again, in anti-joins and merges. The runs' folder outlives a call: see :class:`LineRuns`.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, prepare, slices, trimmed


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, A-Z lower-cased line; None if it has fewer than ``min_chars`` code points."""
    key = line.strip().lower()  # on bytes both touch ASCII only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def _key_rows(min_chars: int):
    def run(batches):
        for batch in slices(batches):
            ids, hi, lo = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if doc is None or text is None:
                    continue
                seen = set()
                for line in text.split(b"\n"):
                    if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
                        seen.add(xxhash.xxh3_128_digest(key))
                for d in seen:
                    ids.append(doc)
                    hi.append(int.from_bytes(d[:8], "little", signed=True))
                    lo.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "h1", "h2"])

    return run


RUN = "h1 long, h2 long, n_docs long, keeper long"


class LineRuns:
    """The levelled runs in the folder ``root``: rows ``(h1, h2, n_docs, keeper)``, bucketed and sorted by key.

    Opening a folder that holds runs goes on with them. Every change is committed by a manifest, a
    small table that names the runs; folders that the newest one doesn't name are left over from a
    change that broke off. One writer at a time. The number of buckets is fixed by the first run.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = 2, min_docs: int = 3):
        self.spark, self.root, self.fanout, self.min_docs = spark, root, fanout, min_docs
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file
        self.names: dict[str, str] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath().getParent().getName() for x in self._files.globStatus(self._path(f"{root}/manifest-*/_SUCCESS")) or []]
        self.version = max((int(x.rpartition("-")[2]) for x in found), default=0)
        rows = spark.read.parquet(f"{root}/manifest-{self.version}").orderBy("level", "place").collect() if self.version else []  # a row for each run
        self.buckets = rows[0]["buckets"] if rows else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        for r in rows:
            self.levels += [[] for _ in range(r["level"] + 1 - len(self.levels))]
            self.levels[r["level"]].append(r["run"])

    def _table(self, run: str) -> DataFrame:
        if run not in self.names:
            self.names[run] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self.names[run]} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'")
        return self.spark.table(self.names[run])

    def _write(self, rows: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        self.names[run] = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.root}/{run}").saveAsTable(self.names[run])
        return run

    def _commit(self, gone: list[str]) -> None:
        self.version += 1
        rows = [(level, place, run, self.buckets) for level, runs in enumerate(self.levels) for place, run in enumerate(runs)]
        self.spark.createDataFrame(rows, "level int, place int, run string, buckets int").coalesce(1).write.parquet(f"{self.root}/manifest-{self.version}")
        for run in gone:
            if run in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(run)}")
            self._files.delete(self._path(f"{self.root}/{run}"), True)
        self._files.delete(self._path(f"{self.root}/manifest-{self.version - 1}"), True)

    def close(self) -> None:
        """Forget the table names; the folder stays."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()

    def merged(self) -> DataFrame | None:
        """Every key of the runs once."""
        runs = [self._table(r) for level in self.levels for r in level]
        if not runs:
            return None
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")) if len(runs) > 1 else out

    def add(self, batch: DataFrame) -> None:
        """``batch(doc_id, h1, h2)``; documents of earlier batches must not come again, ids may come in any order."""
        own = batch.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        seen, last = F.lit(0), []
        for i, run in enumerate(r for level in self.levels for r in level):
            old = self._table(run).select("h1", "h2", F.col("n_docs").alias(f"n{i}"), F.col("keeper").alias(f"k{i}"))
            own = own.join(old, ["h1", "h2"], "left")
            seen = seen + F.coalesce(f"n{i}", F.lit(0))
            last.append(F.coalesce(f"k{i}", F.lit(-(2**63))))
        if last:
            own = own.where((seen < self.min_docs) | (F.greatest(*last, F.lit(-(2**63))) < F.col("keeper")))
        run, gone = self._write(own.select("h1", "h2", "n_docs", "keeper")), []
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                break
            old, self.levels[level] = self.levels[level], []
            run = self._write(self._merge([self._table(r) for r in old]))
            gone += old
            level += 1
        self._commit(gone)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs into one, by merge joins."""
        out = runs[0]
        for r in runs[1:]:
            r = r.select("h1", "h2", F.col("n_docs").alias("n2"), F.col("keeper").alias("k2"))
            both = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            out = out.join(r, ["h1", "h2"], "full").select("h1", "h2", both.alias("n_docs"), F.greatest("keeper", "k2").alias("keeper"))
        return out


def _rebuild(schema: T.StructType, min_chars: int):
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    at = schema.names.index("text")

    def run(batches):
        for batch in slices(batches):
            drops = batch.column(batch.schema.get_field_index("__drops")).to_pylist()
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist(), drops):
                if not drop:
                    n_lines.append(1 if text is None else text.count(b"\n") + 1)
                    n_dropped.append(0)
                    texts.append(text)
                    continue
                lines, bad = text.split(b"\n"), set(drop)
                kept = [x for x in lines if len(x) < min_chars or (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in bad]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = [batch.column(batch.schema.get_field_index(f.name)) if f.name not in ("text", "n_lines", "n_dropped") else None for f in want]
            cols[at] = pa.array(texts, pa.binary()).cast(want.field(at).type)
            cols[-2], cols[-1] = pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())
            yield pa.RecordBatch.from_arrays(cols, schema=want)

    return run


def line_dedup(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, runs: str | None = None) -> DataFrame:
    """``docs`` with ``text`` rebuilt without repeated lines, plus ``n_lines`` and ``n_dropped``.

    A key found in at least ``min_docs`` documents keeps its lines only in the largest doc_id that
    holds it. Null or empty text is one empty line and stays as it is. Rows without doc_id neither
    count nor lose lines; rows that repeat a doc_id count as one document and are treated alike.
    Columns named n_lines or n_dropped in the input are replaced; others pass through. Keys are compared by 128-bit
    hashes. An empty table gives an empty result.

    ``runs`` names a folder whose runs these documents are added to: the documents of earlier calls
    then count, and may keep a line, too. Without it the runs go with the call.
    """
    prepare(spark)
    docs = docs.drop("n_lines", "n_dropped")
    with Scratch(spark) as scratch:
        lines = scratch.table(docs.select("doc_id", "text").mapInArrow(trimmed(_key_rows(min_chars)), "doc_id long, h1 long, h2 long"))
        cuts = sorted(set(lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
        kept = LineRuns(spark, runs or scratch.path(), fanout, min_docs)
        bounds = [None, *cuts, None]
        for high, low in zip(bounds[:-1], bounds[1:]):  # larger ids first: what they settle falls out of later batches
            part = lines
            if high is not None:
                part = part.where(F.col("doc_id") < int(high))
            if low is not None:
                part = part.where(F.col("doc_id") >= int(low))
            kept.add(part)
        # a table of its own, so that Spark can split a very common line's share of the join
        frequent = scratch.table(kept.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"))
        kept.close()
        drops = lines.join(frequent, ["h1", "h2"]).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("d"))
        drops = scratch.keep(drops.select(F.col("doc_id").alias("__id"), "d"))
    digest = F.transform("d", lambda x: F.concat(*(_little_endian(x[c]) for c in ("h1", "h2"))))
    joined = docs.join(drops.select("__id", digest.alias("__drops")), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(trimmed(_rebuild(schema, min_chars)), schema)


def _little_endian(col):
    h = F.lpad(F.hex(col), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2))))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(spark, docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT doc_id, line, pos,
  translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.line, k.pos, (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
