"""Approximate nearest neighbours by shifted space-filling curves.

Several orderings: each projects the vectors on its own few random directions, shifts them and sorts them
by their place on a Hilbert curve. All orderings together are one table, range-partitioned on
(ordering, key) in Spark and sorted; a query looks at a window of the rows next to it in every ordering,
across the ends of partitions, too. Windows rank their rows by short codes of the vectors; what they
find is merged, and the best are ranked by the exact distance of the original vectors.

How many orderings a table needs is measured on the table itself: probes' true neighbours are found by a
scan, their distances in rank by counting keys, and the orderings go on until the windows would
have caught the wanted share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, prepare, trimmed
from .vector_dedup import valid

#: Vectors that the curves' value ranges are fitted on, at most, and probes that the orderings are fitted with.
SAMPLE, PROBES = 8_192, 96
#: Orderings at most, projected dimensions, and bits of each on the curve.
ORDERINGS, PLANES, BITS = 64, 12, 5
#: Rows of a window. The next is taken where ORDERINGS windows would not do; the last also where they don't either.
WINDOWS = (256, 512, 1_024, 2_048, 4_096, 8_192, 16_384, 32_768)
#: Rows of all orderings that a partition aims at, and windows that it holds at least.
PART_ROWS, PART_WINDOWS = 100_000, 4
#: Vectors of a length so rare are compared in one block; the commonest length goes by curves in any case.
SMALL = 2_048
#: Bytes of a code.
CODE = 64


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve (int64) of integer points (n, dims), each coordinate of ``bits`` bits: Skilling's transform, then the bits interleaved."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def sane(x: np.ndarray) -> np.ndarray:
    """Within what squares and sums can hold. Keys and codes only propose; distances are of the originals."""
    return np.clip(x, -1e150, 1e150)


class Curves:
    """The orderings: projections, shifts and value ranges, fitted on a sample; and the directions of the codes."""

    def __init__(self, sample: np.ndarray, orderings: int, seed: int):
        d = sample.shape[1]
        self.axes, self.low, self.span = [], [], []
        for o in range(orderings):
            rng = np.random.default_rng([seed, o])
            q, _ = np.linalg.qr(rng.standard_normal((d, min(PLANES, d))))
            p = sane(sample) @ q
            low, high = p.min(0), p.max(0)
            span = np.where(high > low, high - low, 1.0)
            shift = rng.random(p.shape[1]) * 0.5
            self.axes.append(q), self.low.append(low - shift * span), self.span.append(1.5 * span)
        self.short = np.random.default_rng([seed, -1 % 2**32]).standard_normal((d, CODE)) / np.sqrt(CODE) if d > CODE else None

    def keys(self, x: np.ndarray, o: int) -> np.ndarray:
        """Values beyond the sample's range go to its ends."""
        cell = np.clip((sane(x) @ self.axes[o] - self.low[o]) / self.span[o] * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert(cell.astype(np.int64), BITS)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector its direction in bytes, their unit and its squared length: of itself, or of its projection on CODE random directions."""
        y = sane(x) if self.short is None else sane(x) @ self.short
        unit = np.abs(y).max(1) / 127
        unit[unit == 0] = 1.0
        return np.rint(y / unit[:, None]).astype(np.int8), unit, (y**2).sum(1)


def _rows(batch, at: int) -> np.ndarray:
    column = batch.column(at)
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _true_neighbours(probes: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` nearest rows of each probe in a partition, but itself."""

    def run(batches):
        best = [[] for _ in probes]
        for b in batches:
            if not b.num_rows:
                continue
            own, x = b.column(0).to_numpy(), sane(_rows(b, 1))
            far = (x**2).sum(1)[None] - 2 * probes @ x.T
            far[ids[:, None] == own[None]] = np.inf
            near = np.argpartition(far, min(k, len(x)) - 1, 1)[:, :k]
            for i, at in enumerate(near):
                best[i] = sorted([*best[i], *((far[i, j], own[j], x[j]) for j in at if far[i, j] < np.inf)], key=lambda t: t[:2])[:k]
        out = [(i, *t) for i, ts in enumerate(best) for t in ts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t[0] for t in out], pa.int32()), pa.array([t[1] for t in out], pa.float64()), pa.array([t[2] for t in out], pa.int64()), pa.array([t[3].tobytes() for t in out], pa.binary())],
            ["probe", "far", "id", "v"])

    return run


def _count_keys(curves: Curves, ends: list[np.ndarray]):
    """How many keys of each ordering lie before, on and between these."""

    def run(batches):
        counts = [np.zeros(2 * len(e) + 1, np.int64) for e in ends]
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b, 1)
            for o, e in enumerate(ends):
                key = curves.keys(x, o)
                left = np.searchsorted(e, key)
                on = e[np.minimum(left, len(e) - 1)] == key
                counts[o] += np.bincount(2 * left + on, minlength=2 * len(e) + 1)
        for o, c in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), o, np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c)], ["o", "slot", "n"])

    return run


def fit(points: DataFrame, n: int, dim: int, k: int, recall: float, seed: int) -> tuple[Curves, int, int, float]:
    """Curves, the number of their orderings to use, the window, and the recall of the probes that these reach."""
    sample = np.array([r["e"] for r in hash_sample(points, n, SAMPLE, seed, "id").select("e").collect()]).reshape(-1, dim)
    curves = Curves(sample, ORDERINGS, seed)
    picked = hash_sample(points, n, PROBES, seed + 1, "id").select("id", "e").collect()
    probes, ids = sane(np.array([r["e"] for r in picked], np.float64)), np.array([r["id"] for r in picked])
    scan = points.select("id", "e").mapInArrow(trimmed(_true_neighbours(probes, ids, k)), "probe int, far double, id long, v binary")
    best = scan.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("far", "id"))).where(F.col("r") <= k).select("probe", "v").collect()  # PROBES * k rows
    if not best:
        return curves, 1, WINDOWS[0], 1.0
    near = np.array([np.frombuffer(r["v"], np.float64) for r in best])
    of = np.array([r["probe"] for r in best])
    pairs, ends = [], []
    for o in range(ORDERINGS):
        a, b = curves.keys(probes, o)[of], curves.keys(near, o)
        pairs.append((np.minimum(a, b), np.maximum(a, b)))
        ends.append(np.unique(np.concatenate(pairs[-1])))
    counts = points.select("id", "e").mapInArrow(trimmed(_count_keys(curves, ends)), "o int, slot int, n long").groupBy("o", "slot").agg(F.sum("n").alias("n")).toPandas()
    apart = np.zeros((ORDERINGS, len(of)))
    for o, e in enumerate(ends):
        c = np.zeros(2 * len(e) + 1)
        rows = counts[counts["o"] == o]
        c[rows["slot"].to_numpy()] = rows["n"].to_numpy()
        upto = np.concatenate([[0], np.cumsum(c)])
        low, high = np.searchsorted(e, pairs[o][0]), np.searchsorted(e, pairs[o][1])
        apart[o] = upto[2 * high + 2] - upto[2 * low + 1] - 1  # as far as rows of equal keys can make it
    for window in WINDOWS:
        caught = np.logical_or.accumulate(apart <= window // 2, 0).mean(1)
        if caught[-1] >= recall or window == WINDOWS[-1]:
            use = int(np.argmax(caught >= recall)) + 1 if caught[-1] >= recall else ORDERINGS
            return curves, use, window, float(caught[use - 1])
    raise AssertionError("unreachable")


ROWS = "o int, key long, id long, asks boolean, code binary, unit double, square double"


def _deal(curves: Curves, orderings: int):
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 4_096):
                b = whole.slice(start, 4_096)
                x = _rows(b, 1)
                code, unit, square = curves.codes(x)
                rest = [b.column(0), b.column(2), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(unit), pa.array(square)]
                for o in range(orderings):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o, np.int32)), pa.array(curves.keys(x, o)), *rest], ["o", "key", "id", "asks", "code", "unit", "square"])

    return run


def _near(code, unit, square, ids, i: int, among: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``among`` the ``most`` nearest to row i by their codes: ids and squared distances."""
    dots = code[among].astype(np.float32) @ code[i].astype(np.float32)
    far = square[among] + square[i] - 2 * unit[i] * unit[among] * dots
    if len(among) > most:
        keep = np.argpartition(far, most - 1)[:most]
        among, far = among[keep], far[keep]
    return ids[among], far


FOUND = "q long, id long, far double, border int, o int, tail boolean, place int, asks boolean, code binary, unit double, square double"


def _windows(half: int, most: int):
    """What a partition's windows find, and its first and last rows, which windows of the partitions beside it reach."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        o, ids, asks = t["o"].to_numpy(), t["id"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        code = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(len(o), -1)
        unit, square = t["unit"].to_numpy(), t["square"].to_numpy()
        q, found, far = [], [], []
        starts = np.append(np.flatnonzero(np.append(True, o[1:] != o[:-1])), len(o))
        for i in np.flatnonzero(asks):
            s = np.searchsorted(starts, i, side="right")
            low, high = max(starts[s - 1], i - half), min(starts[s], i + half + 1)
            among = np.concatenate([np.arange(low, i), np.arange(i + 1, high)])
            if len(among):
                got, d = _near(code, unit, square, ids, i, among, most)
                q.append(np.full(len(got), ids[i])), found.append(got), far.append(d)
        empty = [np.zeros(0, np.int64)]
        q, found, far = np.concatenate(q or empty), np.concatenate(found or empty), np.concatenate(far or empty).astype(np.float64)
        none = lambda kind: pa.nulls(len(q), kind)
        names = ["q", "id", "far", "border", "o", "tail", "place", "asks", "code", "unit", "square"]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(far), none(pa.int32()), none(pa.int32()), none(pa.bool_()), none(pa.int32()), none(pa.bool_()), none(pa.binary()), none(pa.float64()), none(pa.float64())], names)
        last, first = np.arange(max(starts[-2], len(o) - half), len(o))[::-1], np.arange(0, min(starts[1], half))
        for border, tail, at in ((part, True, last), (part - 1, False, first)):
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.array(ids[at]), pa.nulls(m, pa.float64()), pa.array(np.full(m, border, np.int32)), pa.array(o[at]), pa.array(np.full(m, tail)), pa.array(np.arange(m, dtype=np.int32)),
                 pa.array(asks[at]), pa.array([code[j].tobytes() for j in at], pa.binary()), pa.array(unit[at]), pa.array(square[at])], names)

    return run


def _across(half: int, most: int):
    """Windows over the end of a partition, 2 * ``half`` rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, place, tail = rows["id"].to_numpy(), rows["place"].to_numpy(), rows["tail"].to_numpy(bool)
        code = np.array([np.frombuffer(c, np.int8) for c in rows["code"]])
        unit, square, out = rows["unit"].to_numpy(), rows["square"].to_numpy(), []
        for i in np.flatnonzero(rows["asks"].to_numpy(bool)):
            among = np.flatnonzero((tail != tail[i]) & (place + place[i] < half))
            if len(among):
                got, d = _near(code, unit, square, ids, i, among, most)
                out.append(pd.DataFrame({"q": ids[i], "id": got, "far": d}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "far": []}).astype({"q": "int64", "id": "int64", "far": "float64"})

    return run


def _through_curves(scratch: Scratch, points: DataFrame, n: int, dim: int, k: int, recall: float, seed: int, report: dict | None) -> DataFrame:
    """Pairs (q, id) of points of one length that windows found, the best 4 * k of each query by their codes."""
    curves, orderings, window, reached = fit(points, n, dim, k, recall, seed)
    if report is not None:
        report[dim] = {"vectors": n, "orderings": orderings, "window": window, "recall": reached}
    half, most = window // 2, 2 * k
    dealt = scratch.table(points.select("id", "e", "is_query").mapInArrow(trimmed(_deal(curves, orderings)), ROWS))
    parts = max(1, n * orderings // max(PART_ROWS, PART_WINDOWS * window))
    ranged = dealt.repartitionByRange(parts, "o", "key", "id").sortWithinPartitions("o", "key", "id")
    seen = scratch.table(ranged.mapInArrow(trimmed(_windows(half, most)), FOUND))
    scratch.drop(dealt)
    over = seen.where("border IS NOT NULL").groupBy("border", "o").applyInPandas(_across(half, most), "q long, id long, far double")
    found = seen.where("border IS NULL").select("q", "id", "far").unionByName(over).groupBy("q", "id").agg(F.min("far").alias("far"))
    return found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))).where(F.col("r") <= 4 * k).select("q", "id")


def _in_block(points: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a query and another point of a rare length."""
    ids, asks = points["id"].to_numpy(), points["is_query"].to_numpy(bool)
    q, x = np.repeat(ids[asks], len(ids)), np.tile(ids, int(asks.sum()))
    return pd.DataFrame({"q": q[q != x], "id": x[q != x]})


def curve_search(spark: SparkSession, vectors: DataFrame, query_rows, k: int = 10, recall: float = 0.95, seed: int = 42, report: dict | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each query row.

    ``vectors(vec_id, embedding)``; ``query_rows`` is a condition on its columns. Candidates are all
    rows of the query's length but its own; score is the Euclidean distance in double precision, ties go to the
    smaller vec_id, rank starts at 1. Where there are fewer candidates, all are returned. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    without vec_id. Equal vectors are one point that stands for its k + 1 smallest vec_ids, which is
    all that can be asked of it. Rows that repeat a vec_id and vector count once; a vec_id with several
    vectors is a row for each. An empty table gives an empty result; other columns are left out.

    The value ranges are fitted on SAMPLE vectors; every vector is in every ordering. ``recall`` is
    aimed at for PROBES probes. Where even ORDERINGS orderings of the largest window don't reach
    it, they are used as they are. ``report`` gets what was chosen, by length.
    """
    prepare(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), query_rows.alias("is_query"))
    rows = rows.where(valid("e") & F.col("vec_id").isNotNull()).withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    with Scratch(spark) as scratch:
        rows = rows.withColumns({"k1": F.xxhash64("e"), "k2": F.xxhash64(F.lit(1), "e")})
        points = rows.groupBy("k1", "k2").agg(F.first("e").alias("e"), F.min("vec_id").alias("low"), F.max("is_query").alias("is_query"))
        points = scratch.table(points.select(F.xxhash64("k1", "k2").alias("id"), "e", F.size("e").alias("d"), "low", F.coalesce("is_query", F.lit(False)).alias("is_query")))
        thin = rows.select("vec_id", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.xxhash64("k1", "k2").alias("id")).distinct()
        thin = scratch.table(thin)
        lengths = scratch.table(points.groupBy("d").agg(F.count("*").alias("n"), F.count_if("is_query").alias("asked")).where("asked > 0"))
        large = {r["d"]: r["n"] for r in lengths.where(F.col("n") > SMALL).collect()}  # at most one in SMALL vectors has a length of its own here
        large |= {r["d"]: r["n"] for r in lengths.orderBy(F.desc("n"), "d").limit(1).collect()}
        if not large:
            return empty
        pairs = [_through_curves(scratch, points.where(F.col("d") == d), n, d, k + 1, recall, seed, report) for d, n in sorted(large.items())]
        rare = points.join(lengths.where(~F.col("d").isin(list(large))).select("d"), "d").select("d", "id", "is_query")
        pairs.append(rare.groupBy("d").applyInPandas(_in_block, "q long, id long"))
        found = pairs[0]
        for more in pairs[1:]:
            found = found.unionByName(more)
        # the exact distances, of pairs and of each query with itself, where copies of its vector are
        itself = points.where("is_query").select(F.col("id").alias("q"), "id")
        found = scratch.table(found.unionByName(itself))
        scored = found.join(points.select("id", "e", "low"), "id").join(points.where("is_query").select(F.col("id").alias("q"), F.col("e").alias("eq")), "q")
        square = F.aggregate(F.zip_with("e", "eq", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        near = scored.select("q", "id", "low", F.sqrt(square).alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "low"))).where(F.col("r") <= k + 1)
        members = thin.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("id", "vec_id")
        best = near.drop("r").join(members, "id").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
        asks = thin.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
        out = asks.join(best.select("q", "vec_id", "score"), "q").where("query_id <> vec_id")
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
        return scratch.keep(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op3_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return curve_search(spark, vectors, F.col("vec_id") % 100 == 0)
