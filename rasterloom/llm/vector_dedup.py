"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Every vector has a home cell, that of its nearest centroid. Unit vectors with a cosine of at least
``c`` are at most ``r = sqrt(2 - 2c)`` apart. Where two such have different homes, the plane between
the centroids lies between them, so one of them is within ``r / 2`` of it: that one is a guest in the
other's cell. Comparing a cell's residents with its residents and guests therefore finds every link.
Both are dealt into blocks of bounded size, so a cell of any size is many small matrix products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, hash_sample, prepare

#: Labelled vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Vectors per cell that the number of cells aims at, the most cells, vectors per block, and vectors that are placed at once.
CELL, MOST_CELLS, BLOCK, PLACE = 2_000, 4_096, 1_024, 1_024


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Spherical k-means; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        for i in range(k):
            s = x[home == i].sum(0)
            if norm := np.linalg.norm(s):
                c[i] = s / norm
    return c


def unit_rows(column) -> np.ndarray:
    x = np.array([np.frombuffer(v, np.float64) for v in column])
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(embedding):
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(embedding).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))



def _compare(cosine: float):
    def run(key, homes: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """Links of each home in this block, and edges that span what is linked here (a forest, not all pairs)."""
        if not len(homes) or not len(others):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        near = unit_rows(homes["v"]) @ unit_rows(others["v"]).T >= cosine
        h, o = homes["id"].to_numpy(), others["id"].to_numpy()
        near &= h[:, None] != o[None, :]
        links = near @ others["n"].to_numpy(np.int64)
        # a guest here counts the links that its home cell doesn't see: those to vectors that are no guests there
        back, cell = np.zeros(len(o), np.int64), key[2]
        weight, at = homes["n"].to_numpy(np.int64), others["at"].to_numpy()
        linked = near.any(0)
        for c in np.unique(at[linked & (at != cell)]):
            cols = np.flatnonzero(linked & (at == c))
            unseen = np.array([c not in g for g in homes["guest_of"]])
            back[cols] = (near[:, cols] & unseen[:, None]).T @ weight
        # label the two-sided graph of this block by its smallest reachable id
        low_h, low_o = h.copy(), o.copy()
        rows, cols = np.nonzero(near)
        while len(rows):
            was = low_h.copy(), low_o.copy()
            np.minimum.at(low_o, cols, low_h[rows])
            np.minimum.at(low_h, rows, low_o[cols])
            if (was[0] == low_h).all() and (was[1] == low_o).all():
                break
        keep, also = near.any(1), near.any(0)
        return pd.DataFrame({"id": np.concatenate([h[keep], o[also]]), "links": np.concatenate([links[keep], back[also]]), "root": np.concatenate([low_h[keep], low_o[also]])})

    return run


def vector_dedup(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, seed: int = 42) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine in double precision is
    at least ``cosine``. n_links counts the other rows linked directly; component_id is the smallest
    vec_id reachable by links, itself included; kept says whether that is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, and
    neither do vectors of another length. Equal vectors of a label are compared once, as one node
    that counts for all its rows. Rows that repeat a vec_id are rows of their own. A row without vec_id
    links by its vector and has a null component only where nothing it reaches has an id; then kept is true.
    An empty table gives an empty result; other columns are left out.

    The centroids are fitted on at most SAMPLE vectors; their number grows with the table up to
    MOST_CELLS, beyond which cells grow and blocks with their square. Fewer cells or a poor fit only
    make blocks more numerous, never lose a link.
    """
    prepare(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    rows = rows.withColumn("ok", valid("e") & F.col("label").isNotNull())
    # -0.0 and 0.0 are equal components
    rows = rows.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    # by the vector itself; 128 bits of hash name it
    rows = rows.withColumns({"k1": F.xxhash64("label", "e"), "k2": F.xxhash64(F.lit(1), "label", "e")})
    with Scratch(spark) as scratch:
        thin = scratch.table(rows.select("vec_id", "ok", "k1", "k2"))
        nodes = rows.where("ok").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.count("*").alias("n"), F.min("vec_id").alias("low"))
        nodes = nodes.select(F.xxhash64("k1", "k2").alias("id"), "k1", "k2", "label", F.size("e").alias("d"), "e", "n", "low")
        nodes = scratch.table(nodes)
        total = nodes.count()
        if total:
            lengths = nodes.groupBy("d").agg(F.count("*").alias("of_d"))
            large = {r["d"]: r["of_d"] for r in lengths.where(F.col("of_d") > CELL).collect()}  # at most total / CELL rows
            placed = [_place(scratch, nodes.where(F.col("d") == d), d, count, cosine, seed) for d, count in sorted(large.items())]
            if sum(large.values()) < total:  # all lengths of one cell each together
                rest = nodes.join(lengths.where(F.col("of_d") <= CELL), "d")
                placed.append(scratch.table(rest.select("id", "e", F.col("label").cast("string").alias("label"), "n", "d").mapInArrow(_one_cell, PLACED)))
            edges = scratch.table(_block_links(placed, cosine))
        else:
            edges = spark.createDataFrame([], "id long, links long, root long")
        labels = components(spark, edges.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
        links = edges.groupBy("id").agg(F.sum("links").alias("links"))
        named = nodes.select("id", "k1", "k2", "n", "low").join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id"))
        least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
        named = named.join(least, "comp").join(links, "id", "left").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        out = thin.join(named.withColumn("ok", F.lit(True)), ["k1", "k2", "ok"], "left")
        component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        return scratch.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


PLACED = "id long, label string, n long, v binary, cell int, at int, guest_of array<int>, d int"
NAMES = ["id", "label", "n", "v", "cell", "at", "guest_of", "d"]


def _one_cell(batches):
    """Vectors of any length, each at home in cell 0."""
    for b in batches:
        raw = [np.array(x, np.float64).tobytes() for x in b.column(1).to_pylist()]
        zero = pa.array(np.zeros(len(raw), np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(raw, pa.binary()), zero, zero, pa.array([[]] * len(raw), pa.list_(pa.int32())), b.column(4)], NAMES)


def _place(scratch, nodes: DataFrame, dim: int, total: int, cosine: float, seed: int) -> DataFrame:
    """The ``total`` nodes of length ``dim`` in their cells."""
    k = int(min(MOST_CELLS, max(1, -(-total // CELL))))
    sample = np.array([r["e"] for r in hash_sample(nodes, total, SAMPLE, seed, "id").select("e").collect()])
    sample = sample / np.abs(sample).max(1, keepdims=True)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    k = min(k, len(sample))
    c = fit_centroids(sample, k, seed=seed)
    reach = float(np.sqrt(2 - 2 * cosine)) / 2 + 1e-9
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)

    def assign(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, PLACE):
                b = whole.slice(start, PLACE)
                e = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, dim)
                raw = [x.tobytes() for x in e]
                x = e / np.abs(e).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                dots, all_ = x @ c.T, np.arange(len(x))
                home = dots.argmax(1)
                cells = dots[all_, home][:, None] - dots <= reach * apart[home]
                cells[all_, home] = False
                guest_of = [np.flatnonzero(g).astype(np.int32) for g in cells]
                cells[all_, home] = True
                row, cell = np.nonzero(cells)
                at, own = pa.array(row), cell == home[row]
                lists = pa.array([guest_of[i] if mine else [] for i, mine in zip(row, own)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), b.column(3).take(at), pa.array(raw, pa.binary()).take(at), pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), lists, b.column(4).take(at)], NAMES)

    return scratch.table(nodes.select("id", "e", F.col("label").cast("string").alias("label"), "n", "d").mapInArrow(assign, PLACED))


def _block_links(parts: list[DataFrame], cosine: float) -> DataFrame:
    placed = parts[0]
    for more in parts[1:]:
        placed = placed.unionByName(more)
    sizes = placed.groupBy("d", "label", "cell").agg(F.count("*").alias("all"), F.count_if(F.col("cell") == F.col("at")).alias("own"))
    blocks = lambda col: F.ceil(F.col(col) / BLOCK).cast("int")
    placed = placed.join(sizes, ["d", "label", "cell"]).withColumns({"hb": blocks("own"), "ob": blocks("all"), "h": F.xxhash64(F.lit(9), "id")}).where("hb > 0")
    homes = placed.where("cell = at").select("d", "label", "cell", F.pmod("h", "hb").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("b"), "id", "v", "n", "guest_of")
    others = placed.select("d", "label", "cell", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("a"), F.pmod("h", "ob").cast("int").alias("b"), "id", "v", "n", "at")
    others = others.select(*(F.col(c).alias(c) for c in others.columns))  # names of their own: both sides come from one table
    keys = ["d", "label", "cell", "a", "b"]
    return homes.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(_compare(cosine), "id long, links long, root long")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP7_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
