"""Descriptor distances, nearest neighbours with a ratio test, one-to-one matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hamming(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def euclidean(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, v: s + v))


def nearest_with_ratio(a: DataFrame, b: DataFrame, ratio: float = 0.75, method: str = "sift") -> DataFrame:
    """``a(pair_id, a_id, d)`` against ``b(pair_id, b_id, d)``: each descriptor's nearest within its pair of images, kept where it is nearer than
    ``ratio`` times the second nearest or the only one. Ties go to the smaller id. Pairs meet on pair_id; an image has at most a few hundred keypoints. The two best are an aggregate, so no
    descriptor's candidates are sorted."""
    distance = hamming if method == "orb" else euclidean
    d = a.join(b.withColumnRenamed("d", "e"), "pair_id").select("pair_id", "a_id", "b_id", distance(F.col("d"), F.col("e")).alias("distance"))
    best = d.groupBy("pair_id", "a_id").agg(F.min(F.struct("distance", "b_id")).alias("b"), F.count("*").alias("n"), F.min_by("b_id", F.struct("distance", "b_id")).alias("__b"))
    second = d.join(best.select("pair_id", "a_id", "__b"), ["pair_id", "a_id"]).where("b_id <> __b").groupBy("pair_id", "a_id").agg(F.min("distance").alias("second"))
    out = best.join(second, ["pair_id", "a_id"], "left").select("pair_id", "a_id", "b.b_id", "b.distance", "second")
    return out.where(F.col("second").isNull() | (F.col("distance") < F.col("second") * ratio)).drop("second")


def one_to_one(matches: DataFrame, most: int = 40) -> DataFrame:
    """Greedy by distance: since every a occurs once, the first claim on each b is what the greedy pass keeps."""
    first = Window.partitionBy("pair_id", "b_id").orderBy("distance", "a_id")
    kept = matches.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("distance", "a_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= max(1, most)).withColumn("distance", F.round("distance", 3))
