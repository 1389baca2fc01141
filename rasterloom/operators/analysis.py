"""Histograms and what follows from them, diffs, components, detection and segmentation stages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.pixels import BANDS, color_name, luma
from ..sources.rasters import PACKED, image_array


def per_image():
    return Window.partitionBy("image_id")


def histogram(gray: DataFrame, value: str = "v") -> DataFrame:
    return gray.groupBy("image_id", F.col(value).alias("v")).agg(F.count("*").alias("n"))


def channel_stats(px: DataFrame) -> DataFrame:
    """Mean and population standard deviation of every band."""
    return px.groupBy("image_id").agg(*(F.avg(c).alias(f"mean_{c}") for c in BANDS), *(F.stddev_pop(c).alias(f"std_{c}") for c in BANDS))


def otsu(gray: DataFrame, value: str = "v") -> DataFrame:
    """Per image the first cut of the largest between-class variance, 127 where there is only one value.

    Pixels are combined to at most 256 rows per image before anything is ordered.
    """
    hist = histogram(gray, value)
    run = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.select("image_id", "v", F.sum("n").over(run).alias("wb"), F.sum(F.col("n") * F.col("v")).over(run).alias("sb"), F.sum("n").over(per_image()).alias("w"), F.sum(F.col("n") * F.col("v")).over(per_image()).alias("s"))
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    scored = h.where(F.col("w") > F.col("wb")).select("image_id", "v", (F.col("wb").cast("double") * wf * gap * gap).alias("var"))
    best = scored.groupBy("image_id").agg(F.max_by("v", F.struct("var", (-F.col("v")).alias("low"))).alias("t"))
    return hist.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce("t", F.lit(127)).cast("int").alias("t"))


def threshold_coverage(px: DataFrame) -> DataFrame:
    """Gray, Otsu's threshold, and the share of the image at or above it."""
    hist = px.select("image_id", luma().alias("v"))
    cut = otsu(hist)
    counts = histogram(hist).join(cut, "image_id")
    return counts.groupBy("image_id", "t").agg(F.sum("n").alias("pixels"), F.sum(F.when(F.col("v") >= F.col("t"), F.col("n")).otherwise(0)).alias("foreground")).withColumn("coverage", F.round(F.col("foreground") / F.col("pixels"), 4))


def diff_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of images of equal sizes; :func:`aligned` makes them so. ``mse`` is the mean absolute gray difference, as the metric is defined here; ``mse_true`` its square's mean."""
    other = b.select("image_id", "y", "x", *(F.col(c).alias(f"__{c}") for c in BANDS))
    return paired_metrics(a.join(other.hint("merge"), ["image_id", "y", "x"]))


def paired_metrics(pairs: DataFrame) -> DataFrame:
    """:func:`diff_metrics` of pixels with both values in a row, ``r, g, b`` and ``__r, __g, __b``: for an image and what a point operator makes of it no join is needed."""
    d = pairs.withColumns({c: F.abs(F.col(c) - F.col(f"__{c}")) for c in BANDS})
    m = d.select("image_id", luma().alias("d")).groupBy("image_id").agg(F.avg("d").alias("m"), F.avg(F.col("d") * F.col("d")).alias("sq"), F.avg((F.col("d") > 8).cast("double")).alias("changed"))
    rmse = F.sqrt("m")
    psnr = F.when(F.col("m") < 1e-9, F.lit(100.0)).otherwise(F.lit(20.0) * F.log10(F.lit(255.0) / F.greatest(rmse, F.lit(1e-6))))
    return m.select("image_id", F.round("m", 2).alias("mse"), F.round(rmse, 2).alias("rmse"), F.round(psnr, 2).alias("psnr"), F.round("changed", 4).alias("changed_ratio"), F.round("sq", 2).alias("mse_true"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Packed images ``a`` scaled to the sizes of the packed images ``b`` of the same ids, by Lanczos. Images without a counterpart fall out."""
    both = a.join(b.select("image_id", F.col("w").alias("to_w"), F.col("h").alias("to_h")), "image_id")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                out = kernels.resample(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 3), r.to_w, r.to_h, "lanczos")
                yield pd.DataFrame({"image_id": [r.image_id], "w": [r.to_w], "h": [r.to_h], "data": [np.ascontiguousarray(out, np.uint8).tobytes()]})

    return both.mapInPandas(run, PACKED)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("image_id", "y", "x", *(F.col(c).alias(f"__{c}") for c in BANDS))
    return a.join(other, ["image_id", "y", "x"]).withColumns({c: F.abs(F.col(c) - F.col(f"__{c}")) for c in BANDS}).drop(*(f"__{c}" for c in BANDS))


def saliency_color(px: DataFrame) -> DataFrame:
    """8-bit HSV saturation as the map ``v``."""
    top, low = F.greatest(*BANDS), F.least(*BANDS)
    return px.withColumn("v", F.when(top == 0, 0).otherwise(F.floor((top - low) * 255 / top)).cast("int"))


def connected_components(gray: DataFrame, threshold: int | None = None, value: str = "v") -> DataFrame:
    """(image_id, y, x, label): 4-connected regions of values at or above the threshold (a column ``t`` where None), numbered from 1 in raster order of their first pixel. One image is one group; its size is bounded by the working size."""
    cut = F.col("t") if threshold is None else F.lit(threshold)
    on = gray.select("image_id", "y", "x", (F.col(value) >= cut).alias("on"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), bool)
        grid[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["on"].to_numpy()
        labels = kernels.label_components(grid)
        y, x = np.nonzero(labels)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y.astype(np.int32), "x": x.astype(np.int32), "label": labels[y, x].astype(np.int32)})

    return on.groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, label int")


def boxes(labels: DataFrame) -> DataFrame:
    """Inclusive bounding boxes and areas."""
    return labels.groupBy("image_id", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"))


MEASURED = "image_id long, label int, area long, x0 int, y0 int, x1 int, y1 int, total long, w int, h int, t int, " + ", ".join(f"{k}_{c} int" for k in ("in", "to") for c in BANDS)


def measured_regions(px: DataFrame, threshold: int | None = None, value: str = "v") -> DataFrame:
    """One row per 4-connected region of ``px(image_id, y, x, r, g, b, v)`` at or above the threshold (Otsu's where None):
    area, inclusive box, the sum of its values, the image's size, the threshold, and the box's mean color with its last
    row and column (``in_``) and without (``to_``, null where nothing is left). Labels and measures come from one pass over an image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.int64)
        v[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[value].to_numpy()
        a = image_array(pdf)
        cut = kernels.otsu(v) if threshold is None else int(threshold)
        m = kernels.measured(kernels.label_components(v >= cut), v)
        n, rows = len(m["area"]), []
        for x0, y0, x1, y1 in zip(m["x0"], m["y0"], m["x1"], m["y1"]):
            rows.append([*kernels.box_color(a[y0 : y1 + 1, x0 : x1 + 1]), *(kernels.box_color(a[y0:y1, x0:x1]) if x1 > x0 and y1 > y0 else [None] * 3)])
        colors = pd.DataFrame(rows, columns=[f"{k}_{c}" for k in ("in", "to") for c in BANDS], dtype="Int32")
        first = {"image_id": np.full(n, pdf["image_id"].iloc[0]), "label": np.arange(1, n + 1), **{c: m[c] for c in ("area", "x0", "y0", "x1", "y1")}, "total": m["sum"], "w": np.full(n, v.shape[1]), "h": np.full(n, v.shape[0]), "t": np.full(n, cut)}
        return pd.concat([pd.DataFrame(first), colors], axis=1)

    return px.groupBy("image_id").applyInPandas(run, MEASURED)


def region_stats(regions: DataFrame) -> DataFrame:
    """:func:`measured_regions` by falling area: coverage, box [x, y, w, h] (as wide as its last place is from its first), mean color of the box."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "label"))
    whole = F.col("w") * F.col("h")
    return regions.select("image_id", rank.alias("id"), "label", "area", F.round(F.col("area") / whole, 4).alias("coverage"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), *(F.col(f"in_{c}").alias(f"mean_{c}") for c in BANDS))


def iou(a: str = "a", b: str = "b"):
    """Of two structs (x, y, w, h)."""
    side = lambda p, n: F.greatest(F.lit(0), F.least(F.col(f"{a}.{p}") + F.col(f"{a}.{n}"), F.col(f"{b}.{p}") + F.col(f"{b}.{n}")) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}")))
    both = side("x", "w") * side("y", "h")
    return F.when(both <= 0, F.lit(0.0)).otherwise(both / (F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - both))


def nms(candidates: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression of (image_id, score, x, y, w, h): by falling score, kept where the IoU with all kept so far is below ``overlap``. A fold over one sorted array per image."""
    box = F.struct((-F.col("score")).alias("low"), F.col("label"), "x", "y", "w", "h")
    sorted_ = candidates.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("c"))

    def overlap_of(p, q):
        side = lambda s, n: F.greatest(F.lit(0), F.least(p[s] + p[n], q[s] + q[n]) - F.greatest(p[s], q[s]))
        both = side("x", "w") * side("y", "h")
        return F.when(both <= 0, F.lit(0.0)).otherwise(both / (p["w"] * p["h"] + q["w"] * q["h"] - both))

    kept = F.aggregate("c", F.slice("c", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: overlap_of(k, b) >= overlap), acc).otherwise(F.array_append(acc, b)))
    out = sorted_.select("image_id", F.posexplode(kept).alias("rank", "k"))
    return out.select("image_id", (F.col("rank") + 1).alias("rank"), F.col("k.label").alias("label"), (-F.col("k.low")).alias("score"), "k.x", "k.y", "k.w", "k.h")


def detect(regions: DataFrame, ratio: float = 1.0, min_size: float = 0.02, max_boxes: int = 20, overlap: float = 0.5) -> DataFrame:
    """Boxes of :func:`measured_regions` of a saliency map: those of enough box area, scored by mean saliency, suppressed, the best
    ``max_boxes``, scores as shares of the best, with the name of their mean color, on coordinates ``ratio`` times the map's."""
    found = regions.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= F.col("w") * F.col("h") * (min_size * min_size * 0.25))
    colors = found.select("image_id", "label", F.col("t").alias("threshold_used"), *(F.col(f"to_{c}").alias(c) for c in BANDS))
    found = found.select("image_id", "label", (F.col("total") / F.col("area")).alias("score"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    kept = nms(found, overlap).where(F.col("rank") <= max_boxes)
    best = F.max("score").over(per_image())
    share = F.least(F.lit(1.0), F.col("score") / F.when(best == 0, F.lit(1.0)).otherwise(best))
    out = kept.withColumn("score", F.round(share, 3)).join(colors, ["image_id", "label"]).withColumn("name", color_name())
    scaled = (F.bround(F.col(c) * F.lit(float(ratio)), 0).cast("int").alias(c) for c in "xywh")
    return out.select("image_id", "rank", *scaled, "score", F.col("name").alias("label"), *(F.col(c).alias(f"mean_{c}") for c in BANDS), "threshold_used")
