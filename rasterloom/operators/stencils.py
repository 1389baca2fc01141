"""Operators over a pixel's neighbourhood, as windows along rows and columns.

One exchange by image serves both directions: partitioning by image satisfies windows by (image, y)
and by (image, x). Three-by-three kernels copy the image's border pixels, as 8-bit filters do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import BANDS, blend, clip, luma



def along_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("image_id", "x").orderBy("y")



SOBEL = ((-1, 0, 1, -2, 0, 2, -1, 0, 1), (-1, -2, -1, 0, 0, 0, 1, 2, 1))
PREWITT = ((-1, 0, 1, -1, 0, 1, -1, 0, 1), (-1, -1, -1, 0, 0, 0, 1, 1, 1))
LAPLACIAN = (0, 1, 0, 1, -4, 1, 0, 1, 0)
FIND_EDGES = (-1, -1, -1, -1, 8, -1, -1, -1, -1)
EMBOSS = (-1, 0, 0, 0, 1, 0, 0, 0, 0)


def by_image(px: DataFrame) -> DataFrame:
    return px.repartition("image_id")


def neighbours(px: DataFrame, value: str) -> DataFrame:
    """Adds ``__n``: the nine values around, rows from below upwards, each from left to right; null where one lies outside."""
    rows = px.withColumns({"__w": F.lag(value).over(along_row()), "__e": F.lead(value).over(along_row())})
    around = F.struct(F.col("__w").alias("w"), F.col(value).alias("c"), F.col("__e").alias("e"))
    rows = rows.withColumn("__row", around).drop("__w", "__e")
    rows = rows.withColumns({"__up": F.lag("__row").over(along_column()), "__down": F.lead("__row").over(along_column())})
    cells = [F.col(f"{r}.{c}") for r in ("__down", "__row", "__up") for c in "wce"]
    return rows.withColumn("__n", F.array(*cells)).drop("__row", "__up", "__down")


def kernel(value: str, weights, offset: int = 0):
    """A kernel over ``__n``, 8-bit clipped; border pixels keep their value."""
    total = F.lit(offset)
    for i, w in enumerate(weights):
        if w:
            total = total + F.element_at("__n", i + 1) * F.lit(w)
    border = F.exists("__n", lambda v: v.isNull())
    return F.when(border, F.col(value)).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), total))).cast("int")


def magnitude(px: DataFrame, method: str = "sobel", value: str = "v", out: str = "mag") -> DataFrame:
    """Gradient magnitude of a gray column. Components are held to -128..127 by their 8-bit offset form."""
    px = neighbours(px, value)
    if method == "laplacian":
        m = F.least(F.lit(255), F.abs(kernel(value, LAPLACIAN, 128) - 128) * 3)
    elif method == "find":
        m = kernel(value, FIND_EDGES)
    else:
        gx, gy = (kernel(value, k, 128) - 128 for k in (SOBEL if method == "sobel" else PREWITT))
        m = F.least(F.lit(255), F.floor(F.sqrt((gx * gx + gy * gy).cast("double"))).cast("int"))
    return px.withColumn(out, m.cast("int")).drop("__n")


def orientation(px: DataFrame, value: str = "v", out: str = "theta") -> DataFrame:
    px = neighbours(px, value)
    gx, gy = (kernel(value, k, 128) - 128 for k in SOBEL)
    # rows run from below upwards, so the vertical component turns its sign
    return px.withColumn(out, F.atan2((-gy).cast("double"), gx.cast("double"))).drop("__n")


def edges(px: DataFrame, method: str = "sobel", strength: float = 50) -> DataFrame:
    """The magnitude with its contrast set by the strength, half and half with the gray image."""
    s = strength / 100
    g = magnitude(by_image(px).withColumn("v", luma()), method)
    if s < 0.999:
        mean = F.floor(F.avg("mag").over(Window.partitionBy("image_id")) + 0.5).cast("int")
        g = g.withColumn("__m", mean).withColumn("mag", blend(F.col("__m"), F.col("mag"), 0.4 + s * 1.6)).drop("__m")
    return g.withColumn("__e", blend(F.col("v"), F.col("mag"), 0.5)).withColumns({c: F.col("__e") for c in BANDS}).drop("__e", "v", "mag")


def convolve(px: DataFrame, weights, offset: int = 0) -> DataFrame:
    """A 3 by 3 kernel on every band."""
    px = by_image(px)
    for c in BANDS:
        px = neighbours(px, c)
        px = px.withColumn(c, kernel(c, weights, offset)).drop("__n")
    return px


def emboss(px: DataFrame, strength: float = 40) -> DataFrame:
    from .points import contrast_factor

    return contrast_factor(convolve(px, EMBOSS, 128), 0.5 + strength / 100)


def _box(px: DataFrame, value: str, radius: int, window, place: str, out: str) -> DataFrame:
    """Mean over 2r + 1 values along one direction, the image's edge value standing for what lies outside; rounded."""
    span = window.rowsBetween(-radius, radius)
    part = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(place).over(part)
    before, after = F.greatest(F.lit(0), F.lit(radius) - F.col(place)), F.greatest(F.lit(0), F.col(place) + radius - last)
    total = F.sum(value).over(span) + before * F.first(value).over(part) + after * F.last(value).over(part)
    return px.withColumn(out, F.floor(total / F.lit(2.0 * radius + 1) + 0.5).cast("int"))


def box_mean(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    return _box(_box(px, value, radius, along_row(), "x", "__row"), "__row", radius, along_column(), "y", out).drop("__row")


def box_blur(px: DataFrame, radius: int = 2) -> DataFrame:
    px = by_image(px)
    for c in BANDS:
        px = box_mean(px, c, int(radius), "__b").drop(c).withColumnRenamed("__b", c)
    return px.select("image_id", "y", "x", *BANDS)


def local_maxima(px: DataFrame, value: str = "mag", radius: int = 3, least: int = 40) -> DataFrame:
    """Rows whose value no neighbour within ``radius`` exceeds (plateaus stay), outside a margin of ``radius``; ranked by value, then raster order."""
    whole = Window.partitionBy("image_id")
    rows = px.withColumn("__m", F.max(value).over(along_row().rowsBetween(-radius, radius)))
    rows = rows.withColumn("__m", F.max("__m").over(along_column().rowsBetween(-radius, radius)))
    rows = rows.withColumns({"__w": F.max("x").over(whole), "__h": F.max("y").over(whole)})
    inside = (F.col("x") >= radius) & (F.col("y") >= radius) & (F.col("x") <= F.col("__w") - radius) & (F.col("y") <= F.col("__h") - radius)
    found = rows.where(inside & (F.col(value) >= least) & (F.col(value) == F.col("__m"))).drop("__m", "__w", "__h")
    return found.withColumn("rank", F.row_number().over(whole.orderBy(F.desc(value), "y", "x")))


def keypoints(px: DataFrame, max_points: int = 120) -> DataFrame:
    """(image_id, x, y, size, angle, response): the strongest local maxima of the Sobel magnitude, with the
    direction of the summed central differences of the magnitude within 6 pixels: window sums along rows, then columns."""
    m = magnitude(by_image(px).withColumn("v", luma()).select("image_id", "y", "x", "v"), "sobel")
    whole = Window.partitionBy("image_id")
    m = m.withColumns({"__w": F.max("x").over(whole), "__h": F.max("y").over(whole)})
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("__w")) & (F.col("y") < F.col("__h"))
    m = m.withColumns({"__gx": F.when(inner, F.lead("mag").over(along_row()) - F.lag("mag").over(along_row())).otherwise(0), "__gy": F.when(inner, F.lead("mag").over(along_column()) - F.lag("mag").over(along_column())).otherwise(0)})
    for c in ("__gx", "__gy"):
        m = m.withColumn(c, F.sum(c).over(along_row().rowsBetween(-6, 6)))
        m = m.withColumn(c, F.sum(c).over(along_column().rowsBetween(-6, 6)))
    top = local_maxima(m.drop("__w", "__h")).where(F.col("rank") <= max_points)
    return top.select("image_id", "x", "y", F.lit(4.0).alias("size"), F.atan2(F.col("__gy").cast("double"), F.col("__gx").cast("double")).alias("angle"), F.col("mag").alias("response"))
