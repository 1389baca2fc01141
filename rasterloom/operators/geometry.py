"""Operators that move pixels. Pixel relation in, pixel relation out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import BANDS


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def with_size(px: DataFrame) -> DataFrame:
    return px.join(sizes(px), "image_id")


def flip(px: DataFrame, mode: str = "horizontal") -> DataFrame:
    px = with_size(px)
    moved = px.withColumn("y", F.col("h") - 1 - F.col("y")) if mode == "vertical" else px.withColumn("x", F.col("w") - 1 - F.col("x"))
    return moved.select("image_id", "y", "x", *BANDS)


def rotate90(px: DataFrame, quarter_turns: int = 1) -> DataFrame:
    """Counter-clockwise."""
    k = quarter_turns % 4
    px = with_size(px)
    x, y, w, h = (F.col(c) for c in "xywh")
    to = {0: (y, x), 1: (w - 1 - x, y), 2: (h - 1 - y, w - 1 - x), 3: (x, h - 1 - y)}[k]
    return px.select("image_id", to[0].alias("y"), to[1].alias("x"), *BANDS)


def crop(px: DataFrame, left: float = 0, top: float = 0, right: float = 1, bottom: float = 1) -> DataFrame:
    """Fractions of the size, edges rounded half to even; an empty rectangle leaves the image as it is."""
    hold = lambda v: min(1.0, max(0.0, float(v)))
    px = with_size(px)
    edge = lambda side, f: F.bround(F.col(side) * F.lit(hold(f)), 0).cast("int")
    px = px.withColumns({"x0": edge("w", left), "x1": edge("w", right), "y0": edge("h", top), "y1": edge("h", bottom)})
    none = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    shift = lambda c, o: F.when(none, F.col(c)).otherwise(F.col(c) - F.col(o)).alias(c)
    return px.where(none | inside).select("image_id", shift("y", "y0"), shift("x", "x0"), *BANDS)


def border(px: DataFrame, width: int = 10, color: str = "#000000") -> DataFrame:
    """A frame on all sides: pixels shifted, frame pixels generated per image."""
    n, c = int(width), color.lstrip("#")
    c = "".join(2 * d for d in c) if len(c) == 3 else c
    rgb = [int(c[i : i + 2], 16) for i in (0, 2, 4)]
    shifted = px.select("image_id", (F.col("y") + n).alias("y"), (F.col("x") + n).alias("x"), *BANDS)
    if n <= 0:
        return px
    grid = sizes(px).select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") + 2 * n - 1)).alias("y"))
    row_in = (F.col("y") >= n) & (F.col("y") < F.col("h") + n)
    whole = F.sequence(F.lit(0), F.col("w") + 2 * n - 1)
    sides = F.concat(F.sequence(F.lit(0), F.lit(n - 1)), F.sequence(F.col("w") + n, F.col("w") + 2 * n - 1))
    frame = grid.select("image_id", "y", F.explode(F.when(row_in, sides).otherwise(whole)).alias("x"))
    return shifted.unionByName(frame.select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), *(F.lit(v).alias(b) for v, b in zip(rgb, BANDS))))


def resize_dims(size: DataFrame, mode: str = "scale", scale: float = 1.0, width: float = 800, height: float = 600) -> DataFrame:
    """Target ``(new_w, new_h)`` of ``(image_id, w, h)``, the aspect kept, rounded half to even, at least 1."""
    w, h = F.col("w"), F.col("h")
    if mode == "width":
        nw, nh = F.lit(float(width)), h * F.lit(float(width)) / w
    elif mode == "height":
        nw, nh = w * F.lit(float(height)) / h, F.lit(float(height))
    else:
        nw, nh = w * F.lit(float(scale)), h * F.lit(float(scale))
    whole = lambda v: F.greatest(F.lit(1), F.bround(v, 0).cast("int"))
    return size.select("image_id", "w", "h", whole(nw).alias("new_w"), whole(nh).alias("new_h"))


def downscale_dims(size: DataFrame, longest: int) -> DataFrame:
    """``(new_w, new_h, ratio)``: at most ``longest`` on the longer side; ratio leads back to the original."""
    top = F.greatest("w", "h")
    s = F.lit(float(longest)) / top
    fit = lambda c: F.when(top <= longest, F.col(c)).otherwise(F.greatest(F.lit(1), F.bround(F.col(c) * s, 0).cast("int")))
    out = size.select("image_id", "w", "h", fit("w").alias("new_w"), fit("h").alias("new_h"))
    return out.withColumn("ratio", F.when(F.col("new_w") > 0, F.col("w") / F.col("new_w")).otherwise(F.lit(1.0)))


def resize_nearest(px: DataFrame, scale: float) -> DataFrame:
    """Each target pixel takes the source pixel under its centre: each source pixel goes to the places whose centres it lies under. Only sizes are joined, by image."""
    dims = resize_dims(sizes(px), "scale", scale)

    def places(c, n, o):
        """Target places of the source place ``c``: one more on either side than there can be, of which those that look back at it."""
        n, o = F.col(n), F.col(o)
        low, high = F.floor(F.col(c) * n / o - 0.5).cast("int"), F.ceil((F.col(c) + 1) * n / o - 0.5).cast("int")
        near = F.sequence(F.greatest(F.lit(0), low), F.greatest(F.lit(0), F.least(n - 1, high)))
        return F.filter(near, lambda t: (t < n) & (F.floor((t + 0.5) * o / n).cast("int") == F.col(c)))

    px = px.join(dims.hint("shuffle_hash"), "image_id")
    px = px.select("image_id", "x", F.explode(places("y", "new_h", "h")).alias("ty"), "new_w", "w", *BANDS)
    return px.select("image_id", F.col("ty").alias("y"), F.explode(places("x", "new_w", "w")).alias("tx"), *BANDS).withColumnRenamed("tx", "x").select("image_id", "y", "x", *BANDS)
