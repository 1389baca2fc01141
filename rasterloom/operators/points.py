"""Operators that look at one pixel, or at one pixel and its image's statistics. Pixel relation in, pixel relation out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import BANDS, blend, clip, each, lookup, luma, palette_table, saturating

def _gray(px: DataFrame, v) -> DataFrame:
    return px.withColumn("__v", v).withColumns({c: F.col("__v") for c in BANDS}).drop("__v")


def brightness(px: DataFrame, amount: float = 0) -> DataFrame:
    return px.withColumns(each(lambda v: clip(v * F.lit(1 + amount / 100))))


def contrast_factor(px: DataFrame, factor: float) -> DataFrame:
    """Away from the image's rounded mean gray, the one per-image aggregate needed."""
    mean = px.groupBy("image_id").agg(F.floor(F.avg(luma()) + 0.5).cast("int").alias("__m"))
    return px.join(mean, "image_id").withColumns(each(lambda v: blend(F.col("__m"), v, factor))).drop("__m")


def contrast(px: DataFrame, amount: float = 0) -> DataFrame:
    return contrast_factor(px, 1 + amount / 100)


def saturation_factor(px: DataFrame, factor: float) -> DataFrame:
    return px.withColumn("__l", luma()).withColumns(each(lambda v: blend(F.col("__l"), v, factor))).drop("__l")


def saturation(px: DataFrame, amount: float = 0) -> DataFrame:
    return saturation_factor(px, 1 + amount / 100)


def grayscale(px: DataFrame, mode: str = "luma", channel: str = "r") -> DataFrame:
    """``average`` adds the bands saturating at 255 before it divides, so its largest value is 85; ``average_true`` does not."""
    if mode == "average":
        return _gray(px, F.floor(saturating(saturating(F.col("r") + F.col("g")) + F.col("b")) / 3).cast("int"))
    if mode == "average_true":
        return _gray(px, F.floor((F.col("r") + F.col("g") + F.col("b")) / 3).cast("int"))
    if mode == "channel":
        return _gray(px, F.col(channel if channel in BANDS else "r"))
    return _gray(px, luma())


def invert(px: DataFrame) -> DataFrame:
    return px.withColumns(each(lambda v: F.lit(255) - v))


def threshold(px: DataFrame, mode: str = "binary", value: int = 127, block: int = 15) -> DataFrame:
    """``adaptive`` subtracts with saturation and so is white throughout; ``adaptive_signed`` compares with the local mean."""
    if mode == "adaptive":
        return _gray(px, F.lit(255))
    if mode == "adaptive_signed":
        from .stencils import box_mean

        local = box_mean(px.withColumn("v", luma()), "v", max(1, block // 2), "__mean")
        return _gray(local, F.when(F.col("v") >= F.col("__mean"), 255).otherwise(0)).drop("v", "__mean")
    return _gray(px, F.when(luma() >= value, 255).otherwise(0))


def color_balance(px: DataFrame, r: float = 0, g: float = 0, b: float = 0) -> DataFrame:
    return px.withColumns({c: clip(F.col(c) * F.lit(1 + gain / 100)) for c, gain in zip(BANDS, (r, g, b)) if abs(gain) > 1e-9})


def posterize(px: DataFrame, levels: int = 4) -> DataFrame:
    """``levels``, held to 2..8, counts bits."""
    step = 1 << (8 - max(2, min(8, int(levels))))
    return px.withColumns(each(lambda v: v - v % step))


def false_color(px: DataFrame, palette: str = "thermal") -> DataFrame:
    table = palette_table(palette)
    return px.withColumn("__l", luma()).withColumns({c: lookup([t[k] for t in table], F.col("__l")) for k, c in enumerate(BANDS)}).drop("__l")


def solarize(px: DataFrame, threshold: int = 128) -> DataFrame:
    return px.withColumns(each(lambda v: F.when(v < threshold, v).otherwise(F.lit(255) - v)))


def noise(px: DataFrame, mode: str = "gaussian", amount: float = 10) -> DataFrame:
    """Seeded by the image and the place, so reruns agree. Salt and pepper touches a share of 0.05 * amount / 100 of the pixels."""
    seed = F.pmod(F.col("image_id") * 1_000_003 + F.col("y") * 99_991 + F.col("x") * 7_919 + 12_345, F.lit(1_000_000_007))
    draw = F.pmod(seed * 48_271, F.lit(2_147_483_647))
    if mode == "saltpepper":
        hit = draw % 100_000 < int(amount / 100 * 0.05 * 100_000)
        value = F.when(F.floor(draw / 100_000) % 2 == 0, 255).otherwise(0)
        return px.withColumn("__n", F.when(hit, value)).withColumns(each(lambda v: F.coalesce("__n", v).cast("int"))).drop("__n")
    share, sigma = amount / 100, int(max(1, amount / 100 * 80))
    uniform = lambda k: ((F.pmod(draw * k, F.lit(2_147_483_629)) + 1) / 2_147_483_630.0)
    normal = F.sqrt(-2 * F.log(uniform(16_807))) * F.cos(uniform(69_621) * 6.283185307179586)
    return px.withColumn("__n", clip(F.lit(128.0) + normal * sigma)).withColumns(each(lambda v: blend(v, F.col("__n"), min(0.6, share * 0.6)))).drop("__n")


def sepia(px: DataFrame, amount: float = 1.0) -> DataFrame:
    return px.withColumn("__l", luma()).withColumns({c: clip(F.col("__l") * F.lit(k * amount)) for c, k in zip(BANDS, (1.12, 0.95, 0.72))}).drop("__l")


def heatmap(px: DataFrame) -> DataFrame:
    """Gray differences as colours, blue over red to yellow, four times amplified."""
    v = F.least(F.lit(255), luma() * 4)
    t = F.col("__v") / F.lit(255.0)
    low = t < 0.5
    px = px.withColumn("__v", v)
    return px.withColumns({
        "r": F.when(low, F.floor(2 * t * 255)).otherwise(255).cast("int"),
        "g": F.when(low, 0).otherwise(F.floor((t - 0.5) * 2 * 255)).cast("int"),
        "b": F.when(low, F.floor((F.lit(0.5) - t) * 2 * 255)).otherwise(0).cast("int"),
    }).drop("__v")


def channel_transfer(px: DataFrame, mean: tuple, std: tuple) -> DataFrame:
    """Each band moved to a mean and a population standard deviation; a flat band keeps its spread."""
    sums = px.groupBy("image_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in BANDS), *(F.sum(F.col(c) * F.col(c)).alias(f"q{c}") for c in BANDS))
    spread_of = lambda c: F.sqrt((F.col("n") * F.col(f"q{c}") - F.col(f"s{c}") * F.col(f"s{c}")).cast("double")) / F.col("n")
    stats = sums.select("image_id", *((F.col(f"s{c}") / F.col("n")).alias(f"__m{c}") for c in BANDS), *(spread_of(c).alias(f"__s{c}") for c in BANDS))
    px = px.join(stats.hint("shuffle_hash"), "image_id")  # a hash table of a row an image, never of pixels
    spread = lambda c: F.when(F.col(f"__s{c}") < 1e-6, F.lit(1.0)).otherwise(F.col(f"__s{c}"))
    out = {c: clip((F.col(c) - F.col(f"__m{c}")) * F.lit(float(s)) / spread(c) + F.lit(float(m))) for c, m, s in zip(BANDS, mean, std)}
    return px.withColumns(out).drop(*(f"__{k}{c}" for k in "ms" for c in BANDS))


def vignette(px: DataFrame, strength: float = 0.5) -> DataFrame:
    """Darkens the centre: weight 1 - strength * (1 - r / R) by the distance r from it."""
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("__w"), (F.max("y") + 1).alias("__h"))
    px = px.join(size, "image_id")
    dx, dy = F.col("x") + 0.5 - F.col("__w") / 2, F.col("y") + 0.5 - F.col("__h") / 2
    radius = F.sqrt(dx * dx + dy * dy) / F.sqrt(F.col("__w") * F.col("__w") / 4 + F.col("__h") * F.col("__h") / 4)
    return px.withColumn("__a", F.lit(1.0) - F.lit(strength) * (F.lit(1.0) - F.least(F.lit(1.0), radius))).withColumns(each(lambda v: clip(v * F.col("__a")))).drop("__w", "__h", "__a")


def equalize(px: DataFrame, mode: str = "luminance") -> DataFrame:
    """Histogram equalisation of each band (both modes alike): one histogram of all bands, a table of 256 values for each band of an image, one join by image."""
    stacked = px.select("image_id", F.posexplode(F.array(*BANDS)).alias("band", "v"))
    hist = stacked.groupBy("image_id", "band", "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("image_id", "band").orderBy("v")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.floor((F.sum("n").over(every) - F.last("n").over(every)) / 255)
    after = F.coalesce(F.lead("v").over(whole), F.lit(256))
    steps = hist.select("image_id", "band", "v", before.alias("before"), step.alias("step"), after.alias("after"), F.lag("v").over(whole).isNull().alias("first"))
    value = F.when(F.col("step") == 0, F.col("v")).otherwise(F.least(F.lit(255), F.floor((F.floor(F.col("step") / 2) + F.col("before")) / F.col("step")))).cast("int")
    # whole tables: a value's entry is repeated up to the next value's, the first one's from 0 on; entries of values that don't occur are never read
    part = F.array_repeat(value, (F.col("after") - F.when(F.col("first"), 0).otherwise(F.col("v"))).cast("int"))
    tables = steps.select("image_id", "band", "v", part.alias("to")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("band", "v", "to"))).alias("t")).select("image_id", F.flatten("t.to").alias("__t"))
    return px.join(tables.hint("shuffle_hash"), "image_id").select("image_id", "y", "x", *(F.element_at("__t", F.col(c) + (256 * k + 1)).alias(c) for k, c in enumerate(BANDS)))


def ensure_rgb(rgba: DataFrame) -> DataFrame:
    """``(…, r, g, b, a)`` over white, rounded."""
    over = lambda v: F.floor((v * F.col("a") + 255 * (F.lit(255) - F.col("a"))) / 255 + 0.5).cast("int")
    return rgba.withColumns(each(over)).drop("a")
