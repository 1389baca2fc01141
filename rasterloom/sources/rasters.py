"""Images as relations: sources and the packed form.

The pixel relation has rows ``(image_id, y, x, r, g, b)``; gray images have equal bands. The packed
form has one row per image, ``(image_id, w, h, data)``, data the row-major RGB bytes.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import downscale, resample

PIXELS = "image_id long, y int, x int, r int, g int, b int"
PACKED = "image_id long, w int, h int, data binary"
WIDTH, HEIGHT = 64, 48
#: Size of the images that every working size scales down.
LARGE = (1700, 1100)
#: Images of a partition, at most about.
SPREAD = 128


def spread(ids: DataFrame) -> DataFrame:
    """``ids(image_id)`` dealt out by hash. A small file would be one task however many pixels follow; what goes by image then needs no exchange of pixels."""
    parts = max(ids.sparkSession.sparkContext.defaultParallelism, math.ceil(ids.count() / SPREAD))
    return ids.repartition(parts, "image_id")


def gradient_images(spark: SparkSession, sf_dir: str, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """An integer-formula RGB image per row of ``embeddings``."""
    i = F.col("image_id")
    grid = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id")))
    grid = grid.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    x, y = F.col("x"), F.col("y")
    value = lambda v: (v % 256).cast("int")
    return grid.select(
        "image_id", "y", "x",
        value(i * 37 + x * 7 + y * 3 + (x * y) % 11 * 9).alias("r"),
        value(i * 11 + x * 13 + y * 5 + (x + y) % 7 * 17).alias("g"),
        value(i * 5 + x * 3 + y * 29 + (x * x + y) % 13 * 7).alias("b"),
    )


def gradient_array(image_id: int, width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """The image of :func:`gradient_images` as an array."""
    i, (y, x) = int(image_id), np.mgrid[0:height, 0:width].astype(np.int64)
    bands = (i * 37 + x * 7 + y * 3 + (x * y) % 11 * 9, i * 11 + x * 13 + y * 5 + (x + y) % 7 * 17, i * 5 + x * 3 + y * 29 + (x * x + y) % 13 * 7)
    return (np.stack(bands, 2) % 256).astype(np.uint8)


def packed_gradients(ids: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """The same images of ``ids(image_id)`` in packed form, made where they are needed: no pixel is a row."""

    def run(batches):
        for pdf in batches:
            for i in pdf["image_id"]:  # a batch an image: its size doesn't depend on how many there are
                yield pd.DataFrame({"image_id": [i], "w": [width], "h": [height], "data": [gradient_array(i, width, height).tobytes()]})

    return ids.select(F.col("image_id").cast("long")).mapInPandas(run, PACKED)


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of 64 components as 8 by 8 gray images ``(image_id, y, x, v)``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    v = F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int")
    return e.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), v.alias("v"))


def pack(px: DataFrame) -> DataFrame:
    """Packed form; the only shuffle is by image. Sources that can make packed images need no pixel rows: :func:`packed_gradients`."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = image_array(pdf)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "w": [a.shape[1]], "h": [a.shape[0]], "data": [a.tobytes()]})

    return px.groupBy("image_id").applyInPandas(one, PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """Pixel relation of packed images, no shuffle."""

    def run(batches):
        for pdf in batches:
            for i, w, h, data in zip(pdf["image_id"], pdf["w"], pdf["h"], pdf["data"]):
                yield pixel_frame(i, np.frombuffer(data, np.uint8).reshape(h, w, 3))

    return packed.mapInPandas(run, PIXELS)


def pixel_frame(image_id: int, a: np.ndarray) -> pd.DataFrame:
    h, w = a.shape[:2]
    y, x = np.divmod(np.arange(h * w), w)
    flat = a.reshape(h * w, 3).astype(np.int32)
    return pd.DataFrame({"image_id": np.full(h * w, image_id, np.int64), "y": y.astype(np.int32), "x": x.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})


def image_array(pdf: pd.DataFrame) -> np.ndarray:
    h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
    out = np.zeros((h, w, 3), np.uint8)
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[["r", "g", "b"]].to_numpy(np.uint8)
    return out


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Files through Spark's image source: path, w, h, data in RGB order, valid. Alpha lies over white."""
    image = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path).select("image.*")

    def run(batches):
        for pdf in batches:
            out = []
            for w, h, n, data in zip(pdf["width"], pdf["height"], pdf["nChannels"], pdf["data"]):
                if h < 0:
                    out.append((0, 0, None, False))
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                if n == 1:
                    a = np.repeat(a, 3, 2)
                else:
                    rgb = a[:, :, 2::-1]
                    a = over_white(rgb, a[:, :, 3:4]) if n == 4 else rgb
                out.append((w, h, a.astype(np.uint8).tobytes(), True))
            yield pd.DataFrame({"path": pdf["origin"], **{c: [o[k] for o in out] for k, c in enumerate(("w", "h", "data", "valid"))}})

    return image.mapInPandas(run, "path string, w int, h int, data binary, valid boolean")


#: The first bytes of each image format.
FORMATS = (("PNG", "89504E470D0A1A0A"), ("JPEG", "FFD8FF"), ("GIF", "47494638"), ("BMP", "424D"), ("TIFF", "49492A00"), ("TIFF", "4D4D002A"), ("WEBP", "52494646"))


def format_name(content) -> object:
    """The image format that the bytes begin like, null where none."""
    head = F.hex(F.substring(content, 1, 12))
    out = None
    for name, magic in FORMATS:
        hit = head.startswith(magic) & (head.endswith("57454250") if name == "WEBP" else F.lit(True))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def orientation(content: bytes) -> int:
    """The orientation tag (1 to 8) of a JPEG's EXIF block, 1 where there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and content[at : at + 1] == b"\xff" and at + 4 <= len(content):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            t = body[6:]
            order = "little" if t[:2] == b"II" else "big"
            first = int.from_bytes(t[4:8], order)
            for k in range(int.from_bytes(t[first : first + 2], order)):
                entry = t[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x112 and 1 <= (value := int.from_bytes(entry[8:10], order)) <= 8:
                    return value
            return 1
        if content[at + 1] == 0xDA:
            break
        at += 2 + size
    return 1


def upright(a: np.ndarray, tag: int) -> np.ndarray:
    """The image as its orientation tag means it to be seen."""
    a = a.transpose(1, 0, 2) if tag >= 5 else a
    a = a[::-1] if tag in (3, 4, 7, 8) else a
    return np.ascontiguousarray(a[:, ::-1] if tag in (2, 3, 6, 7) else a)


def load_working(packed: DataFrame, longest: int = 1600) -> DataFrame:
    """Packed images scaled down to the working size, aspect kept; smaller ones stay as they are. EXIF orientation is not applied."""
    return packed_map(packed, lambda a: downscale(a, longest))


def thumbnails(packed: DataFrame, longest: int = 220) -> DataFrame:
    """Thumbnails that fit the square of ``longest``, never enlarged. A column ``orientation``, where there is one, is applied first."""
    return packed_map(packed, lambda a: fit(a, longest), upright if "orientation" in packed.columns else None)


def fit(a: np.ndarray, longest: int) -> np.ndarray:
    h, w = a.shape[:2]
    if max(w, h) <= longest:
        return a
    s = longest / max(w, h)
    return resample(a, max(1, round(w * s)), max(1, round(h * s)), "lanczos")


def packed_map(packed: DataFrame, kernel, turn=None) -> DataFrame:
    """``kernel`` over every packed image; an image a batch."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                a = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, 3)
                a = np.ascontiguousarray(kernel(turn(a, int(row.orientation)) if turn else a), np.uint8)
                yield pd.DataFrame({"image_id": [row.image_id], "w": [a.shape[1]], "h": [a.shape[0]], "data": [a.tobytes()]})

    return packed.mapInPandas(run, PACKED)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as they are: path, content, format, orientation. What serving a file needs is its path and content."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("int")
    def tag(content: pd.Series) -> pd.Series:
        return pd.Series([orientation(c) for c in content])

    return files.withColumns({"format": format_name(F.col("content")), "orientation": tag("content")})


def over_white(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Rounded ``v * a + 255 * (1 - a)`` over 8-bit alpha."""
    return (2 * (rgb * alpha + 255 * (255 - alpha)) + 255) // 510


def png(a: np.ndarray) -> bytes:
    """An RGB image as PNG: unfiltered rows, deflated."""
    h, w = a.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, 3 * w)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")


def with_png(packed: DataFrame) -> DataFrame:
    """Adds ``png``: the result sink's column."""

    @F.pandas_udf("binary")
    def encode(w: pd.Series, h: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([png(np.frombuffer(d, np.uint8).reshape(b, a, 3)) for a, b, d in zip(w, h, data)])

    return packed.withColumn("png", encode("w", "h", "data"))
