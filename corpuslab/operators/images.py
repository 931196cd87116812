"""Perceptual hashes and pixel embeddings of images, over Spark's image source: a task decodes, shrinks and hashes its own images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels, data (rows of pixels, blue first): images that can't be decoded are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder)
    return images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def shrunk(pixels: np.ndarray, size: int) -> np.ndarray:
    """size x size means of equal areas of (height, width, channels); a smaller image repeats its pixels first."""
    for axis in (0, 1):
        n = pixels.shape[axis]
        if n < size:
            pixels = np.repeat(pixels, -(-size // n), axis=axis)
            n = pixels.shape[axis]
        edges = np.arange(size) * n // size
        sums = np.add.reduceat(pixels, edges, axis=axis)
        widths = np.diff(np.append(edges, n))
        pixels = sums / widths.reshape([-1 if a == axis else 1 for a in range(3)])
    return pixels


def cosine_transform(n: int) -> np.ndarray:
    """The matrix of the type-2 discrete cosine transform."""
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def perceptual_hash(pixels: np.ndarray, bits: int = 8, factor: int = 4) -> int:
    """bits x bits bits, row by row, the first highest: which of the lowest frequencies of the brightness are above their median."""
    n = bits * factor
    grey = shrunk(pixels @ np.array([0.299, 0.587, 0.114])[:, None], n)[:, :, 0]
    m = cosine_transform(n)
    low = (m @ grey @ m.T)[:bits, :bits]
    return int("".join("1" if x else "0" for x in (low > np.median(low)).ravel()), 2)


def _scan(images: DataFrame, one, kind: str, name: str) -> DataFrame:
    def scan(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [one(rgb(r["height"], r["width"], r["channels"], r["data"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64() if kind == "long" else pa.list_(pa.float64()))], ["path", name])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(scan, f"path string, {name} {kind}")


def hashes(images: DataFrame) -> DataFrame:
    """path, h: the 64-bit perceptual hash as a signed long, as hamming_pairs takes it."""

    def signed(pixels: np.ndarray) -> int:
        h = perceptual_hash(pixels)
        return h - (1 << 64) if h >> 63 else h

    return _scan(images, signed, "long", "h")


def pixel_vectors(images: DataFrame, size: int = 32) -> DataFrame:
    """path, v: size x size colours from 0 to 1, less their mean."""

    def vector(pixels: np.ndarray) -> list[float]:
        x = (shrunk(pixels, size) / 255.0).ravel()
        return (x - x.mean()).tolist()

    return _scan(images, vector, "array<double>", "v")
