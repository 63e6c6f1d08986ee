"""Scalar kernels on vectors, hashes, coordinates and counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_METRES = 6_371_000.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, eps: float = 1e-9) -> Column:
    """v / (|v| + eps), as double."""
    v = doubles(v)
    size = norm(v) + eps
    return F.transform(v, lambda x: x / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(doubles(a), doubles(b)) / F.nullif(norm(doubles(a)) * norm(doubles(b)), F.lit(0.0))


def difference_hash(v: Column, bits: int = 63) -> Column:
    """Bit i, the highest first, is set where v[i] > v[i + 1]."""
    steps = F.zip_with(F.slice(v, 1, bits), F.slice(v, 2, bits), lambda x, y: F.coalesce((x > y).cast("long"), F.lit(0)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, b: s * 2 + b)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def metres_apart(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """haversine for arrays inside a task."""
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_METRES * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as a signed number; S and W are negative."""
    return (d + m / 60.0 + s / 3600.0) * F.when(F.upper(ref).isin("S", "W"), -1.0).otherwise(1.0)


def digest(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def loose_digest(text: Column) -> Column:
    """A digest that white space and case do not change."""
    return F.md5(F.lower(F.regexp_replace(text, "\\s+", "")).cast("binary"))


def readable_bytes(n: Column) -> Column:
    """1536 -> 1.5 KB; from B to TB."""
    told = lambda unit, size: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(size)), 1))
    out = told("TB", 1 << 40)
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10), ("B", 1)):
        out = F.when(n < size * 1024, told(unit, size)).otherwise(out)
    return out


def compression_ratio(before: Column, after: Column) -> Column:
    return before / F.greatest(after, F.lit(1)).cast("double")


def chi2_sf_one(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom, erfc(sqrt(x / 2))."""
    return _erfc_tail(x.cast("double"))


@F.pandas_udf(DoubleType())
def _erfc_tail(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(v / 2)))


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + step * d) or 1e-300)
            c = (1.0 + step / c) or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution: the incomplete beta function at d2 / (d2 + d1 f). Null for null."""
    told = [None if pd.isna(x) else _beta_tail(n / (n + m * x), n / 2, m / 2) for x, m, n in zip(f, d1, d2, strict=True)]
    return pd.Series(told, dtype=float)


def pixel_difference_hash(pixels: Column, width: int = 9) -> Column:
    """Difference hash of an 8 x 9 grey image given row after row."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(pixels, r * width + 1, width))
    return F.aggregate(rows, F.lit(0).cast("long"), lambda s, row: F.shiftleft(s, width - 1).bitwiseOR(difference_hash(row, width - 1)))


def image_kernels(batches: Iterator) -> Iterator:
    """For mapInPandas over binaryFile rows: path, dhash, pixel_md5, width, height, mode. Needs Pillow.

    Images that cannot be read have null values.
    """
    import hashlib
    import io

    from PIL import Image

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                image = Image.open(io.BytesIO(content))
                grey = list(image.convert("L").resize((9, 8), Image.LANCZOS).getdata())
                value = 0
                for r in range(8):
                    for c in range(8):
                        value = value * 2 + (grey[9 * r + c] > grey[9 * r + c + 1])
                pixels = hashlib.md5(image.convert("RGB").resize((64, 64), Image.LANCZOS).tobytes()).hexdigest()
                rows.append((path, value - (1 << 64) if value >> 63 else value, pixels, *image.size, image.mode))
            except Exception:
                rows.append((path, None, None, None, None, None))
        yield pd.DataFrame(rows, columns=["path", "dhash", "pixel_md5", "width", "height", "mode"])
