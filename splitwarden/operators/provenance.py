"""Where captures come from: EXIF fields of JPEG and TIFF files, parsed in tasks without further libraries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import degrees

# EXIF tags and the sizes of their types.
TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "modified", 0x8769: "exif", 0x8825: "gps", 0x9003: "taken"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
SCHEMA = "path string, datetime string, make string, model string, lat_dms array<double>, lat_ref string, lon_dms array<double>, lon_ref string"


def _tiff(data: bytes) -> bytes | None:
    """The TIFF block of an image's metadata."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _folder(block: bytes, end: str, at: int, names: dict) -> dict:
    out = {}
    (n,) = struct.unpack_from(end + "H", block, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", block, at + 2 + 12 * i)
        if tag not in names or kind not in SIZES:
            continue
        place = at + 10 + 12 * i
        if SIZES[kind] * count > 4:
            (place,) = struct.unpack_from(end + "I", block, place)
        if kind == 2:
            out[names[tag]] = block[place : place + count].split(b"\0")[0].decode("latin-1").strip()
        elif kind == 5:
            pairs = struct.unpack_from(f"{end}{2 * count}I", block, place)
            out[names[tag]] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        elif kind in (3, 4):
            out[names[tag]] = struct.unpack_from(end + ("H" if kind == 3 else "I"), block, place)[0]
    return out


def exif(content: bytes) -> dict:
    """datetime, make, model, lat, lat_ref, lon, lon_ref as far as they are there; broken blocks give nothing."""
    try:
        block = _tiff(bytes(content))
        if not block:
            return {}
        end = "<" if block[:2] == b"II" else ">"
        main = _folder(block, end, struct.unpack_from(end + "I", block, 4)[0], TAGS)
        inner = _folder(block, end, main["exif"], TAGS) if "exif" in main else {}
        gps = _folder(block, end, main["gps"], GPS) if "gps" in main else {}
        return {"datetime": inner.get("taken") or main.get("modified"), "make": main.get("make"), "model": main.get("model"), **gps}
    except (struct.error, IndexError, UnicodeDecodeError):
        return {}


def exif_table(items: DataFrame) -> DataFrame:
    """path, datetime, make, model, lat, lon of items with path and content."""

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = [exif(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "datetime": [x.get("datetime") for x in found], "make": [x.get("make") for x in found], "model": [x.get("model") for x in found], "lat_dms": [x.get("lat") for x in found], "lat_ref": [x.get("lat_ref") for x in found], "lon_dms": [x.get("lon") for x in found], "lon_ref": [x.get("lon_ref") for x in found]})

    raw = items.select("path", "content").mapInPandas(parse, SCHEMA)
    place = lambda c: F.when(F.size(f"{c}_dms") == 3, degrees(F.get(f"{c}_dms", 0), F.get(f"{c}_dms", 1), F.get(f"{c}_dms", 2), F.coalesce(F.col(f"{c}_ref"), F.lit("N"))))
    return raw.select("path", "datetime", "make", "model", place("lat").alias("lat"), place("lon").alias("lon"))


def capture_summary(table: DataFrame) -> DataFrame:
    """month, model, n, n_gps from EXIF times (yyyy:MM:dd HH:mm:ss)."""
    return table.groupBy(F.substring("datetime", 1, 7).alias("month"), "model").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("n_gps"))
