"""Item names: extensions, capture keys, splits by name, location columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Image extensions, split folder names, location hints in headers.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "heic")
SPLIT_NAMES = {"train": ("train", "training", "train_set"), "val": ("val", "valid", "validation", "dev"), "test": ("test", "testing", "test_set", "eval")}
LOCATION_HINTS = ("site", "orchard", "location", "farm", "plot", "block", "gps", "lat", "lon", "address", "district", "estate", "place", "kebun", "ladang", "tempat", "source")


def stem(name: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """The name without its extensions, doubled ones included."""
    return F.regexp_replace(name, "(?i)(\\.(" + "|".join(extensions) + "))+$", "")


def has_extension(name: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return name.rlike("(?i)\\.(" + "|".join(extensions) + ")$")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


# Names of video frames, messenger pictures and numbered captures.
VIDEO = "(?i)^(.+?)_frame\\d+"
CHAT = "(?i)WhatsApp Image (\\d{4}-\\d{2}-\\d{2})"
NUMBERED = "^([A-Za-z_]*?)(\\d{3,6})\\b"
CHAT_LOOSE = "(?i)^WhatsApp Image (\\d{4}-\\d{2}-\\d{2})"
NUMBERED_LOOSE = "^([A-Za-z_]*?)(\\d{3,})"


def capture_key(name: Column, bounded: bool = True, default_prefix: str | None = None) -> Column:
    """struct(kind, key, num) of a file name: video frame, messenger date, numbered sequence or single.

    bounded: a number has up to six digits and ends at a word boundary, and an empty prefix is IMG; without it
    longer digit runs count too, dates must begin the name, and an empty prefix stays.
    """
    video, chat, seq = (VIDEO, CHAT, NUMBERED) if bounded else (VIDEO, CHAT_LOOSE, NUMBERED_LOOSE)
    default_prefix = default_prefix if default_prefix is not None else "IMG" if bounded else ""

    def key(base: Column, kind: Column) -> Column:
        prefix = F.regexp_extract(base, seq, 1)
        return (
            F.when(kind == "video", F.regexp_extract(base, video, 1))
            .when(kind == "whatsapp", F.regexp_extract(base, chat, 1))
            .when(kind == "seq", once(prefix, lambda p: F.when(p == "", F.lit(default_prefix)).otherwise(p)))
            .otherwise(base)
        )

    def kind(base: Column) -> Column:
        return F.when(base.rlike(video), "video").when(base.rlike(chat), "whatsapp").when(base.rlike(seq), "seq").otherwise("single")

    def named(base: Column, kind: Column) -> Column:
        return F.struct(kind.alias("kind"), key(base, kind).alias("key"), F.when(kind == "seq", F.regexp_extract(base, seq, 2).cast("long")).alias("num"))

    # Each expression is searched once a row: names that stand for columns would be put in wherever they are used.
    return once(stem(name), lambda base: once(kind(base), lambda k: named(base, k)))


def numbered(name: Column) -> Column:
    """struct(prefix, num) of names that end in digits; num is null for others."""
    digits = F.regexp_extract(name, "(\\d+)$", 1)
    return F.struct(F.regexp_replace(name, "\\d+$", "").alias("prefix"), F.when(digits != "", digits.cast("long")).alias("num"))


def key_after_mark(name: Column, mark: str = "___") -> Column:
    """Lower-case text between a mark and the extension."""
    return F.lower(F.trim(F.regexp_extract(name, f"{mark}(.*)\\.[^.]*$", 1)))


def split_of(folder: Column) -> Column:
    """train, val or test for the usual names of split folders, null for others."""
    folded = F.regexp_replace(F.lower(folder), "[- ]", "_")
    out = F.lit(None).cast("string")
    for split, names in SPLIT_NAMES.items():
        out = F.when(folded.isin(*names), split).otherwise(out)
    return out


def kind_of(session: Column) -> Column:
    return F.split(session, ":")[0]


def in_classes(cls: Column, classes: list[str], fold: bool = True) -> Column:
    return F.lower(cls).isin(*(c.lower() for c in classes)) if fold else cls.isin(*classes)


def missing_classes(df: DataFrame, classes: list[str], cls: str = "cls") -> DataFrame:
    """Requested classes that the table lacks."""
    asked = df.sparkSession.createDataFrame([(c,) for c in classes], "cls string")
    return asked.join(df.select(F.col(cls).alias("cls")).distinct(), "cls", "left_anti")


def renamed(cls: Column, names: dict[str, str]) -> Column:
    if not names:
        return cls
    mapping = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(mapping[cls], cls)


def location_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if any(h in c.lower() for h in LOCATION_HINTS)]


def location_values(df: DataFrame, top: int = 20) -> DataFrame:
    """column, value, n: the most frequent values of the columns whose names hint at a place."""
    found = location_columns(df.columns)
    out = None
    for c in found:
        part = df.groupBy(F.col(f"`{c}`").cast("string").alias("value")).count().orderBy(F.desc("count"), "value").limit(top).select(F.lit(c).alias("column"), "value", F.col("count").alias("n"))
        out = part if out is None else out.unionByName(part)
    return df.sparkSession.createDataFrame([], "column string, value string, n long") if out is None else out
