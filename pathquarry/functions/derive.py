"""Scalar functions over catalog columns, as column expressions: paths, keys, times, attributes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import ATTRIBUTE_BITS, DEFAULT_EXCLUDED, EPOCH, TICKS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """A-Z only: Spark's lower() would fold other letters too."""
    return F.translate(c, UPPER, LOWER)


def fold(s: str) -> str:
    return s.translate(_FOLD)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def dirname(path: Column) -> Column:
    """What precedes the last separator; null if there is none."""
    return F.when(path.rlike(r"[\\/]"), F.regexp_extract(path, r"(?s)^(.*)[\\/][^\\/]*$", 1))


def parent(path: Column) -> Column:
    """The parent directory: `/` for its children, `C:\\` for a drive's; null for roots."""
    trimmed = F.when((F.length(path) > 1) & ~path.rlike(r"^[A-Za-z]:[\\/]$"), F.regexp_replace(path, r"[\\/]+$", "")).otherwise(path)
    drive = F.regexp_extract(trimmed, r"^([A-Za-z]:[\\/])[^\\/]+$", 1)
    top = F.regexp_extract(trimmed, r"^([\\/])[^\\/]+$", 1)
    rest = F.regexp_extract(trimmed, r"(?s)^(.+)[\\/][^\\/]+$", 1)
    return F.when(drive != "", drive).when(top != "", top).when(trimmed.rlike(r"^[A-Za-z]:[\\/]?$"), F.lit(None)).when(rest != "", rest)


def extension(path: Column, is_dir: Column) -> Column:
    """Text after the last point of the path, ASCII-lowered; null for directories, without a point, or across a separator."""
    ext = F.regexp_extract(path, r"(?s)^.+\.([^.\\/]+)$", 1)
    return F.when(~is_dir & (ext != ""), ascii_lower(ext))


def content_extension(path: Column) -> Column:
    """Text after the last point of the name, '' if there is none. The name begins after the last `\\`, else after the last `/`."""
    name = F.when(F.instr(path, "\\") > 0, F.regexp_extract(path, r"(?s)([^\\]*)$", 1)).otherwise(F.regexp_extract(path, r"(?s)([^/]*)$", 1))
    return F.regexp_extract(name, r"(?s)\.([^.]*)$", 1)


def is_excluded(lower_path: Column) -> Column:
    names = "|".join(re.escape(fold(n)) for n in DEFAULT_EXCLUDED)
    return lower_path.rlike(rf"[\\/]({names})([\\/]|$)")


def volume_prefix(path: Column) -> Column:
    """A drive path's first component."""
    return F.get(F.split(path, r"\\"), F.lit(0))


def derive(entries: DataFrame) -> DataFrame:
    """Adds the stored derived columns, so that filters compare bare columns and reach the Parquet reader."""
    path = F.col("path")
    out = entries.withColumns({"name": basename(path), "lower_path": ascii_lower(path)})
    return out.withColumns({"lower_name": ascii_lower(F.col("name")), "extension": extension(path, F.col("is_dir")), "excluded": is_excluded(F.col("lower_path"))})


def name_length(name: Column) -> Column:
    """In bytes."""
    return F.octet_length(name).cast("long")


def to_unix(filetime: Column) -> Column:
    """Seconds since 1970, never negative."""
    return F.when(filetime <= EPOCH, F.lit(0).cast("long")).otherwise(F.floor((filetime - EPOCH) / F.lit(TICKS).cast("decimal(20,0)")).cast("long"))


def from_unix(seconds: Column, nanos: Column | None = None) -> Column:
    """FILETIME; 0 seconds stay 0."""
    ticks = (seconds + 11_644_473_600) * TICKS + (F.lit(0) if nanos is None else F.floor(nanos / 100))
    return F.when(seconds == 0, F.lit(0)).otherwise(ticks).cast("long")


def iso_from_unix(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ; needs the session time zone UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso(filetime: Column) -> Column:
    """As iso_from_unix; null for 0 and before 1970."""
    return F.when(filetime >= EPOCH, iso_from_unix(to_unix(filetime)))


def attribute_letters(attributes: Column) -> Column:
    text = F.concat(*[F.when(attributes.bitwiseAND(bit) != 0, letter).otherwise("") for letter, bit in ATTRIBUTE_BITS.items()])
    return F.when(text == "", "-").otherwise(text)


def synthesize_attributes(mode: Column, is_dir: Column, name: Column, readonly: bool = True) -> Column:
    """Directory, hidden dotfile, no write bits, regular file. readonly=False leaves the third out, as one platform does."""
    bit = lambda c, b: F.when(c, b).otherwise(0)
    total = bit(is_dir, 0x10) + bit(name.startswith("."), 0x2) + bit(~is_dir, 0x20)
    return (total + (bit(mode.bitwiseAND(0o222) == 0, 0x1) if readonly else 0)).cast("long")


def creation_time(btime: Column, ctime: Column, mtime: Column) -> Column:
    return F.coalesce(F.nullif(btime, F.lit(0)), F.nullif(ctime, F.lit(0)), mtime)


def start_of_day(seconds: Column) -> Column:
    return seconds - F.pmod(seconds, F.lit(86_400))


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def contains_folded(haystack: Column, needle: str) -> Column:
    return ascii_lower(haystack).contains(fold(needle))


def starts_with_folded(text: Column, prefix: str) -> Column:
    return ascii_lower(text).startswith(fold(prefix))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition has no built-in; off by default."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def canonical_key(c: Column, compose: bool = False) -> Column:
    """ASCII-lowered; compose adds NFC and full case folding."""
    return F.lower(nfc(c)) if compose else ascii_lower(c)


def normalize_separators(c: Column, windows: bool) -> Column:
    return F.translate(c, "/", "\\") if windows else F.translate(c, "\\", "/")


# Driver-side counterparts for query text.


def trim_separators(path: str) -> str:
    """Without trailing separators; one character stays."""
    while len(path) > 1 and path[-1] in "\\/":
        path = path[:-1]
    return path


def is_absolute(path: str) -> bool:
    return path.startswith("/") or (len(path) > 2 and path[0].isascii() and path[0].isalpha() and path[1] == ":" and path[2] in "\\/")


def attribute_mask(letters: str) -> int | None:
    """The bits of letters such as `rh`; None for an unknown letter or none."""
    bits = {k.lower(): v for k, v in ATTRIBUTE_BITS.items()} | {"n": 0x80}
    mask = 0
    for c in letters.strip().strip('"').lower():
        if c not in bits:
            return None
        mask |= bits[c]
    return mask or None


def project_fields(df: DataFrame, fields: str | Sequence[str] | None) -> DataFrame:
    """Chosen columns of a comma list, in its order; unknown names are left out, none chosen means all."""
    names = fields.split(",") if isinstance(fields, str) else list(fields or [])
    chosen = [n for n in dict.fromkeys(x.strip().lower() for x in names) if n in df.columns]
    return df.select(*chosen) if chosen else df


def tool_view(df: DataFrame) -> DataFrame:
    """A result row as tools show it."""
    letters = attribute_letters(F.coalesce("attributes", F.lit(0)))
    return df.select(
        basename(F.col("path")).alias("filename"), dirname(F.col("path")).alias("dir"), "path", "size",
        iso(F.col("created")).alias("date_created"), iso(F.col("modified")).alias("date_modified"), iso(F.col("accessed")).alias("date_accessed"),
        F.when((letters == "-") & F.col("is_dir"), "D").otherwise(letters).alias("attributes"), "extension", "is_dir",
    )


def entry_view(df: DataFrame) -> DataFrame:
    return df.select("path", "size", "created", "modified", "accessed", "is_dir", "attributes", "extension")
