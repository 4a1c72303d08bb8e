"""Fixed schemas of the catalog, its change feed, its content table and its checkpoints; never inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 1
#: FILETIME of 1970-01-01: 100 ns ticks since 1601.
EPOCH = 116_444_736_000_000_000
TICKS = 10_000_000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_s, _l, _b = T.StringType(), T.LongType(), T.BooleanType()
#: A scanned entry; `DERIVED` columns are added by functions.derive.derive and stored with it.
ENTRY = _struct(path=_s, size=_l, created=_l, modified=_l, accessed=_l, is_dir=_b, attributes=_l, file_ref=_l, volume=_s)
DERIVED = _struct(name=_s, lower_name=_s, lower_path=_s, extension=_s, excluded=_b)
CATALOG = T.StructType(ENTRY.fields + DERIVED.fields)
CHANGE = _struct(timestamp=_l, reason=_s, path=_s, is_dir=_b)
CONTENT = _struct(path_key=_s, body=_s, byte_count=_l, indexed_at=_l, source_modified=_l)
PENDING = _struct(file_ref=_l, path=_s, seq=_l)
JOURNAL = _struct(seq=_l, timestamp=_l, reason=_s, path=_s, is_dir=_b, file_ref=_l)
CHECKPOINT = _struct(volume=_s, journal_id=_l, cursor=_l)

# Attribute letters and bits, in the order in which they are printed.
ATTRIBUTE_BITS = {"A": 0x20, "R": 0x1, "H": 0x2, "S": 0x4, "D": 0x10, "T": 0x100, "P": 0x400, "C": 0x800, "O": 0x1000, "I": 0x2000, "E": 0x4000}
NORMAL = 0x80
# Directories that are left out by default.
DEFAULT_EXCLUDED = ["node_modules", ".git", "WinSxS", "$Recycle.Bin", "System Volume Information"]
