"""Content hashes, object ids and key encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = bytearray(b"\x00")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(content) -> Column:
    """SHA-256 of text (as UTF-8) or bytes, lower-case hex."""
    return F.sha2(_col(content).cast("binary"), 256)


def blob_oid(content) -> Column:
    """Object id of a blob: SHA-1 over ``blob <byte length>``, a NUL and the bytes."""
    body = _col(content).cast("binary")
    header = F.concat(F.lit("blob "), F.octet_length(body).cast("string")).cast("binary")
    return F.sha1(F.concat(header, F.lit(NUL), body))


def key_to_hex(key) -> Column:
    return F.lower(F.hex(_col(key)))


def hex_to_key(text) -> Column:
    return F.unhex(_col(text))


def is_commit_id(c) -> Column:
    """A full 40-digit lower-case hex id; names that can move are refused."""
    return F.coalesce(_col(c).rlike(r"^[0-9a-f]{40}\z"), F.lit(False))


def is_digest(c) -> Column:
    """A full 64-digit lower-case hex digest."""
    return F.coalesce(_col(c).rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def has_mode_bits(mode, bits: int) -> Column:
    """Whether any of ``bits`` is set in a numeric file mode."""
    return _col(mode).bitwiseAND(F.lit(bits)) != 0


# Nulls stay and times keep their microseconds.
WHOLE = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def canonical_json(*columns: str) -> Column:
    """JSON of the columns with keys in sorted order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), WHOLE)


def canonical_map_json(m) -> Column:
    """JSON of a map with its keys in sorted order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(m)))))
