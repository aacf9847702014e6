"""Instants: epoch microseconds, zoned text, two-zone display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The second display zone, nine hours ahead of UTC all year.
LOCAL_OFFSET = "+09:00"
LOCAL_HOURS = 9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_micros(us) -> Column:
    return F.timestamp_micros(_col(us))


def to_micros(ts) -> Column:
    return F.unix_micros(_col(ts))


def parse_zoned(text) -> Column:
    """Instant of an ISO time; null when it is malformed or names no zone."""
    t = _col(text)
    return F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(t))


def utc_text(wall) -> Column:
    """ISO text with offset for a UTC wall time, to the second."""
    return F.concat(F.date_format(_col(wall), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def local_text(wall) -> Column:
    """The same instant shown nine hours ahead."""
    shifted = _col(wall) + F.make_interval(hours=F.lit(LOCAL_HOURS))
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(LOCAL_OFFSET))


def time_element(wall) -> Column:
    """Markup showing the local time and keeping the exact UTC instant."""
    return F.concat(
        F.lit('<time datetime="'), utc_text(wall), F.lit('">'), local_text(wall), F.lit(" (JST)</time>")
    )
