"""Unions of many frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, built in pairs: a chain would analyse its growing plan anew for
    every frame it adds."""
    frames = list(frames)
    while len(frames) > 1:
        pairs = zip(frames[::2], frames[1::2])
        odd = frames[-1:] if len(frames) % 2 else []
        frames = [a.unionByName(b) for a, b in pairs] + odd
    return frames[0]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where a null equals a null; the keys come once."""
    keys = list(keys)
    side = right.select(*[F.col(k).alias("_right_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_right_" + k))
    out = left.join(side, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    rest = [c for c in (*left.columns, *side.columns) if c not in keys and not c.startswith("_right_")]
    # Where one side has no row its keys are null, and the other side's count.
    return out.select(*[F.coalesce(k, "_right_" + k).alias(k) for k in keys], *rest)
