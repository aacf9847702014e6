"""Publication safety: what may not leave with a set of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.functions.paths import suffix

# Extensions that may be published.
ALLOWED_SUFFIXES = (
    ".html", ".css", ".js", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico",
    ".woff", ".woff2", ".ttf", ".dbml", ".json", ".webmanifest", ".map", ".txt", ".xml", ".gz",
)

# Patterns no published path may match, in any case.
FORBIDDEN_PATTERNS = (
    r"\.sqlite3?$",
    r"\.db$",
    r"\.py[cod]?$",
    r"\.sh$",
    r"\.key$",
    r"\.pem$",
    r"\.env.*$",
    r"(?:^|/)token[s]?\.",
    r"(?:^|/)secret[s]?\.",
    r"(?:^|/)credentials?\.",
    r"transcript.*\.jsonl$",
)


def violations(path: str) -> Column:
    """Array of rules a path breaks: 'extension' and each matching pattern."""
    p = F.col(path)
    found = [F.when(~suffix(p).isin(*ALLOWED_SUFFIXES), F.lit("extension"))]
    found += [F.when(p.rlike("(?i)" + x), F.lit(x)) for x in FORBIDDEN_PATTERNS]
    return F.array_compact(F.array(*found))


def safety_violations(paths: DataFrame, path: str = "path", *keep: str) -> DataFrame:
    """One row per path and broken rule."""
    return paths.select(*keep, path, F.explode(violations(path)).alias("rule"))
