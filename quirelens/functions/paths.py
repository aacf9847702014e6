"""POSIX path expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(_col(text), r"^\s+|\s+\z", "")


def is_safe_path(path) -> Column:
    """Non-empty, relative, without backslash and without '', '.' or '..' parts."""
    p = _col(path)
    bad = p.contains("\\") | F.exists(F.split(p, "/"), lambda part: part.isin("", ".", ".."))
    return F.coalesce(~bad, F.lit(False))


def suffix(path) -> Column:
    """Lower-case extension of the last part with its dot; '' when there is none.

    A leading dot starts a hidden name, not an extension; neither does a final dot.
    """
    name = F.regexp_extract(_col(path), r"([^/]*)/*\z", 1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def dirname(path) -> Column:
    """All before the last '/'; a root stays as it is."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"[^/]*\z", ""), r"(?<=[^/])/+\z", "")


def join_path(base, path) -> Column:
    """``path`` when absolute, else ``path`` under ``base``."""
    b, p = _col(base), _col(path)
    return (
        F.when(p.startswith("/") | (b == ""), p)
        .when(b.endswith("/"), F.concat(b, p))
        .otherwise(F.concat(b, F.lit("/"), p))
    )


def normalize_path(path) -> Column:
    """Collapse '//', '.' and '..'. '..' above a root is dropped, above a relative
    start it is kept. An empty result is '.'."""
    return let(_col(path), _normalized)


def _normalized(p: Column) -> Column:
    rooted = p.startswith("/")
    lead = F.when(p.rlike("^//(?!/)"), "//").when(rooted, "/").otherwise("")

    def step(done, part):
        top = F.try_element_at(done, F.lit(-1))
        up = part == ".."
        can_pop = (F.size(done) > 0) & (top != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(up & can_pop, F.slice(done, F.lit(1), F.size(done) - 1))
            .when(up & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    full = F.regexp_replace(F.concat(lead, F.array_join(parts, "/")), r"^\z", ".")
    # Most paths are already normal and skip the fold.
    return F.when(p.rlike(r"^\z|//|(^|/)\.\.?(/|\z)|./\z"), full).otherwise(p)


def relative_path(target, start) -> Column:
    """Path that leads from folder ``start`` to ``target``; both below one root."""

    def parts(c):
        return F.filter(F.split(normalize_path(c), "/"), lambda x: ~x.isin("", "."))

    def lead(s):
        a, b = s["a"], s["b"]
        # A marker past each end differs from every part, so a first difference exists.
        differs = F.zip_with(
            F.concat(a, F.array(F.lit("/a"))), F.concat(b, F.array(F.lit("/b"))), lambda x, y: ~x.eqNullSafe(y)
        )
        shared = (F.array_position(differs, True) - 1).cast("int")
        ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
        down = F.slice(b, shared + 1, F.size(b) - shared)
        return F.regexp_replace(F.array_join(F.concat(ups, down), "/"), r"^\z", ".")

    return let(F.struct(parts(_col(start)).alias("a"), parts(_col(target)).alias("b")), lead)


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: '*' and '?' stay inside one part, '**'
    crosses parts and '/**' also matches the folder itself."""
    import re

    # What each sign of a glob means.
    whole = {"/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(/\*\*|\*\*|\*|\?)", pattern)
    return "^" + "".join(whole.get(x, re.escape(x)) for x in pieces) + r"\z"


def matches_glob(path, pattern: str) -> Column:
    return _col(path).rlike(glob_regex(pattern))
