"""File census."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.functions.hashing import has_mode_bits, sha256_hex

# Fixed value: the 16 bytes a database file opens with.
DATABASE_HEADER = bytearray(b"SQLite format 3\x00")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, content and time of every file below ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "content", "modificationTime")
    )


# Fixed value: the bits that let anyone run a file.
EXECUTABLE = 0o111


def file_census(files: DataFrame, path: str = "path", content: str = "content", *keep: str, mode: str | None = None) -> DataFrame:
    """Path, digest and length of each file, and whether it must be refused: it opens
    like a database, or its numeric ``mode``, where that column is named, makes it
    executable. The mode is carried along."""
    body = F.col(content).cast("binary")
    refused = F.substring(body, 1, len(DATABASE_HEADER)) == F.lit(DATABASE_HEADER)
    if mode is not None:
        refused |= F.coalesce(has_mode_bits(mode, EXECUTABLE), F.lit(False))
    return files.select(
        path,
        *keep,
        *([mode] if mode is not None else []),
        sha256_hex(content).alias("sha256"),
        F.octet_length(body).cast("bigint").alias("byte_length"),
        refused.alias("refused"),
    )
