"""Text files as rows that know their place.

Spark reads files in splits of any order. ``pos`` (file, split start, row in split) sorts rows
as they stand in their files, whatever the partitioning, so "first one wins" has a meaning
without pulling a file through one task. Gzip files are one split each; they are spread out
right after the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def position() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], line_sep: str | None = None, spread: bool = False
) -> DataFrame:
    """(line, pos, file_name); ``spread`` rebalances, for files that cannot be split."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    rows = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.regexp_replace("value", r"\r\z", "").alias("line"),
        position().alias("pos"),
        F.col("_metadata.file_name").alias("file_name"),
    )
    return rows.hint("rebalance") if spread else rows


def folder_key(name: str) -> Column:
    """The value of a partition folder ``name=value`` on the file's path, or null."""

    def decoded(text: Column) -> Column:
        return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))

    found = F.regexp_extract("pos.file", f"/{name}=([^/]+)/", 1)
    # Encoded by the writer of the folder, and again in the path's own form.
    return F.when(found != "", decoded(decoded(found)))


def with_fields(lines: DataFrame, pattern: str = "\t") -> DataFrame:
    return lines.withColumn("f", F.split("line", pattern, -1))


def field(i: int) -> Column:
    """Field i of the split line, or null when the line is shorter."""
    return F.get("f", F.lit(i))


def first_wins(rows: DataFrame, key: str, value: str, order: str = "pos") -> DataFrame:
    """One (key, value) per key: the one that comes first in file order."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def last_wins(rows: DataFrame, key: str, value: str, order: str = "pos") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))
