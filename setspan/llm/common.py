"""Text expressions, row identities and written intermediates shared by the operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\f\r"  # the characters [\x20\x09-\x0D]
SPACES = r"[\x20\x09-\x0D]+"


def text_of(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` does just that, and faster, where no other letters are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, gaps: str = SPACES) -> Column:
    """What lies between the gaps, without the empty pieces at the ends."""
    return F.array_remove(F.split(text, gaps), "")


def hash_pair(*parts: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes: 128 bits that tell all strings of a corpus apart."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def row_identity(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Hash pair of (doc_id, text). Rows equal in both are the same document.

    The text is known again by it without being carried along; nulls differ from all values.
    """
    return hash_pair(doc_id, doc_id.isNull(), text, text.isNull())


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once, as Parquet next to the checkpoints, and go on from the files.

    Later steps read only the columns they need, see the same rows after a lost executor, and
    do not repeat what led to them.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed. Once a session."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(prefix="setspan-package-"), "setspan")
        sc.addPyFile(shutil.make_archive(name, "zip", root, "setspan"))
        _shipped.add(sc.applicationId)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_rows(docs: DataFrame) -> DataFrame:
    """The rows in one struct column ``row``, so that their names never clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col(f"row.`{name}`")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, d1, d2): ``as_rows`` with each row's identity."""
    d1, d2 = row_identity(field(id_col), field(text_col))
    return as_rows(docs).withColumns({"d1": d1, "d2": d2})


def as_documents(docs: DataFrame, out: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from the struct again, some of them changed."""
    return out.select(*[changed.get(c, field(c)).alias(c) for c in docs.columns])
