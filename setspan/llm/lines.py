"""Line deduplication over a corpus, as compressed keep bitmaps instead of rewritten texts.

Every line long enough becomes one row (128-bit key hash, document, line number). The rows are
range-partitioned by (hash, document downwards, line), so that the rows of one line sit together
in order, a line that fills a third of the corpus is cut over many blocks, and the first row of a
run is the occurrence that stays. Inside a block a window counts the documents of a run; runs that
go on in another block are the block ends alone, at most two a block, and are counted apart.

A document is a row; rows equal in id and text are one document. A null id is smaller than all
others. Null text is one empty line. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setspan.llm.common import (
    SPACE,
    as_documents,
    ascii_lower,
    field,
    hash_pair,
    identified,
    row_identity,
    stage,
    text_of,
)

MIN_DOCS = 3
MIN_LENGTH = 20
BLOCK_ROWS = 2_000_000  # rows of a block at which more blocks are made
BITS = 64

KEY = ["h1", "h2"]
DOC = ["doc", "d1", "d2"]


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    """(h1, h2, doc, d1, d2, line): one row for each line whose key is long enough."""
    text = text_of(F.col(f"`{text_col}`"))
    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    d1, d2 = row_identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    exploded = docs.select(
        F.col(f"`{id_col}`").alias("doc"), d1.alias("d1"), d2.alias("d2"), keys.alias("keys")
    ).select(*DOC, F.posexplode("keys").alias("line", "key"))
    h1, h2 = hash_pair(F.col("key"))
    return exploded.where(F.length("key") >= min_length).select(
        h1.alias("h1"), h2.alias("h2"), *DOC, "line"
    )


def _differs(names: list[str], before: Column) -> Column:
    """Whether the row before (null: none) has other values in some of the columns."""
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(before[n])
    return before.isNull() | ~same


def dropped_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH,
    blocks: int | None = None,
) -> DataFrame:
    """(doc, d1, d2, line): the lines that go."""
    spark = docs.sparkSession
    rows = stage(line_rows(docs, id_col, text_col, min_length))
    if blocks is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(least, -(-rows.count() // BLOCK_ROWS))
    order = [F.col("doc").desc_nulls_last(), "d1", "d2", "line"]
    # Written once, so that every step sees the same cuts between blocks.
    ranged = stage(
        rows.repartitionByRange(blocks, *KEY, *order).withColumn("block", F.spark_partition_id())
    )

    # Keys that reach over a cut end one block and begin a later one.
    ends = ranged.groupBy("block").agg(
        F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high")
    )
    cut = (
        ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
        .groupBy("key")
        .count()
        .where("count > 1")
        .select("key.*")
    )
    # At most one key a cut: as few rows as there are blocks.
    cut_totals = (
        ranged.join(F.broadcast(cut), KEY)
        .groupBy(*KEY, *DOC)
        .agg(F.lit(1).alias("one"))
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("cut_docs"), F.max("doc").alias("cut_owner"))
    )

    run = Window.partitionBy("block", *KEY)
    before = F.lag(F.struct(*DOC)).over(run.orderBy(*order))
    inside = (
        ranged.withColumn("first", _differs(DOC, before).cast("int"))
        .withColumn("docs", F.sum("first").over(run))
        .withColumn("owner", F.max("doc").over(run))
        .join(F.broadcast(cut_totals), KEY, "left")
    )
    found = F.coalesce("cut_docs", "docs")
    owner = F.when(F.col("cut_docs").isNull(), F.col("owner")).otherwise(F.col("cut_owner"))
    return inside.where((found >= min_docs) & ~F.col("doc").eqNullSafe(owner)).select(*DOC, "line")


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(d1, d2, bits): per document the sparse bitmap {word of 64 lines: bits of dropped lines}.

    A set bit is a line that goes; documents that keep every line have no row.
    """
    bit = F.expr(f"shiftleft(1L, line % {BITS})")
    words = dropped.groupBy("d1", "d2", F.expr(f"line div {BITS}").cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    return words.groupBy("d1", "d2").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits")
    )


def with_bitmaps(docs: DataFrame, id_col: str, text_col: str, **rules) -> DataFrame:
    """``docs`` in a struct column ``row``, with the bitmap of its dropped lines or null."""
    bitmaps = drop_bitmaps(dropped_lines(docs, id_col, text_col, **rules))
    # The texts stream past a hash table of bitmaps; they are not sorted.
    return identified(docs, id_col, text_col).join(
        bitmaps.hint("shuffle_hash"), ["d1", "d2"], "left"
    )


def kept_text(text: Column, bits: Column) -> Column:
    """The lines without a set bit, joined by newlines."""

    def stays(_, i):
        word = F.element_at(bits, F.floor(i / BITS).cast("int"))
        return F.coalesce(F.getbit(word, i % BITS), F.lit(0)) == 0

    return F.when(bits.isNull(), text).otherwise(
        F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    )


def line_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules
) -> DataFrame:
    """Per document: lines, dropped lines, and the digest of what stays."""
    text = text_of(field(text_col))
    ones = F.aggregate(
        F.map_values("bits"), F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w)
    )
    return with_bitmaps(docs, id_col, text_col, **rules).select(
        field(id_col).alias(id_col),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(ones, F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept_text(text, F.col("bits")).cast("binary"), 256).alias("kept_sha256"),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    **rules,
) -> DataFrame:
    """``docs`` with the dropped lines taken out; a text without any stays as it is, null too."""
    rows = with_bitmaps(docs, id_col, text_col, **rules)
    text = kept_text(field(text_col), F.col("bits"))
    changed = {text_col: text}
    if chars_col in docs.columns:
        length = F.length(text).cast(docs.schema[chars_col].dataType)
        changed[chars_col] = F.when(F.col("bits").isNull(), field(chars_col)).otherwise(length)
    return as_documents(docs, rows, **changed)
