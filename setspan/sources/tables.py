"""Differential tables, ranked lists, gene lists and result tables as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.functions.ids import clean, parse_double
from setspan.operators.de import significant
from setspan.operators.scan import broadcast_if_small
from setspan.session import cut_lineage
from setspan.sources.lines import field, folder_key, read_lines, with_fields

Paths = str | Sequence[str]
DEFAULT_VALUE = 1.0

# Words that mark a header row.
HEADER_WORDS = ("gene", "log", "fold", "pvalue", "padj", "fdr")

# Spellings of result columns.
RESULT_COLUMNS = {
    "Contrast": "contrast",
    "Collection": "collection",
    "ID": "id",
    "Name": "name",
    "Description": "description",
    "Direction": "direction",
    "PValue": "pvalue",
    "pvalue": "pvalue",
    "PAdjust": "padj",
    "p.adjust": "padj",
    "QValue": "qvalue",
    "qvalue": "qvalue",
    "NES": "nes",
    "EnrichmentScore": "es",
    "GeneRatio": "gene_ratio",
    "BgRatio": "bg_ratio",
    "Count": "overlap",
    "Genes": "genes",
    "LeadGenes": "lead_genes",
}
# Header of ranking files.
RANKED_HEADER = ("gene", "rank")

NUMBERS = ("pvalue", "padj", "qvalue", "nes", "es")


def _stem() -> Column:
    """Contrast named by the key of a partition folder, else by the file name without extensions."""
    stem = F.regexp_replace("file_name", r"(\.[A-Za-z]{2,4})?(\.gz)?\z", "")
    return F.coalesce(folder_key("contrast"), stem)


def _split_csv(line: str, sep: str, width: int) -> Column:
    """The first ``width`` fields of a line, with quotes and escapes read as a CSV reader reads them."""
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(line, ", ".join(f"{n} string" for n in names), {"sep": sep})
    return F.array(*[parsed[n] for n in names])


def _pieces(line: str, sep: str) -> Column:
    return F.size(F.split(line, "\\Q" + sep + "\\E", -1))


def _csv_fields(rows: DataFrame, sep: str, width: int) -> DataFrame:
    """Add ``f``, the fields of ``line``."""
    return rows.withColumn("f", _split_csv("line", sep, width))


def _first_lines(lines: DataFrame) -> DataFrame:
    """(_file, _first, line): the place and text of each file's first row, one row a file."""
    first = F.min(F.struct("pos", "line"))
    return lines.groupBy(F.col("pos.file").alias("_file")).agg(first.alias("_row")).select(
        "_file", F.col("_row.pos").alias("_first"), F.col("_row.line").alias("line")
    )


def _headers(lines: DataFrame, sep: str) -> tuple[DataFrame, int]:
    """(_file, _first, names) of each file's first row, and the width of the widest; one scan."""
    heads = cut_lineage(_first_lines(lines))
    width = heads.agg(F.max(_pieces("line", sep))).first()[0] or 1  # one number
    names = F.transform(_split_csv("line", sep, width), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return heads.select("_file", "_first", names.alias("names")), width


def read_de_table(
    spark: SparkSession,
    paths: Paths,
    sep: str = ",",
    gene_col: str | None = None,
    value_col: str | None = None,
    filter_col: str | None = None,
    filter_mode: str = "string",
    filter_value=None,
    direction_col: str | None = None,
) -> DataFrame:
    """(contrast, row_no, gene_id, value, direction, is_sig), one contrast per file.

    Each file's own header names its columns, in any order; the gene defaults to the first and the
    value to the second. A named gene, value or filter column that some file lacks is an error, a
    missing direction column is not. Unparsable values are 1.0. Fields may be quoted, but a quoted
    field ends on its line.
    """
    lines = read_lines(spark, paths).where(clean("line").isNotNull())
    heads, width = _headers(lines, sep)

    def place(wanted: str | None, default: int | None) -> Column:
        """1-based place of a column in the file's header, 0 if it is not there."""
        if wanted:
            return F.array_position("names", F.lit(wanted))
        return F.lit(0 if default is None else default)

    headers = heads.select(
        "_file", "_first", place(gene_col, 1).alias("_gene"), place(value_col, 2).alias("_value"),
        place(filter_col, None).alias("_filter"), place(direction_col, None).alias("_direction"),
    )
    for what, wanted in (("gene", gene_col), ("value", value_col), ("filter", filter_col)):
        if wanted and not headers.where(F.col(f"_{what}") == 0).isEmpty():
            raise ValueError(f"{what} column {wanted!r} not found in header")

    def at(place: str) -> Column:
        return F.when(F.col(place) > 0, F.get("f", (F.col(place) - 1).cast("int")))

    rows = _csv_fields(lines, sep, max(width, 2))
    found = rows.join(broadcast_if_small(headers), F.col("pos.file") == F.col("_file")).where("pos <> _first")
    tables = found.select(
        _stem().alias("contrast"),
        F.col("pos").alias("row_no"),
        clean(at("_gene")).alias("gene_id"),
        F.coalesce(parse_double(at("_value")), F.lit(DEFAULT_VALUE)).alias("value"),
        F.trim(at("_direction")).alias("direction"),
        at("_filter").alias("_flag"),
    ).where("gene_id is not null")
    passes = significant("_flag" if filter_col else None, filter_mode, filter_value)
    return tables.withColumn("is_sig", passes).drop("_flag")


def read_de_directory(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Every ``*.csv`` of a folder as one contrast each, in one scan."""
    return read_de_table(spark, folder.rstrip("/") + "/*.csv", **options)


def read_de_table_simple(spark: SparkSession, paths: Paths, sep: str = ",", has_header: bool = True) -> DataFrame:
    """Positional gene and value; a file's first row is dropped when it reads like a header."""
    lines = read_lines(spark, paths).where(clean("line").isNotNull())
    rows = _csv_fields(lines, sep, 2)
    if has_header:
        text = F.lower("line")
        worded = F.lit(False)
        for word in HEADER_WORDS:
            worded = worded | text.contains(word)
        headers = _first_lines(lines).where(worded).select(F.col("_first").alias("pos"))
        rows = rows.join(broadcast_if_small(cut_lineage(headers)), "pos", "left_anti")
    return (
        rows.where(_pieces("line", sep) >= 2)
        .select(
            _stem().alias("contrast"),
            F.col("pos").alias("row_no"),
            clean(field(0)).alias("gene_id"),
            F.coalesce(parse_double(F.trim(field(1))), F.lit(DEFAULT_VALUE)).alias("value"),
        )
        .where("gene_id is not null")
    )


def read_ranked(spark: SparkSession, paths: Paths) -> DataFrame:
    """(contrast, row_no, gene_id, value): gene and rank in either order, decided per row.

    A first row that is the header of this library's ranking files is not a gene.
    """
    lines = read_lines(spark, paths).where(clean("line").isNotNull() & ~F.col("line").startswith("#"))
    headers = _first_lines(lines).where(F.col("line") == "\t".join(RANKED_HEADER))
    rows = with_fields(lines).join(
        broadcast_if_small(cut_lineage(headers.select(F.col("_first").alias("pos")))), "pos", "left_anti"
    )
    first, second = F.trim(field(0)), F.trim(field(1))
    a, b = parse_double(first), parse_double(second)
    return rows.select(
        _stem().alias("contrast"),
        F.col("pos").alias("row_no"),
        clean(F.when(b.isNull() & a.isNotNull() & second.isNotNull(), second).otherwise(first)).alias("gene_id"),
        F.when(second.isNull(), DEFAULT_VALUE).otherwise(F.coalesce(b, a, F.lit(DEFAULT_VALUE))).alias("value"),
    ).where("gene_id is not null")


def read_gene_list(spark: SparkSession, paths: Paths) -> DataFrame:
    """One id per line with the default value; blank lines and comments are skipped."""
    rows = read_lines(spark, paths).withColumn("gene_id", clean("line"))
    return rows.where(F.col("gene_id").isNotNull() & ~F.col("gene_id").startswith("#")).select(
        _stem().alias("contrast"),
        F.col("pos").alias("row_no"), "gene_id", F.lit(DEFAULT_VALUE).alias("value"),
    )


def read_results(spark: SparkSession, paths: Paths, sep: str = "\t") -> DataFrame:
    """Result tables by the header of each file, in any known spelling and order of columns.

    Files of different spellings are united by name: a column that only some files have is null
    in the rows of the others, one that none has is left out, and of two columns of a file with
    the same meaning the first counts. NA and blank are null. The contrast is a column of the
    files this library writes, and else the name of the file or of its folder ``contrast=``.
    """
    lines = read_lines(spark, paths).where(clean("line").isNotNull())
    heads, width = _headers(lines, sep)
    known = F.create_map(*[F.lit(x) for pair in RESULT_COLUMNS.items() for x in pair])
    meant = F.transform("names", lambda x: F.try_element_at(known, x))
    wanted = list(dict.fromkeys(RESULT_COLUMNS.values()))
    placed = heads.select("_file", "_first", meant.alias("_meant"))
    # At most one row a name.
    seen = {r[0] for r in placed.select(F.explode("_meant")).distinct().collect()}
    columns = [c for c in wanted if c in seen and c != "contrast"]
    headers = placed.select(
        "_file", "_first", *[F.array_position("_meant", F.lit(c)).alias(f"_{c}") for c in ("contrast", *columns)]
    )

    def value(name: str) -> Column:
        text = F.when(F.col(f"_{name}") > 0, F.get("f", (F.col(f"_{name}") - 1).cast("int")))
        return parse_double(text) if name in NUMBERS else text

    rows = _csv_fields(lines, sep, width).join(
        broadcast_if_small(headers), F.col("pos.file") == F.col("_file")
    ).where("pos <> _first")
    contrast = F.when(F.col("_contrast") > 0, value("contrast")).otherwise(_stem())
    return rows.select(contrast.alias("contrast"), *[value(c).alias(c) for c in columns])
