"""Result, ranking, set and map files.

Parquet with full precision is the form for further work; these text forms are for people and
for tools that expect them, with rounded numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.operators.gsea import gsea_order
from setspan.operators.ora import ora_order
from setspan.sources.tables import RANKED_HEADER

FORMATS = ("tsv", "csv", "json")

# Keys of results, written first where the rows have them.
KEYS = {"contrast": "Contrast", "collection": "Collection"}


def _text(column: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in df.columns else F.lit("")


def _keys(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def _scientific(column: str) -> Column:
    return F.format_string("%.2e", F.col(column))


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    else:
        writer.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, quoteAll=False, emptyValue="")


def ora_table(df: DataFrame, numbers_as_text: bool = True) -> DataFrame:
    """The keys and columns of the over-representation file; Up before Down, then p, then id."""
    p = _scientific if numbers_as_text else F.col
    genes = F.array_join("genes", "/") if numbers_as_text else F.col("genes")
    keys = _keys(df)
    return df.orderBy(*keys, *ora_order()).select(
        *[F.col(k).alias(KEYS[k]) for k in keys],
        F.col("direction").alias("Direction"), F.col("term_id").alias("ID"), _text("name", df).alias("Name"),
        F.concat_ws("/", "overlap", "n_hits").alias("GeneRatio"),
        F.concat_ws("/", "set_size", "n_universe").alias("BgRatio"),
        p("pvalue").alias("PValue"), p("padj").alias("PAdjust"), p("qvalue").alias("QValue"),
        genes.alias("Genes"), F.col("overlap").alias("Count"), _text("description", df).alias("Description"),
    )


def gsea_table(df: DataFrame, numbers_as_text: bool = True) -> DataFrame:
    """The keys and columns of the ranked-enrichment file, by adjusted p, p and id."""
    p = _scientific if numbers_as_text else F.col
    four = (lambda c: F.format_string("%.4f", F.col(c))) if numbers_as_text else F.col
    genes = F.array_join("lead_genes", "/") if numbers_as_text else F.col("lead_genes")
    keys = _keys(df)
    return df.orderBy(*keys, *gsea_order()).select(
        *[F.col(k).alias(KEYS[k]) for k in keys],
        F.col("term_id").alias("ID"), _text("name", df).alias("Name"), four("nes").alias("NES"),
        p("pvalue").alias("PValue"), p("padj").alias("PAdjust"), p("qvalue").alias("QValue"),
        four("es").alias("EnrichmentScore"), genes.alias("LeadGenes"),
        _text("description", df).alias("Description"),
    )


def write_ora(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    _write(ora_table(df, fmt != "json"), path, fmt)


def write_gsea(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    _write(gsea_table(df, fmt != "json"), path, fmt)


def significant_digits(column: str, digits: int = 15) -> Column:
    """A double with up to that many significant digits and no trailing zeros."""
    padded = F.format_string(f"%.{digits}g", F.col(column))
    bare = F.regexp_replace(padded, r"(\.\d*?)0+(e|\z)", "$1$2")
    return F.regexp_replace(bare, r"\.(e|\z)", "$1")


def write_ranked(ranked: DataFrame, path: str) -> None:
    """gene and rank value in rank order, one folder ``contrast=...`` for each ranking."""
    gene, rank = RANKED_HEADER
    rows = ranked.orderBy("contrast", "rank").select(
        "contrast", F.col("gene_id").alias(gene), significant_digits("value").alias(rank)
    )
    rows.write.mode("overwrite").partitionBy("contrast").csv(path, sep="\t", header=True)


def gmt_lines(
    term: DataFrame, term_gene: DataFrame, keep_empty: bool = True, line_genes: int | None = None
) -> DataFrame:
    """(collection, value): id, name and sorted genes by tab; ``keep_empty=False`` leaves out sets without genes.

    With ``line_genes`` a set of more genes takes several lines of the same id and name, dealt by a
    hash of the gene; readers unite them.
    """
    rows = ["collection", "term_id"]
    members = term_gene.select(*rows, "gene_id").distinct()
    part = F.lit(0).cast("bigint")
    if line_genes:
        sizes = members.groupBy(*rows).agg(F.count(F.lit(1)).alias("_n"))
        members = members.join(sizes, rows)
        part = F.pmod(F.xxhash64("gene_id"), F.ceil(F.col("_n") / line_genes))
    lists = members.groupBy(*rows, part.alias("_part")).agg(
        F.array_sort(F.collect_list("gene_id")).alias("genes")
    )
    joined = term.join(lists, rows, "left" if keep_empty else "inner")
    genes = F.coalesce(F.array_join("genes", "\t"), F.lit(""))
    return joined.orderBy(*rows, "_part").select(
        "collection", F.concat_ws("\t", "term_id", "name", genes).alias("value")
    )


def write_gmt(
    term: DataFrame, term_gene: DataFrame, path: str, keep_empty: bool = True, line_genes: int | None = None
) -> None:
    """One folder ``collection=...`` for each collection."""
    lines = gmt_lines(term, term_gene, keep_empty, line_genes)
    lines.write.mode("overwrite").partitionBy("collection").text(path)


def write_idmap_tsv(pairs: DataFrame, path: str) -> None:
    """entrez id and symbol by tab, sorted by id text."""
    pairs.select("entrez_id", "symbol").distinct().orderBy("entrez_id", "symbol").write.mode(
        "overwrite"
    ).csv(path, sep="\t", header=False)
