"""Set and annotation files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.functions.ids import (
    REACTOME_SPECIES,
    after_colon,
    clean,
    display_name,
    normalize_set_id,
)
from setspan.sources.idmaps import read_gene_info
from setspan.sources.lines import field, first_wins, folder_key, read_lines, with_fields

Paths = str | Sequence[str]


def _terms_and_genes(
    rows: DataFrame, collection: Column, set_id: Column, name: Column, description: Column, genes: Column
) -> tuple[DataFrame, DataFrame]:
    """Long (term, term_gene) frames from one row per set; a repeated set keeps its first line."""
    sets = rows.select(
        collection.alias("collection"), set_id.alias("term_id"), "pos",
        name.alias("name"), description.alias("description"), genes.alias("genes"),
    )
    term = sets.groupBy("collection", "term_id").agg(
        F.min_by(F.struct("name", "description"), F.struct("pos")).alias("t")
    ).select("collection", "term_id", "t.name", "t.description")
    term_gene = (
        sets.select("collection", "term_id", F.explode("genes").alias("gene_id"))
        .where(F.col("gene_id") != "")
        .distinct()
    )
    return term, term_gene


def read_gmt(spark: SparkSession, paths: Paths, collection: str | None = None) -> tuple[DataFrame, DataFrame]:
    """GMT: id, description or NA, genes.

    The collection is given, or the key of the partition folder, or the file name's stem.
    """
    rows = with_fields(read_lines(spark, paths)).where(F.size("f") >= 3)
    stem = F.regexp_replace("file_name", r"\.gmt(\.gz)?\z", "")
    label = F.lit(collection) if collection else F.coalesce(folder_key("collection"), stem)
    description = F.when(field(1) != "NA", field(1)).otherwise("")
    return _terms_and_genes(rows, label, field(0), field(0), description, F.slice("f", 3, F.size("f") - 2))


def with_display_names(term: DataFrame) -> DataFrame:
    """Name shown for a set: description unless blank or NA, else name, else id."""
    return term.withColumn("name", display_name("description", "name", "term_id"))


def read_reactome_gmt(
    spark: SparkSession, paths: Paths, species: str, collection: str = "reactome"
) -> tuple[DataFrame, DataFrame]:
    """GMT with the name first and the stable id second; a known species keeps only its ids."""
    rows = with_fields(read_lines(spark, paths)).where(F.size("f") >= 3)
    known = REACTOME_SPECIES.get(species.strip().lower())
    if known:
        rows = rows.where(field(1).startswith(known[1]))
    genes = F.slice("f", 3, F.size("f") - 2)
    return _terms_and_genes(rows, F.lit(collection), field(1), field(0), field(0), genes)


def read_link_pairs(spark: SparkSession, paths: Paths, collection: str = "kegg") -> DataFrame:
    """Set membership from ``set <blank> gene`` pairs with prefixes."""
    rows = with_fields(
        read_lines(spark, paths).withColumn("line", F.coalesce(clean("line"), F.lit(""))), r"\s+"
    ).where(F.size("f") >= 2)
    return rows.select(
        F.lit(collection).alias("collection"),
        normalize_set_id(field(0)).alias("term_id"),
        after_colon(field(1)).alias("gene_id"),
    ).distinct()


def read_gaf(spark: SparkSession, paths: Paths) -> DataFrame:
    """(gene_id, term_id) annotations: symbol, else object id; negated rows are left out."""
    rows = read_lines(spark, paths, spread=True).where(
        ~F.col("line").startswith("!") & clean("line").isNotNull()
    )
    return (
        with_fields(rows)
        .where(F.size("f") >= 5)
        .where(~field(3).startswith("NOT"))
        .select(F.coalesce(clean(field(2)), F.trim(field(1))).alias("gene_id"), field(4).alias("term_id"))
        .distinct()
    )


def read_obo(spark: SparkSession, paths: Paths) -> DataFrame:
    """(term_id, name, namespace, definition, parents): one stanza per row, term stanzas only.

    A stanza begins with a line that starts with a bracket, whatever ends the lines.
    """
    stanzas = read_lines(spark, paths, line_sep="\n[").where(
        F.regexp_replace("line", r"^\[", "").startswith("Term]")
    )

    def tag(name: str) -> Column:
        found = F.regexp_extract("line", rf"(?m)^{name}: (.*?)\s*$", 1)
        return F.nullif(found, F.lit(""))

    parents = F.regexp_extract_all("line", F.lit(r"(?m)^(?:is_a|is_part_of): (.*?)(?: ! .*)?$"), F.lit(1))
    terms = stanzas.select(
        tag("id").alias("term_id"), tag("name").alias("name"), tag("namespace").alias("namespace"),
        tag("def").alias("definition"), F.transform(parents, lambda x: F.trim(x)).alias("parents"), "pos",
    ).where("term_id is not null")
    row = F.struct("name", "namespace", "definition", "parents")
    return terms.groupBy("term_id").agg(F.max_by(row, "pos").alias("t")).select("term_id", "t.*")


def reactome_from_entrez(
    spark: SparkSession, mapping: Paths, gene_info: Paths, species: str, collection: str = "reactome"
) -> tuple[DataFrame, DataFrame]:
    """Sets of symbols from an entrez-to-pathway file joined with gene names.

    Rows of other species, with a non-numeric id or without a known symbol are left out.
    """
    key = species.strip().lower()
    if key not in REACTOME_SPECIES:
        raise ValueError(f"unsupported species {species!r}")
    full_name = REACTOME_SPECIES[key][0]
    rows = with_fields(read_lines(spark, mapping)).where(F.size("f") >= 8)
    rows = rows.where(F.lower(F.trim(field(7))) == full_name.lower()).select(
        clean(field(0)).alias("entrez_id"), clean(field(3)).alias("term_id"),
        clean(field(5)).alias("name"), "pos",
    )
    rows = rows.where("entrez_id is not null and term_id is not null and name is not null").where(
        F.col("entrez_id").rlike(r"^[+-]?\d+\z")
    )
    to_symbol, _ = read_gene_info(spark, gene_info, key)
    joined = rows.join(to_symbol.withColumnRenamed("from_id", "entrez_id"), "entrez_id")
    named = first_wins(joined, "term_id", "name")
    term = named.select(
        F.lit(collection).alias("collection"), "term_id", "name", F.col("name").alias("description")
    )
    term_gene = joined.select(
        F.lit(collection).alias("collection"), "term_id", F.col("to_id").alias("gene_id")
    ).distinct()
    return term, term_gene
