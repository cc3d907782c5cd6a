"""Identifier files as (from_id, to_id) pairs, one frame per direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.functions.ids import SPECIES_TAXON, after_colon, clean, dash_to_null, strip_prefix, strip_version
from setspan.sources.lines import field, first_wins, last_wins, read_lines, with_fields

Paths = str | Sequence[str]


def taxon(species: str) -> int:
    key = species.strip().lower()
    if key not in SPECIES_TAXON:
        raise ValueError(f"unsupported species {species!r}")
    return SPECIES_TAXON[key]


def _pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct non-blank pairs."""
    kept = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return kept.select(F.col(left).alias("from_id"), F.col(right).alias("to_id")).distinct()


def _one_each(rows: DataFrame, left: str, right: str, last: bool = False) -> DataFrame:
    """One target per source: the first (or last) in file order."""
    kept = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(
        F.col(left).alias("from_id"), F.col(right).alias("to_id"), "pos"
    )
    return (last_wins if last else first_wins)(kept, "from_id", "to_id")


def read_gene_alias_list(spark: SparkSession, paths: Paths, species: str) -> tuple[DataFrame, DataFrame]:
    """Species gene list ``species:id ... aliases; description``.

    Returns id to primary symbol (the first alias) and upper-case alias to id; the first line,
    and within a line the first alias, wins.
    """
    rows = with_fields(read_lines(spark, paths)).where(F.size("f") >= 2)
    listed = rows.select(
        clean(strip_prefix(F.trim(field(0)), f"{species}:")).alias("id"),
        F.split(F.split(F.trim(F.element_at("f", -1)), ";", 2)[0], ",").alias("aliases"), "pos",
    )
    listed = listed.withColumn("primary", clean(F.col("aliases")[0])).where(
        "id is not null and primary is not null"
    )
    aliases = listed.select("id", "pos", F.posexplode("aliases").alias("i", "alias")).select(
        "id", F.upper(clean("alias")).alias("alias"), F.struct("pos", "i").alias("pos")
    )
    return _one_each(listed, "id", "primary"), _one_each(aliases, "alias", "id")


def read_xref_pairs(spark: SparkSession, paths: Paths, species: str) -> DataFrame:
    """(entrez_id, external_id) from two-column link tables; prefixes and blank ids dropped."""
    rows = with_fields(read_lines(spark, paths).withColumn("line", F.coalesce(clean("line"), F.lit(""))))
    left = clean(strip_prefix(F.trim(field(0)), f"{species.strip().lower()}:"))
    right = clean(after_colon(F.trim(field(1))))
    return (
        rows.where(F.size("f") >= 2)
        .select(left.alias("entrez_id"), right.alias("external_id"))
        .where("entrez_id is not null and external_id is not null")
        .distinct()
    )


def idmap_tsv_rows(spark: SparkSession, paths: Paths, species: str) -> DataFrame:
    """Every data line of ``entrez ... symbol`` files: ids, place, file and a dropped flag."""
    key = species.strip().lower()
    rows = read_lines(spark, paths).withColumn("line", clean("line")).where(
        F.col("line").isNotNull() & ~F.col("line").startswith("#")
    )
    rows = with_fields(rows)
    first = F.trim(field(0))
    own = F.lower(first).startswith(f"{key}:") if key else F.lit(False)
    bare = F.when(own, F.substring(first, len(key) + 2, 1 << 30)).otherwise(after_colon(first))
    bare = F.regexp_replace(F.trim(bare), r"(?i)^ncbi-geneid:", "")
    whole = F.size("f") >= 2
    return rows.select(
        F.when(whole, clean(bare)).alias("entrez_id"),
        F.when(whole, clean(F.element_at("f", -1))).alias("symbol"),
        "pos", "file_name",
    ).withColumn("dropped", F.col("entrez_id").isNull() | F.col("symbol").isNull())


def read_idmap_tsv(
    spark: SparkSession, paths: Paths, species: str, last: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Symbol (upper-case) to entrez and entrez to symbol; the first line wins unless ``last``."""
    rows = idmap_tsv_rows(spark, paths, species).where("not dropped")
    folded = rows.withColumn("_symbol", F.upper("symbol"))
    return _one_each(folded, "_symbol", "entrez_id", last), _one_each(rows, "entrez_id", "symbol")


def _taxon_rows(spark: SparkSession, paths: Paths, species: str, least: int) -> DataFrame:
    """Split lines of an NCBI table that belong to the species' taxon."""
    rows = with_fields(read_lines(spark, paths, spread=True).where(~F.col("line").startswith("#")))
    return rows.where((F.size("f") >= least) & (field(0).try_cast("int") == taxon(species)))


def read_gene_info(spark: SparkSession, paths: Paths, species: str) -> tuple[DataFrame, DataFrame]:
    """Entrez to symbol (first wins), and upper-case symbol, authority symbol and synonyms to entrez."""
    rows = _taxon_rows(spark, paths, species, 6).select(
        clean(field(1)).alias("entrez_id"), dash_to_null(field(2)).alias("symbol"),
        dash_to_null(field(11)).alias("authority"), F.split(field(4), r"\|").alias("synonyms"), "pos",
    ).where("entrez_id is not null")
    names = F.array_union(F.array("symbol", "authority"), F.col("synonyms"))
    back = rows.select("entrez_id", F.explode(names).alias("name")).select(
        F.upper(dash_to_null("name")).alias("name"), "entrez_id"
    )
    return _one_each(rows, "entrez_id", "symbol"), _pairs(back, "name", "entrez_id")


def _accessions(spark: SparkSession, paths: Paths, species: str, columns: Sequence[int], form) -> tuple[DataFrame, DataFrame]:
    found = F.explode(F.array(*[form(field(i)) for i in columns]))
    rows = _taxon_rows(spark, paths, species, 3).select(clean(field(1)).alias("entrez_id"), found.alias("a"))
    rows = rows.withColumn("a", F.upper("a"))
    return _pairs(rows, "a", "entrez_id"), _pairs(rows, "entrez_id", "a")


def read_gene2ensembl(spark: SparkSession, paths: Paths, species: str) -> tuple[DataFrame, DataFrame]:
    """Gene, transcript and protein ids to entrez, and back."""
    return _accessions(spark, paths, species, (2, 3, 4), dash_to_null)


def read_gene2refseq(spark: SparkSession, paths: Paths, species: str) -> tuple[DataFrame, DataFrame]:
    """RNA, protein and genomic accessions without version to entrez, and back."""
    return _accessions(spark, paths, species, (3, 5, 7), strip_version)


def read_uniprot_idmapping(spark: SparkSession, paths: Paths, species: str) -> tuple[DataFrame, DataFrame]:
    """Accession to every listed gene id, and back; a taxon column, if filled, must fit."""
    rows = with_fields(read_lines(spark, paths, spread=True)).where(F.size("f") >= 3)
    tax = clean(field(12))
    rows = rows.where(tax.isNull() | (tax.try_cast("int") == taxon(species))).select(
        clean(field(0)).alias("accession"), F.explode(F.split(field(2), ";")).alias("g")
    )
    rows = rows.withColumn("entrez_id", clean("g"))
    return _pairs(rows, "accession", "entrez_id"), _pairs(rows, "entrez_id", "accession")


def union_directions(to_entrez: DataFrame, from_entrez: DataFrame) -> DataFrame:
    """Both directions of one source as (from_id, to_id) towards ENTREZID, to be written at once.

    Writing them one after the other under one scope would drop the first. A symbol that occurs
    in both in different case keeps the spelling of the entrez side.
    """
    back = from_entrez.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    spelled = back.select(F.upper("from_id").alias("_u"), "to_id").distinct()
    extra = to_entrez.join(
        spelled, (F.upper(to_entrez["from_id"]) == spelled["_u"]) & (to_entrez["to_id"] == spelled["to_id"]),
        "left_anti",
    )
    return back.unionByName(extra).distinct()
