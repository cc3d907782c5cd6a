"""Work on set collections: selection, merging, names, inversion, universes, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setspan.functions.ids import clean, is_blank_text, is_placeholder, normalize_set_id

# Collection codes and the default request.
ALL_COLLECTIONS = ("h", "c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8")
DEFAULT_COLLECTIONS = ALL_COLLECTIONS[1:]

# Ontology codes and their namespaces.
NAMESPACES = {
    "BP": "biological_process",
    "MF": "molecular_function",
    "CC": "cellular_component",
}


def select_collections(text: str) -> list[str]:
    """Collections named by a request: blank or ``c1-c8``, ``all``, or a comma list."""
    wanted = text.strip().lower()
    if wanted in ("", "c1-c8"):
        return list(DEFAULT_COLLECTIONS)
    if wanted == "all":
        return list(ALL_COLLECTIONS)
    names = [n.strip() for n in wanted.split(",")]
    for name in names:
        if name not in ALL_COLLECTIONS:
            raise ValueError(f"unsupported collection {name!r}")
    return list(dict.fromkeys(names))


def load_sets(term: DataFrame, term_gene: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Terms with their members; a term without genes keeps one row with a null gene."""
    rows = [*keys, "term_id"]
    return term.join(term_gene.select(*rows, "gene_id").distinct(), rows, "left")


def merge_collections(term_gene: DataFrame, order: Sequence[str]) -> DataFrame:
    """Several collections as one: a set id in more than one keeps the first in request order."""
    priority = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(order))):
        priority = F.when(F.col("collection") == name, i).otherwise(priority)
    rows = term_gene.where(F.col("collection").isin(*order)).withColumn("_priority", priority)
    best = rows.groupBy("term_id").agg(F.min("_priority").alias("_priority"))
    return (
        rows.join(best, ["term_id", "_priority"])
        .select("collection", "term_id", "gene_id")
        .distinct()
    )


def fill_names(term: DataFrame, names: DataFrame) -> DataFrame:
    """Replace placeholder names and descriptions from (set_id, set_name); names are kept else."""
    known = (
        names.select(normalize_set_id("set_id").alias("_key"), clean("set_name").alias("_name"))
        .where("_name is not null")
        .groupBy("_key")
        .agg(F.min("_name").alias("_name"))
    )
    found = F.col("_name").isNotNull()
    return (
        term.withColumn("_key", normalize_set_id("term_id"))
        .join(known, "_key", "left")
        .withColumn("name", F.when(found & is_placeholder("name", "term_id"), F.col("_name")).otherwise(F.col("name")))
        .withColumn(
            "description",
            F.when(found & is_blank_text("description"), F.col("_name")).otherwise(F.col("description")),
        )
        .drop("_key", "_name")
    )


def invert_annotations(annotations: DataFrame, collection: str) -> DataFrame:
    """Gene-to-term annotations as set members."""
    return annotations.select(F.lit(collection).alias("collection"), "term_id", "gene_id").distinct()


def filter_ontology(annotations: DataFrame, go_term: DataFrame, ontology: str) -> DataFrame:
    """Annotations whose term lies in the ontology's namespace."""
    namespace = NAMESPACES[ontology.strip().upper()]
    terms = go_term.where(F.col("namespace") == namespace).select("term_id").distinct()
    return annotations.join(terms, "term_id", "left_semi")


def gene_vocabulary(term_gene: DataFrame) -> DataFrame:
    """Distinct genes in use."""
    return term_gene.select("gene_id").where("gene_id is not null").distinct()


def coverage(term: DataFrame, requested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per requested key: does the catalog hold sets for it."""
    keys = list(keys)
    counts = term.groupBy(*keys).agg(F.count(F.lit(1)).alias("sets"))
    return (
        requested.select(*keys)
        .distinct()
        .join(counts, keys, "left")
        .select(*keys, F.coalesce("sets", F.lit(0)).alias("sets"))
        .withColumn("covered", F.col("sets") > 0)
    )
