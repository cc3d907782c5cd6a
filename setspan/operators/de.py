"""Differential tables: significance, direction, universe, restriction to known genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.functions.ids import clean, parse_double
from setspan.operators.scan import broadcast_if_small


# Direction of the hits of a contrast that has none.
WHOLE = "All"


def significant(column: str | None, mode: str = "string", value=None) -> Column:
    """Significance flag of a row; no filter column means every row, unparsable means no."""
    if column is None:
        return F.lit(True)
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    if mode == "string":
        return text == F.lit(str(value))
    number = parse_double(text)
    if mode == "numeric_lte":
        return F.coalesce(number <= F.lit(float(value)), F.lit(False))
    if mode == "numeric_gte":
        return F.coalesce(number >= F.lit(float(value)), F.lit(False))
    raise ValueError(f"unknown filter mode {mode!r}")


def with_direction(
    de: DataFrame,
    direction_col: str | None = None,
    up: str = "Up",
    down: str = "Down",
    threshold: float = 0.0,
) -> DataFrame:
    """Add ``direction``: the table's own column, else the sign of a significant gene's value.

    Values are only trusted when some significant gene of the contrast has a value other than
    the placeholder 1.0; otherwise the direction is null and the contrast is tested as a whole.
    """
    if direction_col is not None:
        text = F.trim(F.col(direction_col))
        return de.withColumn("direction", F.when(text == up, up).when(text == down, down))
    real = de.groupBy("contrast").agg(
        F.bool_or(F.col("is_sig") & (F.col("value") != 1.0)).alias("_real")
    )
    sign = F.when(F.col("value") > threshold, up).when(F.col("value") < -threshold, down)
    return (
        de.join(broadcast_if_small(real), "contrast")
        .withColumn("direction", F.when(F.col("is_sig") & F.col("_real"), sign))
        .drop("_real")
    )


def directed_hits(de: DataFrame) -> DataFrame:
    """Distinct (contrast, direction, gene_id) of significant genes that have a direction.

    A contrast without any direction is tested as a whole: its significant genes get ``All``.
    """
    hits = de.where("is_sig").select("contrast", "direction", "gene_id").distinct()
    known = hits.groupBy("contrast").agg(F.count("direction").alias("_directed"))
    return (
        hits.join(broadcast_if_small(known), "contrast")
        .withColumn("direction", F.when(F.col("_directed") == 0, WHOLE).otherwise(F.col("direction")))
        .where(F.col("direction").isNotNull())
        .drop("_directed")
        .select("contrast", "direction", "gene_id")
    )


def unique_ids(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Distinct trimmed ids, blanks dropped."""
    keys = keys or []
    return df.select(*keys, clean(column).alias(column)).where(F.col(column).isNotNull()).distinct()


def restrict_hits(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Keep hits whose gene occurs in ``genes`` (per contrast if that column is present)."""
    on = [c for c in ("contrast", "gene_id") if c in genes.columns]
    return hits.join(genes.select(*on).distinct(), on, "left_semi")


def mappable_rows(de: DataFrame, idmap: DataFrame) -> DataFrame:
    """Keep table rows whose upper-case gene is a known ``from_id``."""
    known = idmap.select(F.upper("from_id").alias("_known")).distinct()
    return de.join(known, F.upper(F.trim(F.col("gene_id"))) == F.col("_known"), "left_semi")


def table_universe(de: DataFrame, count_repeats: bool = False) -> DataFrame:
    """Universe size per contrast from all genes of its table."""
    size = F.count("gene_id") if count_repeats else F.countDistinct("gene_id")
    return de.groupBy("contrast").agg(size.alias("n_universe"))


def annotated_universe(term_gene: DataFrame) -> DataFrame:
    """Universe size per collection from the genes its sets annotate."""
    return term_gene.groupBy("collection").agg(F.countDistinct("gene_id").alias("n_universe"))


def default_universe(hits: DataFrame, term_gene: DataFrame, keys=("contrast", "direction")) -> DataFrame:
    """Size of (all set genes united with the group's hits), per group and collection.

    Counted as set genes plus hits no set knows, so set genes are never copied per contrast.
    """
    keys = list(keys)
    distinct_hits = hits.select(*keys, "gene_id").distinct()
    genes = term_gene.select("collection", "gene_id").distinct()
    base = genes.groupBy("collection").agg(F.count("gene_id").alias("_base"))
    known = (
        distinct_hits.join(genes, "gene_id")
        .groupBy(*keys, "collection")
        .agg(F.count(F.lit(1)).alias("_known"))
    )
    total = distinct_hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    # A group only matters for collections it overlaps: sets without a hit are not tested.
    return (
        known.join(total, keys)
        .join(base, "collection")
        .select(*keys, "collection", (F.col("_base") + F.col("_hits") - F.col("_known")).alias("n_universe"))
    )
