"""The given tables read as set-enrichment inputs, in Spark and as SQL for the checks.

There are no genes in them, so parts, documents and vectors stand in: a contrast is a ship year
(or a language), a gene is a part (or document), sets group parts by brand, size or type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.session import cut_lineage

HIT_VALUE = 30.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def part_values(spark: SparkSession, sf: str) -> DataFrame:
    """(contrast, gene_id, value): returned minus accepted quantity of a part in a ship year."""
    flag = F.col("l_returnflag")
    signed = F.when(flag == "R", F.col("l_quantity")).when(flag == "A", -F.col("l_quantity")).otherwise(0.0)
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.year("l_shipdate").cast("string").alias("contrast"), "l_partkey")
        .agg(F.sum(signed).alias("value"))
        .select("contrast", F.col("l_partkey").cast("string").alias("gene_id"), "value")
    )


def stored_values(spark: SparkSession, sf: str) -> DataFrame:
    """``part_values`` written once: tests read a differential table several times."""
    return cut_lineage(part_values(spark, sf))


PART_VALUES_SQL = """
part_values AS (
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS contrast, CAST(l_partkey AS VARCHAR) AS gene_id,
         sum(CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0 END) AS value
  FROM lineitem GROUP BY 1, 2
)"""


def part_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored values as a differential table: significance flag and inferred direction."""
    values = stored_values(spark, sf)
    direction = F.when(F.col("value") >= HIT_VALUE, "Up").when(F.col("value") <= -HIT_VALUE, "Down")
    return values.withColumn("direction", direction).withColumn(
        "is_sig", F.abs("value") >= HIT_VALUE
    )


PART_TABLE_SQL = (
    PART_VALUES_SQL
    + """, part_table AS (
  SELECT *, CASE WHEN value >= 30 THEN 'Up' WHEN value <= -30 THEN 'Down' END AS direction,
         abs(value) >= 30 AS is_sig
  FROM part_values
)"""
)

# Parts of so many successive keys share their sets, so a set stays as large as it is however
# many parts there are: about 830 of a type, 200 of a brand, 100 of a size.
BLOCK_PARTS = 5000


def _blocked(name: str) -> str:
    block = f"CAST(CAST(floor((p_partkey - 1) / {BLOCK_PARTS}) AS BIGINT) AS STRING)"
    return f"concat({name}, '/', {block})"


# Collection name -> expression on ``part`` that names the set.
PART_SETS = {
    "brand": _blocked("p_brand"), "size": _blocked("CAST(p_size AS STRING)"), "type": _blocked("p_type")
}


def part_sets(spark: SparkSession, sf: str, *collections: str) -> DataFrame:
    """(collection, term_id, gene_id) of the wanted collections, from one scan of ``part``."""
    wanted = collections or tuple(PART_SETS)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("collection"), F.expr(PART_SETS[c]).alias("term_id"))
            for c in wanted
        ]
    )
    return table(spark, sf, "part").select(
        F.explode(pairs).alias("s"), F.col("p_partkey").cast("string").alias("gene_id")
    ).select("s.collection", "s.term_id", "gene_id")


def part_sets_sql(*collections: str) -> str:
    wanted = collections or tuple(PART_SETS)
    parts = [
        f"SELECT '{c}' AS collection, {PART_SETS[c].replace('STRING', 'VARCHAR')} AS term_id, "
        "CAST(p_partkey AS VARCHAR) AS gene_id FROM part"
        for c in wanted
    ]
    return "part_sets AS (" + " UNION ALL ".join(parts) + ")"


def token_sets(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """(contrast, collection, term_id, gene_id): words of whole document texts, per language.

    ``only`` (doc_id) restricts documents before their texts are split.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))
    documents = table(spark, sf, "documents")
    if only is not None:
        documents = documents.join(only, "doc_id", "left_semi")
    return (
        documents.select(
            F.col("lang").alias("contrast"),
            F.col("doc_id").cast("string").alias("gene_id"),
            F.explode(words).alias("term_id"),
        )
        .where("term_id <> ''")
        .select("contrast", F.lit("word").alias("collection"), "term_id", "gene_id")
    )


TOKEN_SETS_SQL = """
token_sets AS (
  SELECT DISTINCT contrast, 'word' AS collection, term_id, gene_id FROM (
    SELECT lang AS contrast, CAST(doc_id AS VARCHAR) AS gene_id,
           unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS term_id
    FROM documents) WHERE term_id <> ''
)"""
