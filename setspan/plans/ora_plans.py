"""Over-representation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.functions import stats
from setspan.operators import de as de_ops
from setspan.operators.gene_sets import gene_vocabulary
from setspan.operators.ora import ora, with_hit_genes, with_ratios
from setspan.operators.scan import bh_adjust
from setspan.plans.tables import (
    PART_TABLE_SQL,
    PART_VALUES_SQL,
    TOKEN_SETS_SQL,
    part_sets,
    part_sets_sql,
    part_table,
    part_values,
    table,
    token_sets,
)
from setspan.session import cut_lineage

DIGITS = 6
BOUNDS = dict(min_size=4, max_size=1000)


def _rounded(df: DataFrame) -> DataFrame:
    """Counts as bigint, probabilities to the digits both engines share."""
    out = df
    for c in ("overlap", "n_hits", "set_size", "n_universe"):
        out = out.withColumn(c, F.col(c).cast("bigint"))
    for c in ("pvalue", "padj", "qvalue"):
        out = out.withColumn(c, F.round(c, DIGITS))
    return out


def _all_hits(de: DataFrame) -> DataFrame:
    return de.where("is_sig").select("contrast", F.lit("All").alias("direction"), "gene_id")


def ora_by_year(spark: SparkSession, sf: str) -> DataFrame:
    de = part_table(spark, sf)
    result = ora(
        _all_hits(de), part_sets(spark, sf), de_ops.table_universe(de), q_cutoff=1.0, **BOUNDS
    )
    return _rounded(result)


def ora_by_direction(spark: SparkSession, sf: str) -> DataFrame:
    de = part_table(spark, sf)
    result = ora(
        de_ops.directed_hits(de),
        part_sets(spark, sf),
        de_ops.table_universe(de),
        q_cutoff=1.0,
        **BOUNDS,
    )
    return _rounded(with_ratios(result))


def ora_undirected(spark: SparkSession, sf: str) -> DataFrame:
    """Even years come without directions and are tested as a whole, odd years in both directions."""
    even = F.col("contrast").cast("int") % 2 == 0
    de = part_table(spark, sf).withColumn("direction", F.when(~even, F.col("direction")))
    result = ora(
        de_ops.directed_hits(de), part_sets(spark, sf), de_ops.table_universe(de), q_cutoff=1.0, **BOUNDS
    )
    return _rounded(result)


def ora_gene_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Late gene lists: only for rows that pass the filter, joined to text."""
    de = part_table(spark, sf)
    hits, sets = de_ops.directed_hits(de), part_sets(spark, sf)
    result = ora(hits, sets, de_ops.table_universe(de), q_cutoff=0.9, **BOUNDS)
    listed = with_hit_genes(result, hits, sets)
    return _rounded(listed).withColumn("genes", F.array_join("genes", "/"))


def ora_default_background(spark: SparkSession, sf: str) -> DataFrame:
    """No universe given: all set genes united with the hits."""
    hits = de_ops.directed_hits(part_table(spark, sf))
    sets = part_sets(spark, sf)
    return _rounded(ora(hits, sets, de_ops.default_universe(hits, sets), q_cutoff=1.0, **BOUNDS))


def ora_annotated_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Universe of annotated genes: hits no set knows are dropped, N counts the set genes."""
    de = part_table(spark, sf)
    dear = table(spark, sf, "part").where("p_retailprice >= 950").select(
        F.col("p_partkey").cast("string").alias("gene_id")
    )
    sets = part_sets(spark, sf).join(dear, "gene_id", "left_semi")
    hits = de_ops.restrict_hits(de_ops.directed_hits(de), gene_vocabulary(sets))
    return _rounded(
        ora(hits, sets, de_ops.annotated_universe(sets), q_cutoff=1.0, min_size=2, max_size=1000)
    )


def ora_restricted_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Universe from a list (parts ordered at a high price): hits and sets restricted to it."""
    de = part_table(spark, sf)
    listed = table(spark, sf, "part").where("p_retailprice >= 950").select(
        F.col("p_partkey").cast("string").alias("gene_id")
    )
    hits = de_ops.restrict_hits(de_ops.directed_hits(de), listed)
    size = listed.agg(F.countDistinct("gene_id")).scalar()
    sets = part_sets(spark, sf)
    universe = sets.select("collection").distinct().withColumn("n_universe", size)
    return _rounded(
        ora(hits, sets, universe, q_cutoff=1.0, universe_genes=listed, min_size=2, max_size=1000)
    )


def ora_tokens_toxic(spark: SparkSession, sf: str) -> DataFrame:
    """Words over-represented in toxic documents of a language, among labelled documents."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("doc_id").cast("string").alias("gene_id"), "toxic")
    sets = cut_lineage(token_sets(spark, sf, labels.select("doc_id")))
    docs = (
        table(spark, sf, "documents")
        .select(F.col("lang").alias("contrast"), F.col("doc_id").cast("string").alias("gene_id"))
        .join(labels.drop("doc_id"), "gene_id")
    )
    # A document has one language, so a language's words are sets of their own collection.
    sets = sets.select(F.col("contrast").alias("collection"), "term_id", "gene_id")
    hits = docs.where("toxic = 1").select("contrast", F.lit("All").alias("direction"), "gene_id")
    universe = docs.groupBy("contrast").agg(F.countDistinct("gene_id").alias("n_universe"))
    return _rounded(ora(hits, sets, universe, q_cutoff=1.0, min_size=10, max_size=None))


def bh_query(spark: SparkSession, sf: str) -> DataFrame:
    """Correction alone: account balances as p-values, corrected per market segment."""
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_mktsegment").alias("segment"),
        ((F.col("c_acctbal") + 1000.0) / 11000.0).alias("pvalue"),
    )
    adjusted = bh_adjust(c, ["segment"])
    return adjusted.select("c_custkey", "segment", F.round("padj", DIGITS).alias("padj"))


def hypergeom_query(spark: SparkSession, sf: str) -> DataFrame:
    """Mass and upper tail for integers derived from every part row."""
    p = table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") % 12).cast("bigint").alias("k"),
        (F.col("p_size") * 2).cast("bigint").alias("n"),
        (F.col("p_partkey") % 90).cast("bigint").alias("set_size"),
        (F.lit(150) + F.col("p_partkey") % 700).cast("bigint").alias("n_universe"),
    )
    tail = stats.hypergeom_upper_tail("k", "n", "set_size", "n_universe")
    mass = stats.hypergeom_pmf("k", "n", "set_size", "n_universe")
    return p.select(
        "p_partkey",
        F.round(mass, DIGITS).alias("mass"),
        F.round(tail, DIGITS).alias("tail"),
        F.round(stats.ln_choose("n_universe", "set_size"), DIGITS).alias("ln_choose"),
    )


def direction_query(spark: SparkSession, sf: str) -> DataFrame:
    """Significance by a numeric column and direction inferred from the sign of values."""
    values = part_values(spark, sf).withColumn("score", F.abs("value").cast("string"))
    flagged = values.withColumn("is_sig", de_ops.significant("score", "numeric_gte", 20))
    directed = de_ops.with_direction(flagged, threshold=25.0)
    return directed.groupBy("contrast", "is_sig", "direction").agg(
        F.count(F.lit(1)).alias("genes"), F.round(F.sum("value"), 2).alias("total")
    )


# -- SQL of the same ---------------------------------------------------------------------------

# Upper tail straight from log-gamma, summed term by term: independent of the Spark form.
_LN = "lgamma({} + 1)"


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma(({n}) - ({k}) + 1))"


TAIL_SQL = f"""
CASE WHEN n_universe <= 0 OR set_size <= 0 OR n_hits <= 0 OR set_size > n_universe THEN 1.0
     WHEN least(overlap, set_size, n_hits, n_universe)
          <= greatest(0, least(n_hits, n_universe) + set_size - n_universe) THEN 1.0
ELSE least(1.0, list_sum(list_transform(
  range(least(overlap, set_size, n_hits, n_universe), least(n_hits, n_universe, set_size) + 1),
  lambda i: exp({_choose('set_size', 'i')}
    + {_choose('n_universe - set_size', 'least(n_hits, n_universe) - i')}
    - {_choose('n_universe', 'least(n_hits, n_universe)')})))) END"""


def ora_sql(hits: str, sets: str, universe: str, on: str, low: int, high: int | None) -> str:
    """CTEs up to ``adjusted`` from CTE names for hits, sets and universe sizes."""
    return f"""
h AS (SELECT DISTINCT contrast, direction, gene_id FROM {hits}),
m AS (SELECT DISTINCT collection, term_id, gene_id FROM {sets}),
sizes AS (SELECT collection, term_id, count(*) AS set_size FROM m GROUP BY ALL
          HAVING {f'count(*) BETWEEN {low} AND {high}' if high else f'count(*) >= {low}'}),
nh AS (SELECT contrast, direction, count(*) AS n_hits FROM h GROUP BY ALL),
counted AS (
  SELECT contrast, direction, collection, term_id, overlap, n_hits, set_size, n_universe
  FROM (SELECT contrast, direction, collection, term_id, count(*) AS overlap
        FROM h JOIN m USING (gene_id) GROUP BY ALL)
  JOIN sizes USING (collection, term_id) JOIN nh USING (contrast, direction)
  JOIN {universe} USING ({on})),
tested AS (SELECT *, {TAIL_SQL} AS pvalue FROM counted),
ranked_p AS (SELECT *, count(*) OVER (PARTITION BY contrast, direction, collection) AS m,
    row_number() OVER (PARTITION BY contrast, direction, collection ORDER BY pvalue) AS i FROM tested),
adjusted AS (SELECT *, least(1.0, min(pvalue * m / i) OVER (
    PARTITION BY contrast, direction, collection ORDER BY pvalue DESC, i DESC
    ROWS UNBOUNDED PRECEDING)) AS padj FROM ranked_p)"""


ROW_SQL = """contrast, direction, collection, term_id, CAST(overlap AS BIGINT) AS overlap,
CAST(n_hits AS BIGINT) AS n_hits, CAST(set_size AS BIGINT) AS set_size,
CAST(n_universe AS BIGINT) AS n_universe, round(pvalue, 6) AS pvalue, round(padj, 6) AS padj,
round(padj, 6) AS qvalue"""

_ALL = "hits AS (SELECT contrast, 'All' AS direction, gene_id FROM part_table WHERE is_sig)"
_DIRECTED = (
    "hits AS (SELECT contrast, direction, gene_id FROM part_table WHERE is_sig AND direction IS NOT NULL)"
)
_TABLE_U = "u AS (SELECT contrast, count(DISTINCT gene_id) AS n_universe FROM part_table GROUP BY 1)"

QUERIES = {
    "ora_by_year": ora_by_year,
    "ora_by_direction": ora_by_direction,
    "ora_undirected": ora_undirected,
    "ora_gene_lists": ora_gene_lists,
    "ora_default_background": ora_default_background,
    "ora_annotated_universe": ora_annotated_universe,
    "ora_restricted_universe": ora_restricted_universe,
    "ora_tokens_toxic": ora_tokens_toxic,
    "bh_adjust": bh_query,
    "hypergeom_tail": hypergeom_query,
    "infer_direction": direction_query,
}

ORACLES = {
    "ora_by_year": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_ALL}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)} SELECT {ROW_SQL} FROM adjusted""",
    "ora_by_direction": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)}
SELECT {ROW_SQL}, overlap || '/' || n_hits AS gene_ratio, set_size || '/' || n_universe AS bg_ratio
FROM adjusted""",
    "ora_undirected": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_TABLE_U},
hits AS (SELECT contrast, CASE WHEN contrast::INT % 2 = 0 THEN 'All' ELSE direction END AS direction, gene_id
         FROM part_table WHERE is_sig),
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)} SELECT {ROW_SQL} FROM adjusted""",
    "ora_gene_lists": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)},
lists AS (SELECT contrast, direction, collection, term_id, string_agg(gene_id, '/' ORDER BY gene_id) AS genes
          FROM h JOIN m USING (gene_id) GROUP BY ALL)
SELECT {ROW_SQL}, genes FROM adjusted JOIN lists USING (contrast, direction, collection, term_id)
WHERE padj <= 0.9""",
    "ora_default_background": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED},
u AS (SELECT contrast, direction, collection, count(*) AS n_universe FROM (
  SELECT contrast, direction, collection, s.gene_id
  FROM (SELECT DISTINCT contrast, direction FROM hits), part_sets s
  UNION SELECT contrast, direction, collection, gene_id
  FROM hits, (SELECT DISTINCT collection FROM part_sets)) GROUP BY ALL),
{ora_sql('hits', 'part_sets', 'u', 'contrast, direction, collection', 4, 1000)}
SELECT {ROW_SQL} FROM adjusted""",
    "ora_annotated_universe": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED},
rs AS (SELECT * FROM part_sets WHERE gene_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_retailprice >= 950)),
u AS (SELECT collection, count(DISTINCT gene_id) AS n_universe FROM rs GROUP BY 1),
rh AS (SELECT * FROM hits WHERE gene_id IN (SELECT gene_id FROM rs)),
{ora_sql('rh', 'rs', 'u', 'collection', 2, 1000)} SELECT {ROW_SQL} FROM adjusted""",
    "ora_restricted_universe": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED},
listed AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_id FROM part WHERE p_retailprice >= 950),
u AS (SELECT count(DISTINCT gene_id) AS n_universe, collection FROM listed,
      (SELECT DISTINCT collection FROM part_sets) GROUP BY collection),
rh AS (SELECT * FROM hits WHERE gene_id IN (SELECT gene_id FROM listed)),
rs AS (SELECT * FROM part_sets WHERE gene_id IN (SELECT gene_id FROM listed)),
{ora_sql('rh', 'rs', 'u', 'collection', 2, 1000)} SELECT {ROW_SQL} FROM adjusted""",
    "ora_tokens_toxic": f"""WITH {TOKEN_SETS_SQL},
lab AS (SELECT CAST(doc_id AS VARCHAR) AS gene_id, toxic FROM labels),
docs AS (SELECT lang AS contrast, gene_id, toxic
         FROM (SELECT lang, CAST(doc_id AS VARCHAR) AS gene_id FROM documents) JOIN lab USING (gene_id)),
sets AS (SELECT contrast AS collection, term_id, gene_id FROM token_sets
         WHERE gene_id IN (SELECT gene_id FROM lab)),
hits AS (SELECT contrast, 'All' AS direction, gene_id FROM docs WHERE toxic = 1),
u AS (SELECT contrast, count(DISTINCT gene_id) AS n_universe FROM docs GROUP BY 1),
{ora_sql('hits', 'sets', 'u', 'contrast', 10, None)} SELECT {ROW_SQL} FROM adjusted""",
    "bh_adjust": """WITH t AS (SELECT c_custkey, c_mktsegment AS segment, (c_acctbal + 1000.0) / 11000.0 AS p
  FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY p, c_custkey) AS i,
      count(*) OVER (PARTITION BY segment) AS m FROM t)
SELECT c_custkey, segment, round(greatest(0.0, least(1.0, min(p * m / i) OVER (
  PARTITION BY segment ORDER BY i DESC ROWS UNBOUNDED PRECEDING))), 6) AS padj FROM r""",
    "hypergeom_tail": f"""WITH t AS (SELECT p_partkey, CAST(p_size % 12 AS BIGINT) AS overlap,
  CAST(p_size * 2 AS BIGINT) AS n_hits, CAST(p_partkey % 90 AS BIGINT) AS set_size,
  CAST(150 + p_partkey % 700 AS BIGINT) AS n_universe FROM part)
SELECT p_partkey, round(CASE WHEN overlap <= least(n_hits, set_size)
    AND overlap >= n_hits + set_size - n_universe THEN
    exp({_choose('set_size', 'overlap')} + {_choose('n_universe - set_size', 'n_hits - overlap')}
    - {_choose('n_universe', 'n_hits')}) ELSE 0.0 END, 6) AS mass,
  round({TAIL_SQL}, 6) AS tail, round({_choose('n_universe', 'set_size')}, 6) AS ln_choose FROM t""",
    "infer_direction": f"""WITH {PART_VALUES_SQL},
f AS (SELECT *, abs(value) >= 20 AS is_sig FROM part_values),
d AS (SELECT *, CASE WHEN is_sig AND bool_or(is_sig AND value <> 1.0) OVER (PARTITION BY contrast)
  THEN CASE WHEN value > 25 THEN 'Up' WHEN value < -25 THEN 'Down' END END AS direction FROM f)
SELECT contrast, is_sig, direction, count(*) AS genes, round(sum(value), 2) AS total FROM d GROUP BY 1, 2, 3""",
}
