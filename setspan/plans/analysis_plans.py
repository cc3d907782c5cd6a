"""Whole analyses: contrasts of mixed id types, databases, policies and universes in one plan.

A contrast is a ship year tested with one of three databases. Its genes are spelled by its year:
part keys, names, prefixed keys, or names of no known type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.operators.analysis import RULES, analyse, conversion_outcome, map_layer
from setspan.operators.ora import with_ratios
from setspan.plans.ora_plans import BOUNDS, ROW_SQL, _rounded, ora_sql
from setspan.plans.tables import PART_SETS, PART_TABLE_SQL, part_table, table
from setspan.session import cut_lineage

SPECIES = "prt"
DATABASES = ("kegg", "go", "custom")
YEARS = range(1992, 2002)

# (policy, min_rate, fallback) by database and year; background by year.
_POLICY = {"kegg": ("threshold", 0.85, False), "custom": (None, None, False)}


def rules_of(year: int, db: str) -> tuple:
    if db == "go":
        policy = ("best-effort", None, False) if year < 1996 else ("strict", None, year == 1996)
    else:
        policy = _POLICY[db]
    id_type = "symbol" if (db, year) == ("custom", 1996) else None
    return (f"{year}/{db}", db, SPECIES, id_type, *policy, "table" if year % 2 == 0 else "sets")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([rules_of(y, d) for y in YEARS for d in DATABASES], RULES)


def spelled_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every contrast's table: the genes of its year in that year's spelling."""
    year = F.col("contrast").cast("int")
    key = F.col("gene_id")
    spelled = (
        F.when(year % 4 == 0, key)
        .when(year % 4 == 1, F.concat(F.lit("Part"), key))
        .when(year % 4 == 2, F.concat(F.lit(f"{SPECIES}:"), key))
        .otherwise(F.concat(F.lit("id-"), key))
    )
    return part_table(spark, sf).select(
        F.explode(F.array(*[F.lit(d) for d in DATABASES])).alias("db"), "contrast", spelled.alias("spelled"),
        key.cast("bigint").alias("row_no"), "value", "direction", "is_sig",
    ).select(
        F.concat_ws("/", "contrast", "db").alias("contrast"), "row_no", F.col("spelled").alias("gene_id"),
        "value", "direction", "is_sig",
    )


def part_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Names and keys of parts up to size 40, then other names of sizes 31 to 45."""
    part = table(spark, sf, "part")
    row = lambda prefix: [
        F.lit(SPECIES).alias("species"), F.lit("SYMBOL").alias("from_type"),
        F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("from_id"),
        F.col("p_partkey").cast("string").alias("entrez_id"),
    ]
    first = part.where("p_size <= 40").select(*row("Part"))
    second = part.where("p_size between 31 and 45").select(*row("Alt"))
    third = part.where("p_size between 31 and 45").select(*row("PART"))
    return map_layer(first, "catalog", 0).unionByName(map_layer(second, "local", 1)).unionByName(
        map_layer(third, "late", 2)
    )


def database_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by key (kegg), types of dear parts by name (go), sizes by name and by other ids (custom)."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    frames = [
        ("kegg", "brand", part, key),
        ("go", "type", part.where("p_retailprice >= 950"), F.concat(F.lit("Part"), key)),
        ("custom", "size", part, F.concat(F.lit("Part"), key)),
        ("custom", "other", part, F.concat(F.lit("id-"), key)),
    ]
    out = None
    for db, collection, rows, gene in frames:
        term = F.expr(PART_SETS["size" if db == "custom" else collection])
        rows = rows.select(
            F.lit(db).alias("db"), F.lit(collection).alias("collection"), term.alias("term_id"), gene.alias("gene_id")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def listed_genes(spark: SparkSession, sf: str) -> DataFrame:
    """Universe lists of two contrasts: small parts."""
    key = F.col("p_partkey").cast("string")
    both = F.array(
        F.struct(F.lit("1996/kegg").alias("contrast"), key.alias("gene_id")),
        F.struct(F.lit("1995/custom").alias("contrast"), F.concat(F.lit(" id-"), key).alias("gene_id")),
    )
    return table(spark, sf, "part").where("p_size <= 25").select(F.explode(both).alias("l")).select("l.*")


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.lit("kegg").alias("db"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("shown")
    )


def converted_query(spark: SparkSession, sf: str) -> DataFrame:
    """Conversion, universes, tests, gene lists and readable genes of all contrasts."""
    results, _ = analyse(
        cut_lineage(spelled_table(spark, sf)), database_sets(spark, sf), rules(spark),
        cut_lineage(part_layers(spark, sf)), listed_genes(spark, sf), part_names(spark, sf),
        q_cutoff=0.9, **BOUNDS,
    )
    return _rounded(with_ratios(results)).withColumn("genes", F.array_join("genes", "/"))


def outcome_query(spark: SparkSession, sf: str) -> DataFrame:
    """How the conversion of each contrast went."""
    _, outcome = conversion_outcome(spelled_table(spark, sf), rules(spark), cut_lineage(part_layers(spark, sf)))
    return outcome.withColumn("rate", F.round("rate", 6))


# -- SQL of the same ---------------------------------------------------------------------------

_RULES_SQL = "rules(contrast, db, species, id_type, policy, min_rate, fallback, background) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (bool, float)) else f"'{v}'" for v in rules_of(y, d)) + ")"
    for y in YEARS
    for d in DATABASES
) + ")"

# Ids by hand: what each spelling becomes in each database, and whether it was mapped.
_IDS_SQL = f"""{PART_TABLE_SQL}, {_RULES_SQL},
spelled AS (
  SELECT rules.contrast, db, y, CAST(k AS BIGINT) AS row_no, k, p_size, value, direction, is_sig, policy,
         coalesce(min_rate, 0.9) AS min_rate, fallback, background, rules.id_type,
         CASE y % 4 WHEN 0 THEN k WHEN 1 THEN 'Part' || k WHEN 2 THEN 'prt:' || k ELSE 'id-' || k END AS spelled
  FROM (SELECT *, CAST(contrast AS INTEGER) AS y, gene_id AS k FROM part_table) t
  JOIN part ON p_partkey = CAST(k AS BIGINT) JOIN rules ON rules.contrast = t.contrast || '/' || db),
typed AS (
  SELECT *, CASE y % 4 WHEN 0 THEN 'ENTREZID' WHEN 1 THEN 'SYMBOL' WHEN 2 THEN 'KEGG' ELSE 'unknown' END AS from_type,
    CASE WHEN id_type = 'symbol' THEN 'SYMBOL' WHEN db = 'kegg' THEN 'ENTREZID' WHEN db = 'go' THEN 'SYMBOL' END AS to_type
  FROM spelled),
targeted AS (
  SELECT *, to_type IS NOT NULL AND from_type <> 'unknown' AND from_type <> to_type AS moves,
    CASE WHEN to_type = 'ENTREZID' AND from_type = 'SYMBOL' THEN CASE WHEN p_size <= 45 THEN k END
         WHEN to_type = 'ENTREZID' AND from_type = 'KEGG' THEN k
         WHEN to_type = 'SYMBOL' AND from_type IN ('ENTREZID', 'KEGG') THEN
           CASE WHEN p_size <= 40 THEN 'Part' || k WHEN p_size <= 45 THEN 'Alt' || k END END AS target
  FROM typed),
outcome AS (
  SELECT contrast, db, from_type, to_type, background, moves, count(*) AS total, count(target) AS mapped,
    CASE WHEN NOT moves THEN 'kept'
         WHEN CASE coalesce(policy, 'threshold') WHEN 'best-effort' THEN true WHEN 'strict' THEN count(*) = count(target)
              ELSE count(target) / count(*) >= min_rate END THEN 'converted'
         WHEN fallback THEN 'fallback' ELSE 'failed' END AS status
  FROM targeted GROUP BY contrast, db, from_type, to_type, background, moves, policy, min_rate, fallback),
moved AS (
  SELECT contrast, db, direction, is_sig, spelled, k, status, background,
    CASE status WHEN 'converted' THEN coalesce(target, spelled) ELSE spelled END AS gene_id
  FROM targeted JOIN (SELECT contrast, status FROM outcome) USING (contrast) WHERE status <> 'failed')"""

ORACLES = {
    "conversion_outcome": f"""WITH {_IDS_SQL}
SELECT contrast, db, 'prt' AS species, from_type, to_type, background,
  CASE WHEN moves THEN total END AS total, CASE WHEN moves THEN mapped END AS mapped,
  CASE WHEN moves THEN round(mapped / total, 6) END AS rate, status FROM outcome""",
    "ora_converted": f"""WITH {_IDS_SQL},
db_sets AS (
  SELECT 'kegg' AS db, 'brand' AS c, {PART_SETS['brand']} AS t, CAST(p_partkey AS VARCHAR) AS g FROM part
  UNION ALL SELECT 'go', 'type', {PART_SETS['type']}, 'Part' || p_partkey FROM part WHERE p_retailprice >= 950
  UNION ALL SELECT 'custom', 'size', {PART_SETS['size']}, 'Part' || p_partkey FROM part
  UNION ALL SELECT 'custom', 'other', {PART_SETS['size']}, 'id-' || p_partkey FROM part),
listed AS (SELECT '1996/kegg' AS contrast, CAST(p_partkey AS VARCHAR) AS gene_id FROM part WHERE p_size <= 25
  UNION ALL SELECT '1995/custom', 'id-' || p_partkey FROM part WHERE p_size <= 25),
kinds AS (SELECT contrast, db, CASE WHEN contrast IN (SELECT contrast FROM listed) THEN 'list' WHEN db = 'go' THEN 'annotated'
  WHEN background = 'table' THEN 'table' ELSE 'sets' END AS universe FROM outcome),
all_hits AS (SELECT DISTINCT contrast, db, direction, gene_id FROM moved WHERE is_sig AND direction IS NOT NULL),
hits AS (SELECT contrast, direction, db || ':' || gene_id AS gene_id FROM all_hits JOIN kinds USING (contrast, db)
  WHERE universe IN ('table', 'sets')
     OR universe = 'list' AND contrast || ' ' || gene_id IN (SELECT contrast || ' ' || gene_id FROM listed)
     OR universe = 'annotated' AND db || ' ' || gene_id IN (SELECT db || ' ' || g FROM db_sets)),
sets AS (SELECT db || ':' || c AS collection, t AS term_id, db || ':' || g AS gene_id FROM db_sets),
united AS (SELECT contrast, direction, count(*) AS n FROM (
  SELECT contrast, direction, gene_id FROM all_hits
  UNION SELECT contrast, direction, g FROM (SELECT DISTINCT contrast, direction, db FROM all_hits) JOIN db_sets USING (db)) GROUP BY ALL),
u AS (SELECT contrast, direction, universe, CASE universe
    WHEN 'list' THEN (SELECT count(DISTINCT gene_id) FROM listed WHERE listed.contrast = united.contrast)
    WHEN 'annotated' THEN (SELECT count(DISTINCT g) FROM db_sets WHERE db_sets.db = kinds.db)
    WHEN 'table' THEN (SELECT count(DISTINCT gene_id) FROM moved WHERE moved.contrast = united.contrast)
    ELSE n END AS n_universe FROM united JOIN kinds USING (contrast)),
{ora_sql('hits', 'sets', 'u', 'contrast, direction', 4, 1000)},
shown AS (SELECT contrast, db || ':' || gene_id AS gene_id, gene_id AS bare,
    min(CASE WHEN status = 'converted' THEN spelled END) AS pair FROM moved GROUP BY ALL),
lists AS (SELECT contrast, direction, collection, term_id,
    string_agg(coalesce(pair, p_name, bare), '/' ORDER BY bare) AS genes
  FROM h JOIN m USING (gene_id) JOIN shown USING (contrast, gene_id)
  LEFT JOIN part ON split_part(contrast, '/', 2) = 'kegg' AND CAST(p_partkey AS VARCHAR) = bare GROUP BY ALL)
SELECT {ROW_SQL.replace(' collection,', " split_part(collection, ':', 1) AS db, split_part(collection, ':', 2) AS collection,")},
  genes, universe, overlap || '/' || n_hits AS gene_ratio, set_size || '/' || n_universe AS bg_ratio
FROM adjusted JOIN lists USING (contrast, direction, collection, term_id) JOIN (SELECT contrast, direction, universe FROM u) USING (contrast, direction)
WHERE padj <= 0.9""",
}

QUERIES = {"ora_converted": converted_query, "conversion_outcome": outcome_query}
