"""Set-collection and catalog-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.operators import gene_sets as gs
from setspan.operators import quality as q
from setspan.operators.de import annotated_universe
from setspan.session import scratch_dir
from setspan.plans.tables import TOKEN_SETS_SQL, part_sets, part_sets_sql, table, token_sets

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

CONTRACTS = {
    "region": q.TableContract({"r_regionkey": "int", "r_name": "string"}, ["r_regionkey", "r_name"], ["r_regionkey"]),
    "nation": q.TableContract(
        {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
        ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"],
        [(["n_regionkey"], "region", ["r_regionkey"])],
    ),
    "customer": q.TableContract(
        {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double"},
        ["c_custkey", "c_name", "c_nationkey"], ["c_custkey"],
        [(["c_nationkey"], "nation", ["n_nationkey"])],
    ),
    "orders": q.TableContract(
        {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_clerk": "string"},
        ["o_orderkey", "o_custkey"], ["o_orderkey"],
        [(["o_custkey"], "customer", ["c_custkey"])],
    ),
    "lineitem": q.TableContract(
        {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_quantity": "double"},
        ["l_orderkey", "l_partkey", "l_shipdate"], ["l_orderkey", "l_linenumber"],
        [(["l_orderkey"], "orders", ["o_orderkey"]), (["l_partkey"], "part", ["p_partkey"])],
    ),
    "labels": q.TableContract(
        {"doc_id": "bigint", "quality": "int", "toxic": "int"}, ["doc_id", "quality", "toxic"], ["doc_id"],
        [(["doc_id"], "documents", ["doc_id"])],
    ),
}
ABSENT = {"o_clerk"}  # declared but not in the tables, so the contract has something to find
MINIMA = [(t, 5) for t in TABLES] + [("region", 6), ("archive", 1)]


def _tables(spark: SparkSession, sf: str, names=TABLES) -> dict[str, DataFrame]:
    return {name: table(spark, sf, name) for name in names}


def _overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """Two collections that share set ids."""
    p = table(spark, sf, "part")
    gene = F.col("p_partkey").cast("string").alias("gene_id")
    a = p.select(F.lit("c1").alias("collection"), F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("term_id"), gene)
    b = p.select(
        F.lit("c2").alias("collection"),
        F.concat(F.lit("S"), (F.col("p_partkey") % 60).cast("string")).alias("term_id"), gene,
    )
    return a.unionByName(b)


def merge_query(spark: SparkSession, sf: str) -> DataFrame:
    return gs.merge_collections(_overlapping(spark, sf), gs.select_collections("c2,c1"))


def load_query(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as sets of suppliers with positive balance; nations without one stay."""
    term = table(spark, sf, "nation").select(
        F.col("n_regionkey").cast("string").alias("collection"),
        F.col("n_nationkey").cast("string").alias("term_id"), F.col("n_name").alias("name"),
    )
    member = (
        table(spark, sf, "supplier").where("s_acctbal > 0")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_regionkey").cast("string").alias("collection"),
            F.col("n_nationkey").cast("string").alias("term_id"), F.col("s_name").alias("gene_id"),
        )
    )
    return gs.load_sets(term, member, ["collection"])


def fill_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sets whose names are placeholders of every kind."""
    kind = F.col("c_custkey") % 5
    key = F.col("c_custkey").cast("string")
    term = table(spark, sf, "customer").select(
        F.concat(F.lit("path:c"), key).alias("term_id"),
        F.when(kind == 0, "").when(kind == 1, "-").when(kind == 2, F.concat(F.lit("PATH:C"), key))
        .when(kind == 3, F.concat(F.lit("c"), key)).otherwise(F.col("c_name")).alias("name"),
        F.when(kind == 4, "kept").otherwise(" ").alias("description"),
    )
    names = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("c"), key).alias("set_id"), F.col("c_name").alias("set_name")
    )
    return gs.fill_names(term, names)


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("gene_id"), F.col("o_orderpriority").alias("term_id")
    )


def invert_query(spark: SparkSession, sf: str) -> DataFrame:
    sets = gs.invert_annotations(_annotations(spark, sf), "priority")
    return sets.groupBy("collection", "term_id").agg(
        F.count(F.lit(1)).alias("genes"), F.min("gene_id").alias("first_gene"), F.max("gene_id").alias("last_gene")
    )


def ontology_query(spark: SparkSession, sf: str) -> DataFrame:
    terms = _annotations(spark, sf).select("term_id").distinct().withColumn(
        "namespace", F.when(F.col("term_id").rlike("^[12]"), "biological_process").otherwise("molecular_function")
    )
    kept = gs.filter_ontology(_annotations(spark, sf), terms, "bp")
    return kept.distinct()


def vocabulary_query(spark: SparkSession, sf: str) -> DataFrame:
    return gs.gene_vocabulary(token_sets(spark, sf))


def universe_query(spark: SparkSession, sf: str) -> DataFrame:
    sizes = annotated_universe(part_sets(spark, sf))
    return sizes.withColumn("n_universe", F.col("n_universe").cast("bigint"))


def set_size_query(spark: SparkSession, sf: str) -> DataFrame:
    """Whole word sets of all documents per language, in the default size bounds."""
    sizes = token_sets(spark, sf).groupBy("contrast", "term_id").agg(F.count(F.lit(1)).alias("set_size"))
    return sizes.where(F.col("set_size").between(10, 500))


def coverage_query(spark: SparkSession, sf: str) -> DataFrame:
    term = part_sets(spark, sf).select("collection", "term_id").distinct()
    asked = table(spark, sf, "nation").select(
        F.when(F.col("n_regionkey") == 0, "brand").when(F.col("n_regionkey") == 1, "size")
        .otherwise(F.lower("n_name")).alias("collection")
    )
    return gs.coverage(term, asked, ["collection"])


def counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return q.row_counts(_tables(spark, sf), {"terms": "part", "idmap": "customer"})


def contract_query(spark: SparkSession, sf: str) -> DataFrame:
    return q.check_contract(spark, _tables(spark, sf), CONTRACTS)


def minima_query(spark: SparkSession, sf: str) -> DataFrame:
    need = spark.createDataFrame(MINIMA, "table_name string, min_rows bigint")
    return q.check_minima(q.row_counts(_tables(spark, sf)), need)


def verdict_query(spark: SparkSession, sf: str) -> DataFrame:
    checks = q.check_contract(spark, _tables(spark, sf), CONTRACTS)
    return q.verdict(checks, ["table_name"])


def ingest_query(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per source; dropped when nothing but one short line."""
    rows = table(spark, sf, "documents").withColumn("_drop", F.length(F.trim("text")) < 200)
    return q.ingest_stats(rows, "source", "_drop")


def observed_query(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written without the short ones, counted by language while they are written.

    ``written`` is what lies in the files.
    """
    folder = scratch_dir(spark)
    languages = ("de", "en", "es", "fr")
    counts = q.write_observed(
        table(spark, sf, "documents"), F.length(F.trim("text")) < 200, lambda kept: kept.write.parquet(folder),
        {x: F.col("lang") == x for x in languages},
    )
    written = spark.read.parquet(folder).groupBy("lang").agg(F.count(F.lit(1)).alias("written"))
    return counts.join(written, F.col("part") == F.col("lang"), "left").drop("lang")


# -- SQL of the same ---------------------------------------------------------------------------

OVERLAPPING_SQL = """ov AS (
  SELECT 'c1' AS collection, 'S' || p_size AS term_id, CAST(p_partkey AS VARCHAR) AS gene_id FROM part
  UNION ALL SELECT 'c2', 'S' || (p_partkey % 60), CAST(p_partkey AS VARCHAR) FROM part)"""


def contract_sql() -> str:
    """The declared contracts as SQL over the views, types read from the data."""
    parts = []

    def row(table_name, check, target, expected, actual, passed):
        return (
            f"SELECT '{table_name}' AS table_name, '{check}' AS check_name, '{target}' AS target, "
            f"'{expected}' AS expected, {actual} AS actual, {passed} AS passed"
        )

    for name, c in CONTRACTS.items():
        parts.append(row(name, "table", name, "present", "'present'", "true"))
        for column, kind in c.columns.items():
            found = (
                "'missing'" if column in ABSENT else
                f"(SELECT CASE any_value(typeof({column})) WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' "
                f"WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END FROM {name})"
            )
            parts.append(f"SELECT *, actual = expected FROM ({row(name, 'type', column, kind, found, 'true').rsplit(',', 1)[0]})")
        for column in c.not_null:
            n = f"(SELECT count(*) FROM {name} WHERE {column} IS NULL)"
            parts.append(row(name, "not_null", column, 0, f"CAST({n} AS VARCHAR)", f"{n} = 0"))
        key = ", ".join(c.key)
        n = f"(SELECT count(*) FROM (SELECT 1 FROM {name} GROUP BY {key} HAVING count(*) > 1))"
        parts.append(row(name, "primary_key", ",".join(c.key), 0, f"CAST({n} AS VARCHAR)", f"{n} = 0"))
        for columns, parent, parent_columns in c.foreign:
            on = " AND ".join(f"x.{a} = y.{b}" for a, b in zip(columns, parent_columns))
            n = f"(SELECT count(*) FROM {name} x WHERE NOT EXISTS (SELECT 1 FROM {parent} y WHERE {on}))"
            parts.append(row(name, "foreign_key", ",".join(columns), 0, f"CAST({n} AS VARCHAR)", f"{n} = 0"))
    return " UNION ALL ".join(parts)


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)

QUERIES = {
    "merge_collections": merge_query,
    "load_sets": load_query,
    "fill_names": fill_query,
    "invert_annotations": invert_query,
    "filter_ontology": ontology_query,
    "gene_vocabulary": vocabulary_query,
    "annotated_universe": universe_query,
    "set_size_filter": set_size_query,
    "coverage": coverage_query,
    "audit_counts": counts_query,
    "audit_contract": contract_query,
    "audit_minima": minima_query,
    "audit_verdict": verdict_query,
    "ingest_stats": ingest_query,
    "ingest_observed": observed_query,
}

ORACLES = {
    "merge_collections": f"""WITH {OVERLAPPING_SQL}
SELECT DISTINCT collection, term_id, gene_id FROM ov a
WHERE collection = 'c2' OR NOT EXISTS (SELECT 1 FROM ov b WHERE b.collection = 'c2' AND b.term_id = a.term_id)""",
    "load_sets": """SELECT CAST(n_regionkey AS VARCHAR) AS collection, CAST(n_nationkey AS VARCHAR) AS term_id,
  n_name AS name, s_name AS gene_id FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0""",
    "fill_names": """SELECT 'path:c' || c_custkey AS term_id,
  CASE WHEN c_acctbal > 0 OR c_custkey % 5 = 4 THEN c_name WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '-'
    WHEN c_custkey % 5 = 2 THEN 'PATH:C' || c_custkey ELSE 'c' || c_custkey END AS name,
  CASE WHEN c_custkey % 5 = 4 THEN 'kept' WHEN c_acctbal > 0 THEN c_name ELSE ' ' END AS description FROM customer""",
    "invert_annotations": """SELECT 'priority' AS collection, o_orderpriority AS term_id, count(DISTINCT o_custkey) AS genes,
  min(CAST(o_custkey AS VARCHAR)) AS first_gene, max(CAST(o_custkey AS VARCHAR)) AS last_gene FROM orders GROUP BY 2""",
    "filter_ontology": """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS gene_id, o_orderpriority AS term_id
FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'""",
    "gene_vocabulary": f"WITH {TOKEN_SETS_SQL} SELECT DISTINCT gene_id FROM token_sets",
    "annotated_universe": f"""WITH {part_sets_sql()} SELECT collection, count(DISTINCT gene_id) AS n_universe
FROM part_sets GROUP BY 1""",
    "set_size_filter": f"""WITH {TOKEN_SETS_SQL} SELECT contrast, term_id, count(*) AS set_size
FROM token_sets GROUP BY 1, 2 HAVING count(*) BETWEEN 10 AND 500""",
    "coverage": f"""WITH {part_sets_sql()},
asked AS (SELECT DISTINCT CASE n_regionkey WHEN 0 THEN 'brand' WHEN 1 THEN 'size' ELSE lower(n_name) END AS collection FROM nation),
have AS (SELECT collection, count(DISTINCT term_id) AS n FROM part_sets GROUP BY 1)
SELECT collection, coalesce(n, 0) AS sets, coalesce(n, 0) > 0 AS covered FROM asked LEFT JOIN have USING (collection)""",
    "audit_counts": f"""{_COUNTS} UNION ALL SELECT 'terms', count(*) FROM part
UNION ALL SELECT 'idmap', count(*) FROM customer""",
    "audit_contract": contract_sql(),
    "audit_minima": f"""WITH c AS ({_COUNTS}),
m(table_name, min_rows) AS (VALUES {', '.join(f"('{t}', CAST({n} AS BIGINT))" for t, n in MINIMA)})
SELECT table_name, min_rows, coalesce(row_count, 0) AS row_count, coalesce(row_count, 0) >= min_rows AS passed
FROM m LEFT JOIN c USING (table_name)""",
    "audit_verdict": f"""SELECT table_name, bool_and(passed) AS healthy, count(*) FILTER (NOT passed) AS failures
FROM ({contract_sql()}) GROUP BY 1""",
    "ingest_observed": """WITH d AS (SELECT lang, length(trim(text, ' ')) < 200 AS short FROM documents),
c AS (SELECT lang AS part, count(*) AS seen, count(*) FILTER (NOT short) AS kept, count(*) FILTER (short) AS dropped
  FROM d WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY 1)
SELECT l AS part, coalesce(seen, 0) AS seen, coalesce(kept, 0) AS kept, coalesce(dropped, 0) AS dropped, nullif(kept, 0) AS written
FROM (VALUES ('de'), ('en'), ('es'), ('fr')) v(l) LEFT JOIN c ON part = l
UNION ALL SELECT '*', count(*), count(*) FILTER (NOT short), count(*) FILTER (short), NULL FROM d""",
    "ingest_stats": """SELECT source, count(*) AS seen, count(*) FILTER (length(trim(text, ' ')) >= 200) AS kept,
  count(*) FILTER (length(trim(text, ' ')) < 200) AS dropped FROM documents GROUP BY 1""",
}
