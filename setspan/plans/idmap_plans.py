"""Identifier queries: customers stand in for symbols and entrez ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.functions import ids
from setspan.operators import idmap as im
from setspan.operators.de import mappable_rows, unique_ids
from setspan.operators.ora import ora, with_hit_genes
from setspan.operators.de import directed_hits, table_universe
from setspan.operators.scan import collapse_repeats
from setspan.plans.ora_plans import BOUNDS, _DIRECTED, _TABLE_U, ora_sql
from setspan.plans.tables import (
    PART_TABLE_SQL,
    part_sets,
    part_sets_sql,
    part_table,
    table,
)

SPECIES = "cust"


def customer_map(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical map: customer name as SYMBOL, customer key as ENTREZID."""
    return table(spark, sf, "customer").select(
        F.lit(SPECIES).alias("species"), F.lit("SYMBOL").alias("from_type"),
        F.col("c_name").alias("from_id"), F.col("c_custkey").cast("string").alias("entrez_id"),
        F.lit("customer").alias("source"), "c_acctbal", "c_mktsegment",
    )


def named_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(contrast, id): every name, key and url of the tables, labelled by where it comes from."""
    wanted = [
        ("customer", "c_name"), ("nation", "n_name"), ("part", "p_brand"), ("part", "p_type"),
        ("orders", "o_orderkey"), ("pages", "url"), ("events", "event_type"),
    ]
    frames = [
        table(spark, sf, t).select(F.lit(c).alias("contrast"), F.col(c).cast("string").alias("id"))
        for t, c in wanted
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def detect_query(spark: SparkSession, sf: str) -> DataFrame:
    typed = named_ids(spark, sf).withColumn("id_type", ids.detect_id_type("id"))
    return typed.groupBy("contrast", "id_type").agg(F.count(F.lit(1)).alias("rows"))


def majority_query(spark: SparkSession, sf: str) -> DataFrame:
    return im.majority_id_type(named_ids(spark, sf))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(kind == 0, F.concat(F.lit("hsa:"), key))
        .when(kind == 1, F.concat(F.lit("hsa:ncbi-geneid:"), key))
        .when(kind == 2, F.concat(F.lit(" "), key, F.lit(" ")))
        .otherwise(key).alias("gene"),
        F.when(kind == 0, F.concat(F.lit("path:hsa"), key))
        .when(kind == 1, F.concat(F.lit("pathway:hsa"), key))
        .otherwise(F.concat(F.lit("hsa"), key)).alias("set_id"),
        F.when(kind == 3, F.concat(F.lit(".NM_"), key)).when(kind == 2, F.lit("-"))
        .otherwise(F.concat(F.lit("NM_"), key, F.lit(".2.1"))).alias("acc"),
        F.when(kind == 0, F.concat(F.lit("up:P"), key)).otherwise(F.concat(F.lit("uniprot:P"), key)).alias("prot"),
        F.col("o_orderpriority").alias("symbol"),
    )


def normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    return _variants(spark, sf).select(
        "o_orderkey",
        ids.normalize_id("gene", "ENTREZID", "hsa").alias("entrez"),
        ids.normalize_set_id("set_id").alias("set_id"),
        ids.strip_version("acc").alias("accession"),
        ids.normalize_id("prot", "UNIPROT", "hsa").alias("protein"),
        ids.normalize_id("symbol", "SYMBOL", "hsa").alias("symbol"),
        ids.after_colon("gene").alias("bare"),
    )


def lookup_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of all orders by key: map read in reverse."""
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return im.lookup_idmap(wanted, customer_map(spark, sf), SPECIES, "ENTREZID", "SYMBOL")


def two_hop_query(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixed customer keys of orders to names, and lower-case names to prefixed keys."""
    idmap = customer_map(spark, sf)
    o = table(spark, sf, "orders")
    prefixed = o.select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("id"))
    names = table(spark, sf, "customer").select(F.lower("c_name").alias("id"))
    there = im.convert_ids(prefixed, idmap, SPECIES, "KEGG", "SYMBOL")
    back = im.convert_ids(names, idmap, SPECIES, "SYMBOL", "KEGG")
    return there.select(F.lit("name").alias("kind"), "id", "target").unionByName(
        back.select(F.lit("key").alias("kind"), "id", "target")
    )


def scan_map_query(spark: SparkSession, sf: str) -> DataFrame:
    return im.scan_idmap(customer_map(spark, sf), SPECIES, "SYMBOL", "ENTREZID")


def _layers(spark: SparkSession, sf: str):
    c = customer_map(spark, sf)
    pair = [F.col("from_id"), F.col("entrez_id").alias("to_id")]
    own = [F.col("from_id"), F.col("from_id").alias("to_id")]
    return [
        ("own", c.where("c_mktsegment = 'MACHINERY'").select(*own)),
        ("building", c.where("c_mktsegment = 'BUILDING'").select(*pair)),
        ("solvent", c.where("c_acctbal > 0").select(F.col("from_id"), F.concat(F.lit("s"), "entrez_id").alias("to_id"))),
    ]


def layers_query(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "customer").select(F.col("c_name").alias("id")).unionByName(
        table(spark, sf, "supplier").select(F.col("s_name").alias("id"))
    )
    return im.convert_layers(wanted, _layers(spark, sf))


def layer_hits_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("contrast"), F.col("c_name").alias("id"))
    return im.layer_hits(im.convert_layers(rows.select("id"), _layers(spark, sf)), rows)


def _solvent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("target")
    )


def report_query(spark: SparkSession, sf: str) -> DataFrame:
    """Order rows per priority: share of rows whose customer converts."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("contrast"), F.col("o_custkey").cast("string").alias("id")
    )
    report = im.conversion_report(rows, _solvent_pairs(spark, sf), "SYMBOL", "threshold", 0.905)
    return report.withColumn("rate", F.round("rate", 6))


def _order_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("contrast"), F.col("o_orderkey").alias("row_no"),
        F.col("o_custkey").cast("string").alias("gene_id"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "F", "Up").when(F.col("o_orderstatus") == "O", "Down").alias("direction"),
        (F.col("o_totalprice") > 150000).alias("is_sig"),
    )


def apply_query(spark: SparkSession, sf: str) -> DataFrame:
    """Many customers to one nation: the first order row of a nation gives its value."""
    nations = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").cast("string").alias("id"), F.col("n_name").alias("target"))
    return im.apply_conversion(_order_table(spark, sf), nations).select(
        "contrast", "gene_id", "value", "direction", "row_no", "is_sig"
    )


def apply_same_type_query(spark: SparkSession, sf: str) -> DataFrame:
    """By a report: urgent orders are of the target type already, low ones failed; both keep their ids."""
    nations = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").cast("string").alias("id"), F.col("n_name").alias("target"))
    orders = _order_table(spark, sf)
    report = orders.select("contrast").distinct().select(
        "contrast",
        F.when(F.col("contrast").startswith("1"), "SYMBOL").otherwise("ENTREZID").alias("input_type"),
        F.lit("SYMBOL").alias("target_type"),
        (~F.col("contrast").startswith("5")).alias("passed"),
    )
    return im.apply_conversion(orders, nations, report).select(
        "contrast", "gene_id", "value", "direction", "row_no", "is_sig"
    )


def rates_query(spark: SparkSession, sf: str) -> DataFrame:
    known = _solvent_pairs(spark, sf).select(F.col("id").alias("from_id"))
    rates = im.distinct_rates(_order_table(spark, sf), known, 0.9)
    return rates.withColumn("all_rate", F.round("all_rate", 6)).withColumn("sig_rate", F.round("sig_rate", 6))


def mappable_query(spark: SparkSession, sf: str) -> DataFrame:
    known = _solvent_pairs(spark, sf).select(F.col("id").alias("from_id"))
    kept = mappable_rows(_order_table(spark, sf), known)
    return kept.select("contrast", "row_no", "gene_id")


def unique_query(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct trimmed reviewer texts: roles and event names padded with blanks."""
    e = table(spark, sf, "events").select(
        F.concat(F.lit(" "), F.col("event_type"), F.lit("  ")).alias("id"), F.lit("events").alias("contrast")
    )
    c = table(spark, sf, "conversations").select(
        F.when(F.col("role") == "user", "  ").otherwise(F.col("role")).alias("id"), F.lit("roles").alias("contrast")
    )
    return unique_ids(e.unionByName(c), "id", ["contrast"])


def _repeats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("string").alias("contrast"), F.col("l_partkey").cast("string").alias("gene_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_no"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("value"),
    )


def collapse_query(rule: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        values = ["value"] if rule == "max_abs" else ["value", "row_no"]
        return collapse_repeats(_repeats(spark, sf), ["contrast", "gene_id"], values, rule)

    return query


def display_query(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap genes of surviving sets shown as part names; small parts have a pair name."""
    de = part_table(spark, sf)
    hits, sets = directed_hits(de), part_sets(spark, sf)
    result = ora(hits, sets, table_universe(de), q_cutoff=0.9, **BOUNDS)
    listed = with_hit_genes(result, hits, sets)
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size", "p_type", "p_name")
    pairs = p.where("p_size <= 10").select("id", F.concat(F.lit("pair-"), "id").alias("shown"))
    symbols = p.where("p_type not like 'STANDARD%'").select("id", F.col("p_name").alias("shown"))
    keys = ["contrast", "direction", "collection", "term_id"]
    shown = im.display_genes(listed, keys, "genes", pairs, symbols)
    return shown.select(*keys, F.array_join("genes", "/").alias("genes"))


# -- SQL of the same ---------------------------------------------------------------------------


def detect_sql(c: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(trim({c}), '{pattern}') THEN '{name}'" for name, pattern in ids.ID_PATTERNS
    )
    return f"CASE {whens} ELSE 'unknown' END"


NAMED_SQL = "named AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS contrast, CAST({c} AS VARCHAR) AS id FROM {t}"
    for t, c in [
        ("customer", "c_name"), ("nation", "n_name"), ("part", "p_brand"), ("part", "p_type"),
        ("orders", "o_orderkey"), ("pages", "url"), ("events", "event_type"),
    ]
) + ")"

REPEATS_SQL = """rep AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS contrast, CAST(l_partkey AS VARCHAR) AS gene_id,
  l_orderkey * 100 + l_linenumber AS row_no, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS value
  FROM lineitem)"""

ORDER_SQL = """ord AS (SELECT o_orderpriority AS contrast, o_orderkey AS row_no, CAST(o_custkey AS VARCHAR) AS gene_id,
  o_totalprice AS value, CASE o_orderstatus WHEN 'F' THEN 'Up' WHEN 'O' THEN 'Down' END AS direction,
  o_totalprice > 150000 AS is_sig FROM orders)"""

SOLVENT_SQL = "solvent AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS target FROM customer WHERE c_acctbal > 0)"

LAYERS_SQL = """layers AS (
  SELECT 0 AS priority, 'own' AS layer, c_name AS id, c_name AS target FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT 1, 'building', c_name, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 2, 'solvent', c_name, 's' || c_custkey FROM customer WHERE c_acctbal > 0),
best AS (SELECT id, min(priority) AS priority FROM layers WHERE target <> id GROUP BY 1),
found AS (SELECT DISTINCT id, target, layer FROM layers JOIN best USING (id, priority))"""

QUERIES = {
    "detect_id_type": detect_query,
    "majority_id_type": majority_query,
    "normalize_ids": normalize_query,
    "idmap_lookup": lookup_query,
    "idmap_two_hop": two_hop_query,
    "idmap_scan": scan_map_query,
    "idmap_layers": layers_query,
    "idmap_layer_hits": layer_hits_query,
    "conversion_report": report_query,
    "apply_conversion": apply_query,
    "apply_conversion_same_type": apply_same_type_query,
    "conversion_rates": rates_query,
    "mappable_rows": mappable_query,
    "unique_ids": unique_query,
    "collapse_first": collapse_query("first"),
    "collapse_last": collapse_query("last"),
    "collapse_max_abs": collapse_query("max_abs"),
    "display_genes": display_query,
}

ORACLES = {
    "detect_id_type": f"""WITH {NAMED_SQL} SELECT contrast, {detect_sql('id')} AS id_type, count(*) AS rows
FROM named GROUP BY 1, 2""",
    "majority_id_type": f"""WITH {NAMED_SQL},
t AS (SELECT contrast, {detect_sql('id')} AS t, count(*) AS n FROM named GROUP BY 1, 2)
SELECT contrast, CAST(sum(n) AS BIGINT) AS ids,
  CASE WHEN max(n) FILTER (t <> 'unknown') / sum(n) > 0.5 THEN arg_max(t, n) FILTER (t <> 'unknown') ELSE 'unknown' END AS id_type
FROM t GROUP BY 1""",
    "normalize_ids": """SELECT o_orderkey, k AS entrez, 'hsa' || k AS set_id,
  CASE o_orderkey % 4 WHEN 3 THEN '.NM_' || k WHEN 2 THEN NULL ELSE 'NM_' || k END AS accession,
  'P' || k AS protein, upper(o_orderpriority) AS symbol,
  CASE o_orderkey % 4 WHEN 1 THEN 'ncbi-geneid:' || k WHEN 2 THEN ' ' || k || ' ' ELSE k END AS bare
FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders)""",
    "idmap_lookup": """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, c_name AS target
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "idmap_two_hop": """SELECT DISTINCT 'name' AS kind, 'cust:' || o_custkey AS id, c_name AS target
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'key', lower(c_name), 'cust:' || c_custkey FROM customer""",
    "idmap_scan": "SELECT c_name AS from_id, CAST(c_custkey AS VARCHAR) AS to_id FROM customer",
    "idmap_layers": f"""WITH {LAYERS_SQL},
ids AS (SELECT c_name AS id FROM customer UNION SELECT s_name FROM supplier)
SELECT id, coalesce(target, id) AS target, layer FROM ids LEFT JOIN found USING (id)""",
    "idmap_layer_hits": f"""WITH {LAYERS_SQL}
SELECT c_mktsegment AS contrast, layer, count(*) AS hits FROM (SELECT DISTINCT c_mktsegment, c_name FROM customer)
JOIN (SELECT DISTINCT id, layer FROM found) ON id = c_name GROUP BY 1, 2""",
    "conversion_report": f"""WITH {SOLVENT_SQL},
r AS (SELECT o_orderpriority AS contrast, count(*) AS total, count(target) AS mapped
  FROM orders LEFT JOIN solvent ON id = CAST(o_custkey AS VARCHAR) GROUP BY 1)
SELECT contrast, total, mapped, total - mapped AS unmapped, round(mapped / total, 6) AS rate,
  'ENTREZID' AS input_type, 'SYMBOL' AS target_type, 'threshold' AS policy, mapped / total >= 0.905 AS passed FROM r""",
    "apply_conversion": f"""WITH {ORDER_SQL}
SELECT contrast, n_name AS gene_id, arg_min(value, row_no) AS value,
  arg_min({{'d': direction}}, row_no).d AS direction, min(row_no) AS row_no, bool_or(is_sig) AS is_sig
FROM ord JOIN customer ON gene_id = CAST(c_custkey AS VARCHAR) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "apply_conversion_same_type": f"""WITH {ORDER_SQL}
SELECT contrast, CASE WHEN contrast[1] IN ('1', '5') THEN gene_id ELSE n_name END AS gene_id,
  arg_min(value, row_no) AS value, arg_min({{'d': direction}}, row_no).d AS direction, min(row_no) AS row_no,
  bool_or(is_sig) AS is_sig
FROM ord LEFT JOIN customer ON gene_id = CAST(c_custkey AS VARCHAR) LEFT JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2""",
    "conversion_rates": f"""WITH {ORDER_SQL}, {SOLVENT_SQL},
d AS (SELECT contrast, gene_id, bool_or(is_sig) AS s, any_value(target) IS NOT NULL AS hit
  FROM ord LEFT JOIN solvent ON id = gene_id GROUP BY 1, 2),
c AS (SELECT contrast, count(*) AS all_total, count(*) FILTER (hit) AS all_mapped, count(*) FILTER (s) AS sig_total,
  count(*) FILTER (s AND hit) AS sig_mapped FROM d GROUP BY 1)
SELECT *, round(all_mapped / all_total, 6) AS all_rate, round(sig_mapped / sig_total, 6) AS sig_rate,
  sig_mapped / sig_total >= 0.9 AS passed FROM c""",
    "mappable_rows": f"""WITH {ORDER_SQL}, {SOLVENT_SQL}
SELECT contrast, row_no, gene_id FROM ord WHERE gene_id IN (SELECT id FROM solvent)""",
    "unique_ids": """SELECT DISTINCT 'events' AS contrast, event_type AS id FROM events
UNION SELECT DISTINCT 'roles', role FROM conversations WHERE role <> 'user'""",
    "collapse_first": f"WITH {REPEATS_SQL} SELECT contrast, gene_id, arg_min(value, (row_no, value)) AS value, min(row_no) AS row_no FROM rep GROUP BY 1, 2",
    "collapse_last": f"WITH {REPEATS_SQL} SELECT contrast, gene_id, arg_max(value, (row_no, value)) AS value, max(row_no) AS row_no FROM rep GROUP BY 1, 2",
    "collapse_max_abs": f"WITH {REPEATS_SQL} SELECT contrast, gene_id, arg_max(value, (abs(value), value)) AS value FROM rep GROUP BY 1, 2",
    "display_genes": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)},
shown AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_id, CASE WHEN p_size <= 10 THEN 'pair-' || p_partkey
  WHEN p_type NOT LIKE 'STANDARD%' THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS s FROM part)
SELECT contrast, direction, collection, term_id, string_agg(s, '/' ORDER BY gene_id) AS genes
FROM h JOIN m USING (gene_id) JOIN shown USING (gene_id)
JOIN (SELECT * FROM adjusted WHERE padj <= 0.9) USING (contrast, direction, collection, term_id) GROUP BY 1, 2, 3, 4""",
}
