"""Files and catalog: tables written in an exchange form and read back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.catalog.store import Catalog, CollectionKey
from setspan.operators.de import directed_hits, table_universe
from setspan.operators.gsea import gsea
from setspan.operators.idmap import lookup_idmap
from setspan.operators.ora import ora, ora_sized, with_hit_genes
from setspan.operators.scan import HUB_ROWS
from setspan.operators.score import rank_genes
from setspan.plans.gsea_plans import HIGH, LOW, VECTOR_NULL_SQL
from setspan.plans.ora_plans import _DIRECTED, _TABLE_U, BOUNDS, ROW_SQL, _rounded, ora_sql
from setspan.plans.tables import (
    HIT_VALUE,
    PART_TABLE_SQL,
    PART_VALUES_SQL,
    part_sets,
    part_sets_sql,
    part_table,
    stored_values,
    table,
)
from setspan.session import scratch_dir
from setspan.sinks.files import write_gmt, write_gsea, write_idmap_tsv, write_ora, write_ranked
from setspan.sources.idmaps import read_idmap_tsv
from setspan.sources.sets import read_gmt
from setspan.sources.tables import (
    read_de_table,
    read_de_table_simple,
    read_gene_list,
    read_ranked,
    read_results,
)
from setspan.streaming.ora_stream import ora_incremental, ora_incremental_parts, read_incremental

KEY = CollectionKey("kegg", "hsa")
P_CUTOFF = 0.2


def customer_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every customer as a set of its orders; customers without orders are empty sets."""
    label = F.lit("orders").alias("collection")
    term = table(spark, sf, "customer").select(
        label, F.col("c_custkey").cast("string").alias("term_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
    )
    term_gene = table(spark, sf, "orders").select(
        label, F.col("o_custkey").cast("string").alias("term_id"), F.col("o_orderkey").cast("string").alias("gene_id")
    )
    return term, term_gene


def gmt_query(spark: SparkSession, sf: str) -> DataFrame:
    """All customer sets through a GMT file; sets without genes are left out."""
    folder = scratch_dir(spark)
    write_gmt(*customer_sets(spark, sf), folder, keep_empty=False)
    term, term_gene = read_gmt(spark, folder, "orders")
    return term.select("term_id", "description").join(term_gene, "term_id").select(
        "collection", "term_id", "description", "gene_id"
    )


def catalog_query(spark: SparkSession, sf: str) -> DataFrame:
    """All customer sets into the catalog and back; empty sets stay."""
    catalog = Catalog(spark, scratch_dir(spark))
    catalog.replace_sets(KEY, *customer_sets(spark, sf), "ENTREZID", "v1")
    return catalog.load(KEY).select("db", "species", "term_id", "name", "description", "gene_id")


def catalog_map_query(spark: SparkSession, sf: str) -> DataFrame:
    """Names to keys stored from the reverse direction, then looked up for all orders."""
    catalog = Catalog(spark, scratch_dir(spark))
    pairs = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("from_id"), F.col("c_name").alias("to_id")
    )
    catalog.sync_idmap("cust", "customer", "ENTREZID", "SYMBOL", lambda: pairs)
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return lookup_idmap(wanted, catalog.table("idmap"), "cust", "ENTREZID", "SYMBOL")


def idmap_file_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customer map through its text file; segments as symbols, so the first line of each wins."""
    folder = scratch_dir(spark)
    pairs = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("entrez_id"), F.col("c_mktsegment").alias("symbol")
    )
    write_idmap_tsv(pairs, folder)
    forward, back = read_idmap_tsv(spark, folder, "cust")
    return forward.select(F.lit("forward").alias("kind"), "from_id", "to_id").unionByName(
        back.select(F.lit("back").alias("kind"), "from_id", "to_id")
    )


def result_file_query(spark: SparkSession, sf: str) -> DataFrame:
    """Test results of all contrasts and collections through the text file, with its three digits of p."""
    de = part_table(spark, sf)
    hits, sets = directed_hits(de), part_sets(spark, sf)
    tested = with_hit_genes(ora(hits, sets, table_universe(de), q_cutoff=0.9, **BOUNDS), hits, sets)
    folder = scratch_dir(spark)
    write_ora(tested, folder)
    back = read_results(spark, folder)
    return back.select(
        "contrast", "collection", "direction", "id", "gene_ratio", "bg_ratio", "genes",
        F.col("overlap").cast("bigint").alias("overlap"), "pvalue",
    )


# Headers and fields of result files: the two spellings, in three orders of columns.
MIXED = [
    (["ID", "Name", "PValue", "PAdjust", "QValue"], ["id", "title", "p", "padj", "q"]),
    (["qvalue", "p.adjust", "ID", "pvalue", "NES", "Description"], ["q", "padj", "id", "p", "nes", "title"]),
    (["Contrast", "NES", "PAdjust", "ID", "other", "PValue"], ["kept", "nes", "padj", "id", "title", "p"]),
]


def result_files_mixed_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as result rows of their nation, in files of several spellings read at once."""
    digits = lambda c: F.format_string("%.6f", c)
    p = (F.col("c_acctbal") + 1000.0) / 11000.0
    rows = table(spark, sf, "customer").select(
        F.format_string("nation%02d", "c_nationkey").alias("contrast"), (F.col("c_nationkey") % 3).alias("form"),
        F.col("c_custkey").cast("string").alias("id"),
        # A title with the separator and quotes in it.
        F.concat(F.lit('"a\t'), "c_name", F.lit('"')).alias("title"), digits(p).alias("p"),
        F.when(F.col("c_custkey") % 7 == 0, "NA").otherwise(digits(p / 2)).alias("padj"),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(digits(p / 3)).alias("q"), digits(p * 4 - 2).alias("nes"),
        F.concat(F.lit("kept "), "c_mktsegment").alias("kept"),
    )
    body, head = F.lit(None), F.lit(None)
    for form, (names, fields) in enumerate(MIXED):
        body = F.when(F.col("form") == form, F.concat_ws("\t", *fields)).otherwise(body)
        head = F.when(F.col("form") == form, "\t".join(names)).otherwise(head)
    lines = rows.select("contrast", F.lit(1).alias("k"), body.alias("line")).unionByName(
        rows.select("contrast", "form").distinct().select("contrast", F.lit(0).alias("k"), head.alias("line"))
    )
    folder = scratch_dir(spark)
    _text_files(lines.repartition("contrast").sortWithinPartitions("contrast", "k"), folder, "line")
    return read_results(spark, folder).select(
        "contrast", "id", "name", "description", "pvalue", "padj", "qvalue", "nes"
    )


def gsea_file_query(spark: SparkSession, sf: str) -> DataFrame:
    """Enrichment results within a cutoff of raw p through the text file."""
    result = gsea(
        stored_values(spark, sf), part_sets(spark, sf), n_perm=1000, seed=7, min_size=LOW, max_size=HIGH,
        padj_cutoff=None, p_cutoff=P_CUTOFF,
    )
    folder = scratch_dir(spark)
    write_gsea(result, folder)
    back = read_results(spark, folder)
    return back.select("contrast", "collection", "id", "nes", "pvalue", "padj", "es", "lead_genes")


def set_file_query(spark: SparkSession, sf: str) -> DataFrame:
    """All part collections through one set file tree, in lines of at most about 50 genes."""
    folder = scratch_dir(spark)
    members = part_sets(spark, sf)
    term = members.select("collection", "term_id", F.concat(F.lit("set "), "term_id").alias("name")).distinct()
    write_gmt(term, members, folder, line_genes=50)
    term, term_gene = read_gmt(spark, folder)
    return term.select("collection", "term_id", "description").join(term_gene, ["collection", "term_id"])


def ranked_file_query(spark: SparkSession, sf: str) -> DataFrame:
    """The rankings of all contrasts through ranking files, one folder each."""
    folder = scratch_dir(spark)
    write_ranked(rank_genes(stored_values(spark, sf)), folder)
    return read_ranked(spark, folder).select("contrast", "gene_id", "value")


def _text_files(rows: DataFrame, folder: str, name: str) -> None:
    """(contrast, line) rows as one folder of text for each contrast."""
    rows.select("contrast", F.col(name).alias("value")).write.partitionBy("contrast").text(folder)


def de_directory_query(spark: SparkSession, sf: str) -> DataFrame:
    """A differential table per ship year, odd years with their columns in another order."""
    folder = scratch_dir(spark)
    values = stored_values(spark, sf).select(
        "contrast", "gene_id", "value", (F.col("contrast").cast("int") % 2 == 1).alias("odd"),
        F.when(F.abs("value") >= HIT_VALUE, "TRUE").otherwise("FALSE").alias("flag"),
    )
    head = F.when(F.col("odd"), "significant,value,gene").otherwise("gene,value,significant")
    body = F.when(F.col("odd"), F.concat_ws(",", "flag", "value", "gene_id")).otherwise(
        F.concat_ws(",", "gene_id", "value", "flag")
    )
    lines = values.select("contrast", F.lit(1).alias("k"), body.alias("line")).unionByName(
        values.select("contrast", "odd").distinct().select("contrast", F.lit(0).alias("k"), head.alias("line"))
    )
    # One file a table: the header leads it.
    spread = lines.repartition("contrast").sortWithinPartitions("contrast", "k")
    _text_files(spread, folder, "line")
    return read_de_table(
        spark, folder, gene_col="gene", value_col="value", filter_col="significant", filter_value="TRUE"
    ).select("contrast", "gene_id", "value", "is_sig")


def de_simple_query(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted customer names with a comma and balances, by position, one table per segment."""
    folder = scratch_dir(spark)
    line = F.concat(F.lit('"'), "c_name", F.lit(', Inc",'), F.col("c_acctbal").cast("string"))
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("contrast"), line.alias("line"))
    _text_files(rows, folder, "line")
    return read_de_table_simple(spark, folder).select("contrast", "gene_id", "value")


def gene_list_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names as gene lists, one per segment."""
    folder = scratch_dir(spark)
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("contrast"), F.col("c_name").alias("line"))
    _text_files(rows, folder, "line")
    return read_gene_list(spark, folder).select("contrast", "gene_id", "value")


def catalog_replace_query(spark: SparkSession, sf: str) -> DataFrame:
    """A collection replaced by another and next to a third: only the last version is read."""
    catalog = Catalog(spark, scratch_dir(spark))
    term, term_gene = customer_sets(spark, sf)
    catalog.replace_sets(KEY, term, term_gene, "ENTREZID", "v1")
    catalog.replace_sets(CollectionKey("kegg", "mmu"), term, term_gene, "ENTREZID", "v1")
    late = term.where("description = 'BUILDING'")
    catalog.replace_sets(KEY, late, term_gene, "ENTREZID", "v2")
    return catalog.table("term_gene").select("db", "species", "term_id", "gene_id")


def catalog_concurrent_query(spark: SparkSession, sf: str) -> DataFrame:
    """A reader planned before a replacement, two writers of which one loses, and a failed one.

    The reader gives the old rows and a new one the rows of the writer that won.
    """
    catalog = Catalog(spark, scratch_dir(spark))
    term, term_gene = customer_sets(spark, sf)
    catalog.replace_sets(KEY, term, term_gene, "ENTREZID", "v1")
    before = catalog.load(KEY)
    seen = catalog.head("dataset", KEY.values())
    late = term.where("description = 'BUILDING'")
    catalog.replace_sets(KEY, late, term_gene, "ENTREZID", "v2", after=seen)
    lost = 0
    for writer in (lambda: catalog.replace_sets(KEY, term.limit(1), term_gene, "ENTREZID", "v3", after=seen),
                   lambda: catalog.replace_sets(KEY, term.withColumn("name", F.raise_error(F.lit("no source"))), term_gene, "ENTREZID", "v4")):
        try:
            writer()
        except Exception:  # noqa: BLE001  the loser's conflict, the failed producer's error
            lost += 1
    catalog.vacuum()
    version = catalog.table("dataset").select("version").scalar()
    rows = ["term_id", "name", "gene_id"]
    return before.select(F.lit("before").alias("reader"), F.lit("v1").alias("version"), F.lit(0).alias("lost"), *rows).unionByName(
        catalog.load(KEY).select(F.lit("after").alias("reader"), version.alias("version"), F.lit(lost).alias("lost"), *rows)
    )


def catalog_tests(spark: SparkSession, sf: str, buckets: int = 16) -> DataFrame:
    """Over-representation with the catalog's sets, laid out by gene: they are not shuffled."""
    catalog = Catalog(spark, scratch_dir(spark))
    keys = []
    sets = part_sets(spark, sf)
    for collection in ("brand", "size", "type"):
        members = sets.where(F.col("collection") == collection)
        keys.append(CollectionKey("part", collection=collection))
        terms = members.select("term_id", F.col("term_id").alias("name"), F.lit("").alias("description")).distinct()
        catalog.replace_sets(keys[-1], terms, members, "ENTREZID", "v1")
    catalog.store_by_gene("tests", keys, buckets)
    stored, facts = catalog.by_gene("tests")
    de = part_table(spark, sf)
    fits = stored.where(F.col("set_size").between(BOUNDS["min_size"], BOUNDS["max_size"]))
    hits = directed_hits(de).repartition(facts["buckets"], "gene_id")
    return ora_sized(
        hits, fits, table_universe(de), facts["most_of_a_gene"] > HUB_ROWS, max_size=facts["largest_set"], q_cutoff=1.0
    )


def ora_catalog_query(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(catalog_tests(spark, sf)).withColumn("collection", F.element_at(F.split("collection", "/"), -1))


def resume_query(spark: SparkSession, sf: str) -> DataFrame:
    """Map scopes filled once: a second run skips those that have rows, unless it is forced."""
    catalog = Catalog(spark, scratch_dir(spark))
    pairs = table(spark, sf, "customer").select(F.col("c_name").alias("from_id"), F.col("c_custkey").cast("string").alias("to_id"), "c_mktsegment")
    part = lambda segment: lambda: pairs.where(F.col("c_mktsegment") == segment).drop("c_mktsegment")
    for source, segment, force in (
        ("a", "BUILDING", False), ("b", "MACHINERY", False), ("a", "FURNITURE", False), ("b", "HOUSEHOLD", True),
        ("c", "nobody", False), ("c", "AUTOMOBILE", False),
    ):
        catalog.sync_idmap("cust", source, "SYMBOL", "ENTREZID", part(segment), force)
    return catalog.table("idmap").select("source", "from_type", "from_id", "entrez_id")


def incremental_query(spark: SparkSession, sf: str) -> DataFrame:
    """Contrasts that land in two runs, tested as they come."""
    landing, out, state = (scratch_dir(spark) for _ in range(3))
    de = part_table(spark, sf).select("contrast", "gene_id", "value", "direction", "is_sig")
    for part in ("contrast < '1995'", "contrast >= '1995'"):
        # One file a contrast.
        rows = de.where(part).repartition("contrast").withColumn("_folder", F.col("contrast"))
        rows.write.mode("append").partitionBy("_folder").parquet(landing)
        ora_incremental(
            spark, f"{landing}/*", part_sets(spark, sf), out, state, q_cutoff=1.0, **BOUNDS
        ).awaitTermination()
    return _rounded(read_incremental(spark, out).drop("batch_id"))


def incremental_parts_query(spark: SparkSession, sf: str) -> DataFrame:
    """Contrasts in four files each, which land in two runs; each is tested when its last part is there."""
    landing, stated, out, state = (scratch_dir(spark) for _ in range(4))
    de = part_table(spark, sf).select("contrast", "gene_id", "value", "direction", "is_sig")
    part = F.pmod(F.crc32("gene_id"), F.lit(4))
    sizes = de.select("contrast", part.alias("part")).groupBy("contrast").agg(F.countDistinct("part").alias("n_files"))
    sizes.write.parquet(stated)
    for those in (part == 0, part > 0):
        rows = de.withColumns({"_folder": F.col("contrast"), "_part": part}).where(those)
        rows.repartition("contrast", "_part").write.mode("append").partitionBy("_folder", "_part").parquet(landing)
        ora_incremental_parts(
            spark, f"{landing}/*/*", stated, part_sets(spark, sf), out, state, q_cutoff=1.0, **BOUNDS
        ).awaitTermination()
    return _rounded(read_incremental(spark, out).drop("batch_id"))


QUERIES = {
    "gmt_round_trip": gmt_query,
    "catalog_round_trip": catalog_query,
    "catalog_idmap": catalog_map_query,
    "idmap_file": idmap_file_query,
    "result_file": result_file_query,
    "result_files_mixed": result_files_mixed_query,
    "gsea_file": gsea_file_query,
    "set_file": set_file_query,
    "ranked_file": ranked_file_query,
    "de_directory": de_directory_query,
    "de_simple": de_simple_query,
    "gene_list": gene_list_query,
    "catalog_replace": catalog_replace_query,
    "catalog_concurrent": catalog_concurrent_query,
    "ora_catalog": ora_catalog_query,
    "catalog_resume": resume_query,
    "ora_incremental": incremental_query,
    "ora_incremental_parts": incremental_parts_query,
}

ORACLES = {
    "gmt_round_trip": """SELECT 'orders' AS collection, CAST(c_custkey AS VARCHAR) AS term_id, c_name AS description,
  CAST(o_orderkey AS VARCHAR) AS gene_id FROM customer JOIN orders ON o_custkey = c_custkey""",
    "catalog_round_trip": """SELECT 'kegg' AS db, 'hsa' AS species, CAST(c_custkey AS VARCHAR) AS term_id, c_name AS name,
  c_mktsegment AS description, CAST(o_orderkey AS VARCHAR) AS gene_id
FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
    "catalog_idmap": """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, c_name AS target
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "idmap_file": """SELECT 'forward' AS kind, upper(c_mktsegment) AS from_id, min(CAST(c_custkey AS VARCHAR)) AS to_id
FROM customer GROUP BY 2 UNION ALL SELECT 'back', CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer""",
    "result_file": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)},
lists AS (SELECT contrast, direction, collection, term_id, string_agg(gene_id, '/' ORDER BY gene_id) AS genes
          FROM h JOIN m USING (gene_id) GROUP BY ALL)
SELECT contrast, collection, direction, term_id AS id, overlap || '/' || n_hits AS gene_ratio, set_size || '/' || n_universe AS bg_ratio,
  genes, overlap, CAST(printf('%.2e', pvalue) AS DOUBLE) AS pvalue
FROM adjusted JOIN lists USING (contrast, direction, collection, term_id) WHERE padj <= 0.9""",
    "result_files_mixed": """WITH t AS (SELECT c_nationkey % 3 AS form, printf('nation%02d', c_nationkey) AS nation, c_custkey,
  c_mktsegment, 'a' || chr(9) || c_name AS title, (c_acctbal + 1000.0) / 11000.0 AS p FROM customer)
SELECT CASE form WHEN 2 THEN 'kept ' || c_mktsegment ELSE nation END AS contrast, CAST(c_custkey AS VARCHAR) AS id,
  CASE form WHEN 0 THEN title END AS name, CASE form WHEN 1 THEN title END AS description,
  CAST(printf('%.6f', p) AS DOUBLE) AS pvalue,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(printf('%.6f', p / 2) AS DOUBLE) END AS padj,
  CASE WHEN c_custkey % 5 <> 0 AND form <> 2 THEN CAST(printf('%.6f', p / 3) AS DOUBLE) END AS qvalue,
  CASE WHEN form > 0 THEN CAST(printf('%.6f', p * 4 - 2) AS DOUBLE) END AS nes FROM t""",
    "gsea_file": f"""{VECTOR_NULL_SQL}
SELECT contrast, collection, term_id AS id, CAST(printf('%.4f', nes) AS DOUBLE) AS nes, CAST(printf('%.2e', pvalue) AS DOUBLE) AS pvalue,
  CAST(printf('%.2e', padj) AS DOUBLE) AS padj, CAST(printf('%.4f', es) AS DOUBLE) AS es, lead_genes
FROM adj LEFT JOIN lead USING (contrast, collection, term_id) WHERE pvalue <= {P_CUTOFF}""",
    "set_file": f"""WITH {part_sets_sql()}
SELECT DISTINCT collection, term_id, 'set ' || term_id AS description, gene_id FROM part_sets""",
    "ranked_file": f"WITH {PART_VALUES_SQL} SELECT contrast, gene_id, value FROM part_values",
    "de_directory": f"""WITH {PART_VALUES_SQL}
SELECT contrast, gene_id, value, abs(value) >= 30 AS is_sig FROM part_values""",
    "de_simple": """SELECT c_mktsegment AS contrast, c_name || ', Inc' AS gene_id, c_acctbal AS value FROM customer""",
    "gene_list": "SELECT c_mktsegment AS contrast, c_name AS gene_id, 1.0::DOUBLE AS value FROM customer",
    "catalog_replace": """SELECT 'kegg' AS db, species, CAST(c_custkey AS VARCHAR) AS term_id, CAST(o_orderkey AS VARCHAR) AS gene_id
FROM customer JOIN orders ON o_custkey = c_custkey, (VALUES ('hsa'), ('mmu')) s(species)
WHERE species = 'mmu' OR c_mktsegment = 'BUILDING'""",
    "catalog_concurrent": """SELECT 'before' AS reader, 'v1' AS version, 0 AS lost, CAST(c_custkey AS VARCHAR) AS term_id, c_name AS name,
  CAST(o_orderkey AS VARCHAR) AS gene_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT 'after', 'v2', 2, CAST(c_custkey AS VARCHAR), c_name, CAST(o_orderkey AS VARCHAR)
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""",
    "ora_catalog": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)} SELECT {ROW_SQL} FROM adjusted""",
    "catalog_resume": """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'a' WHEN 'HOUSEHOLD' THEN 'b' ELSE 'c' END AS source,
  'SYMBOL' AS from_type, c_name AS from_id, CAST(c_custkey AS VARCHAR) AS entrez_id
FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'AUTOMOBILE')""",
    "ora_incremental": f"""WITH {PART_TABLE_SQL}, {part_sets_sql()}, {_DIRECTED}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)} SELECT {ROW_SQL} FROM adjusted""",
}
ORACLES["ora_incremental_parts"] = ORACLES["ora_incremental"]
