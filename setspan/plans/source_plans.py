"""Annotation and map files: the given tables written in each format and read back.

Customers stand in for genes, their orders for annotations, nations for species.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.operators.idmap import species_table_layer
from setspan.plans.tables import table
from setspan.session import scratch_dir
from setspan.sources import idmaps, sets

TAXON = "9606"


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _written(rows: DataFrame, *fields, sep: str = "\t") -> str:
    """A folder of text files with the fields as lines."""
    folder = scratch_dir(rows.sparkSession)
    rows.select(F.concat_ws(sep, *[f if isinstance(f, Column) else F.lit(f) for f in fields]).alias("value")).write.text(folder)
    return folder


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").withColumn("k", _text("c_custkey"))


def _both(forward: DataFrame, back: DataFrame) -> DataFrame:
    return forward.select(F.lit("forward").alias("kind"), "from_id", "to_id").unionByName(
        back.select(F.lit("back").alias("kind"), "from_id", "to_id")
    )


def reactome_gmt_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as pathways of their orders, name first; every third is of another species."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(_text("o_orderkey")), "\t").alias("genes"))
    rows = _customers(spark, sf).join(orders, F.col("c_custkey") == F.col("o_custkey"))
    place = F.when(F.col("c_custkey") % 3 == 0, "R-MMU-").otherwise("R-HSA-")
    folder = _written(rows, F.col("c_name"), F.concat(place, "k"), F.col("genes"))
    term, term_gene = sets.read_reactome_gmt(spark, folder, "hsa")
    return sets.with_display_names(term).select("collection", "term_id", "name").join(term_gene, ["collection", "term_id"])


def display_name_query(spark: SparkSession, sf: str) -> DataFrame:
    """Names shown for customers whose description or name says nothing."""
    key = F.col("c_custkey")
    term = _customers(spark, sf).select(
        F.col("k").alias("term_id"), F.when(key % 2 == 0, F.col("c_name")).otherwise(" ").alias("name"),
        F.when(key % 3 == 0, "NA").when(key % 3 == 1, "  ").otherwise(F.col("c_mktsegment")).alias("description"),
    )
    return sets.with_display_names(term).select("term_id", "name")


def link_pairs_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers linked with their orders, with two prefixes and two kinds of blank."""
    o = table(spark, sf, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    line = F.concat(
        F.when(odd, "path:c").otherwise("pathway:c"), _text("o_custkey"), F.when(odd, "\t").otherwise("  "),
        F.lit("cust:"), _text("o_orderkey"),
    )
    return sets.read_link_pairs(spark, _written(o, line))


def alias_list_query(spark: SparkSession, sf: str) -> DataFrame:
    """A species gene list: the name and two aliases of every customer."""
    aliases = F.concat(F.col("c_name"), F.lit(", alt"), "k", F.lit(",Old-"), "k", F.lit("; "), F.col("c_mktsegment"))
    folder = _written(_customers(spark, sf), F.concat(F.lit("hsa:"), "k"), "CDS", "1", aliases)
    return _both(*idmaps.read_gene_alias_list(spark, folder, "hsa"))


def xref_query(spark: SparkSession, sf: str) -> DataFrame:
    """Link tables of customers with other ids; every fifth line has none."""
    other = F.when(F.col("c_custkey") % 5 == 0, "up:").otherwise(F.concat(F.lit("up:P"), "k"))
    folder = _written(_customers(spark, sf), F.concat(F.lit("hsa:"), "k"), other)
    return idmaps.read_xref_pairs(spark, folder, "HSA")


def gaf_query(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as annotations of customers: some negated, some without a symbol, comments between."""
    o = table(spark, sf, "orders").join(_customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    db = F.when(key % 11 == 0, "!comment").otherwise("DB")
    symbol = F.when(key % 4 == 0, "").otherwise(F.col("c_name"))
    sign = F.when(key % 7 == 0, "NOT|part_of").otherwise("part_of")
    folder = _written(o, db, F.concat(F.lit("P"), "k"), symbol, sign, F.concat(F.lit("GO:"), F.substring("o_orderpriority", 1, 1)), "ref")
    return sets.read_gaf(spark, folder)


def obo_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as terms below their nation, in files with both kinds of line ends."""
    key = F.col("c_custkey")
    kind = F.when(key % 10 == 0, "[Typedef]").otherwise("[Term]")
    space = F.when(key % 2 == 0, "biological_process").otherwise("molecular_function")
    stanza = F.concat(
        kind, F.lit("\nid: GO:"), "k", F.lit("\nname: "), "c_name", F.lit("\nnamespace: "), space,
        F.lit('\ndef: "of '), "c_mktsegment", F.lit('" [x]\nis_a: N:'), _text("c_nationkey"), F.lit(" ! nation\nis_a: TOP\n"),
    )
    rows = _customers(spark, sf).select((key % 4 < 2).alias("windows"), stanza.alias("stanza"))
    header = spark.range(2).select((F.col("id") == 1).alias("windows"), F.lit("format-version: 1.2\n").alias("stanza"))
    text = F.when(F.col("windows"), F.concat(F.regexp_replace("stanza", "\n", "\r\n"), F.lit("\r"))).otherwise(F.col("stanza"))
    folder = scratch_dir(spark)
    lines = header.unionByName(rows).select("windows", text.alias("value"))
    lines.repartition("windows").sortWithinPartitions("windows", F.col("value").startswith("[")).write.partitionBy("windows").text(folder)
    return sets.read_obo(spark, folder).withColumn("parents", F.array_join("parents", ","))


def _gene_info(spark: SparkSession, sf: str) -> str:
    key = F.col("c_custkey")
    symbol = F.when(key % 9 == 0, "-").otherwise(F.col("c_name"))
    synonyms = F.when(key % 2 == 0, "-").otherwise(F.concat(F.lit("syn"), "k", F.lit("|Sym"), "k"))
    tax = F.when(key % 4 == 0, "10090").otherwise(TAXON)
    full = F.concat(F.lit("auth"), "k")
    return _written(_customers(spark, sf), tax, F.col("k"), symbol, "-", synonyms, "-", "1", "1p", "text", "protein", "-", full)


def gene_info_query(spark: SparkSession, sf: str) -> DataFrame:
    return _both(*idmaps.read_gene_info(spark, _gene_info(spark, sf), "hsa"))


def ensembl_query(spark: SparkSession, sf: str) -> DataFrame:
    """Three accessions of every customer, some missing; a quarter is of another species."""
    key = F.col("c_custkey")
    tax = F.when(key % 4 == 0, "10090").otherwise(TAXON)
    protein = F.when(key % 3 == 0, "-").otherwise(F.concat(F.lit("ensp"), "k"))
    folder = _written(_customers(spark, sf), tax, F.col("k"), F.concat(F.lit("ENSG"), "k"), F.concat(F.lit("ENST"), "k"), protein)
    return _both(*idmaps.read_gene2ensembl(spark, folder, "hsa"))


def refseq_query(spark: SparkSession, sf: str) -> DataFrame:
    """Accessions with versions, of which some are missing."""
    key = F.col("c_custkey")
    tax = F.when(key % 4 == 0, "10090").otherwise(TAXON)
    rna = F.when(key % 3 == 0, "-").otherwise(F.concat(F.lit("NM_"), "k", F.lit(".3")))
    folder = _written(
        _customers(spark, sf), tax, F.col("k"), "x", rna, "-", F.concat(F.lit("NP_"), "k", F.lit(".1")), "-",
        F.concat(F.lit("NC_"), _text("c_nationkey"), F.lit(".12")),
    )
    return _both(*idmaps.read_gene2refseq(spark, folder, "hsa"))


def uniprot_query(spark: SparkSession, sf: str) -> DataFrame:
    """Accessions with one or two gene ids; the taxon column is filled for half of the lines."""
    key = F.col("c_custkey")
    genes = F.when(key % 3 == 0, F.concat("k", F.lit("; "), _text(key + 1))).otherwise(F.col("k"))
    tax = F.when(key % 2 == 0, "").when(key % 5 == 0, "10090").otherwise(TAXON)
    folder = _written(_customers(spark, sf), F.concat(F.lit("P"), "k"), "NAME", genes, *["-"] * 9, tax)
    return _both(*idmaps.read_uniprot_idmapping(spark, folder, "hsa"))


def reactome_entrez_query(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as pathways of their customers' symbols, by a map file and gene names."""
    n = table(spark, sf, "nation")
    rows = _customers(spark, sf).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    species = F.when(F.col("c_custkey") % 5 == 0, "Mus musculus").otherwise("homo SAPIENS")
    gene = F.when(F.col("c_custkey") % 13 == 0, F.concat(F.lit("x"), "k")).otherwise(F.col("k"))
    folder = _written(rows, gene, "-", "-", F.concat(F.lit("R-HSA-"), _text("n_nationkey")), "-", F.col("n_name"), "IEA", species)
    term, term_gene = sets.reactome_from_entrez(spark, folder, _gene_info(spark, sf), "hsa")
    return term.join(term_gene, ["collection", "term_id"]).select("collection", "term_id", "name", "gene_id")


def species_table_query(spark: SparkSession, sf: str) -> DataFrame:
    """All conversions that one species table gives."""
    pairs = _customers(spark, sf).select(F.col("k").alias("entrez_id"), F.col("c_name").alias("symbol"))
    out = None
    for a, b in (("SYMBOL", "ENTREZID"), ("ENTREZID", "SYMBOL"), ("SYMBOL", "KEGG"), ("KEGG", "ENTREZID")):
        layer = species_table_layer(pairs, "hsa", a, b).select(F.lit(f"{a}>{b}").alias("kind"), "from_id", "to_id")
        out = layer if out is None else out.unionByName(layer)
    return out


QUERIES = {
    "reactome_gmt": reactome_gmt_query,
    "display_names": display_name_query,
    "link_pairs": link_pairs_query,
    "gene_alias_list": alias_list_query,
    "xref_pairs": xref_query,
    "gaf_annotations": gaf_query,
    "obo_terms": obo_query,
    "gene_info": gene_info_query,
    "gene2ensembl": ensembl_query,
    "gene2refseq": refseq_query,
    "uniprot_idmap": uniprot_query,
    "reactome_from_entrez": reactome_entrez_query,
    "species_table": species_table_query,
}

_C = "c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM customer)"


def _both_sql(pairs: str) -> str:
    """Both directions of distinct (entrez, id) pairs."""
    return f"""WITH {_C}, p AS ({pairs})
SELECT DISTINCT 'forward' AS kind, i AS from_id, k AS to_id FROM p UNION ALL SELECT DISTINCT 'back', k, i FROM p"""


ORACLES = {
    "reactome_gmt": f"""WITH {_C} SELECT 'reactome' AS collection, 'R-HSA-' || k AS term_id, c_name AS name,
  CAST(o_orderkey AS VARCHAR) AS gene_id FROM c JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0""",
    "display_names": f"""WITH {_C} SELECT k AS term_id, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment
  WHEN c_custkey % 2 = 0 THEN c_name ELSE k END AS name FROM c""",
    "link_pairs": """SELECT DISTINCT 'kegg' AS collection, 'c' || o_custkey AS term_id, CAST(o_orderkey AS VARCHAR) AS gene_id FROM orders""",
    "gene_alias_list": f"""WITH {_C} SELECT 'forward' AS kind, k AS from_id, c_name AS to_id FROM c
UNION ALL SELECT 'back', upper(a), k FROM (SELECT k, unnest([c_name, 'alt' || k, 'old-' || k]) AS a FROM c)""",
    "xref_pairs": f"WITH {_C} SELECT k AS entrez_id, 'P' || k AS external_id FROM c WHERE c_custkey % 5 <> 0",
    "gaf_annotations": f"""WITH {_C} SELECT DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN 'P' || k ELSE c_name END AS gene_id,
  'GO:' || o_orderpriority[1] AS term_id FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0""",
    "obo_terms": f"""WITH {_C} SELECT 'GO:' || k AS term_id, c_name AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'biological_process' ELSE 'molecular_function' END AS namespace,
  '"of ' || c_mktsegment || '" [x]' AS definition, 'N:' || c_nationkey || ',TOP' AS parents FROM c WHERE c_custkey % 10 <> 0""",
    "gene_info": f"""WITH {_C}, g AS (SELECT * FROM c WHERE c_custkey % 4 <> 0)
SELECT 'forward' AS kind, k AS from_id, c_name AS to_id FROM g WHERE c_custkey % 9 <> 0
UNION ALL SELECT 'back', upper(a), k FROM (SELECT k, unnest([CASE WHEN c_custkey % 9 <> 0 THEN c_name END, 'auth' || k,
  CASE WHEN c_custkey % 2 = 1 THEN 'syn' || k END, CASE WHEN c_custkey % 2 = 1 THEN 'sym' || k END]) AS a FROM g) WHERE a IS NOT NULL""",
    "gene2ensembl": _both_sql("""SELECT k, unnest(['ENSG' || k, 'ENST' || k, CASE WHEN c_custkey % 3 <> 0 THEN 'ENSP' || k END]) AS i
  FROM c WHERE c_custkey % 4 <> 0""").replace("FROM p", "FROM p WHERE i IS NOT NULL"),
    "gene2refseq": _both_sql("""SELECT k, unnest(['NP_' || k, 'NC_' || c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN 'NM_' || k END]) AS i
  FROM c WHERE c_custkey % 4 <> 0""").replace("FROM p", "FROM p WHERE i IS NOT NULL"),
    "uniprot_idmap": _both_sql("""SELECT 'P' || k AS i, unnest(CASE WHEN c_custkey % 3 = 0 THEN [k, CAST(c_custkey + 1 AS VARCHAR)] ELSE [k] END) AS k
  FROM c WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0"""),
    "reactome_from_entrez": f"""WITH {_C} SELECT DISTINCT 'reactome' AS collection, 'R-HSA-' || n_nationkey AS term_id, n_name AS name,
  c_name AS gene_id FROM c JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey % 5 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 9 <> 0""",
    "species_table": f"""WITH {_C} SELECT 'SYMBOL>ENTREZID' AS kind, c_name AS from_id, k AS to_id FROM c
UNION ALL SELECT 'ENTREZID>SYMBOL', k, c_name FROM c UNION ALL SELECT 'SYMBOL>KEGG', c_name, 'hsa:' || k FROM c
UNION ALL SELECT 'KEGG>ENTREZID', 'hsa:' || k, k FROM c""",
}
