"""Result comparison queries: test results of one ship year against those of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setspan.operators import concordance as cc
from setspan.operators.de import table_universe
from setspan.operators.ora import ora, with_ratios
from setspan.operators.scan import with_rank
from setspan.operators.score import enrichment_scores, rank_genes
from setspan.plans.gsea_plans import SCORES_SQL
from setspan.plans.ora_plans import _ALL, _TABLE_U, BOUNDS, _all_hits, ora_sql
from setspan.plans.tables import PART_TABLE_SQL, part_sets, part_sets_sql, part_table
from setspan.session import cut_lineage

KEYS = ("analysis", "db", "contrast")
# Limits for the comparison of random data, where no set is significant.
LIMITS = cc.limits(
    [
        ("ora", "brand", "shared_rows", "L1", 20.0, None),
        ("ora", "size", "shared_rows", "L1", 51.0, None),
        ("ora", "brand", "sig_jaccard", "L1", 0.9, None),
        ("ora", "brand", "top20_overlap", "L2", 0.8, None),
        ("ora", "size", "top20_overlap", "L2", 0.4, None),
    ],
    [("ora", "brand"), ("ora", "type")],
)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded test results of all years, written once because comparisons read them often."""
    de = part_table(spark, sf)
    tested = ora(
        _all_hits(de), part_sets(spark, sf), table_universe(de), q_cutoff=1.0, **BOUNDS
    )
    rounded = with_ratios(tested).select(
        F.lit("ora").alias("analysis"), F.col("collection").alias("db"), "contrast",
        F.concat(F.lit("path:"), "term_id").alias("id"),
        *[F.round(c, 6).alias(c) for c in ("pvalue", "padj", "qvalue")], "gene_ratio", "bg_ratio",
    )
    return cut_lineage(rounded)


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Side a: a year's results. Side b: the next year's, under the earlier year's label."""
    r = results(spark, sf)
    year = F.col("contrast").cast("int")
    last = r.agg(F.max(year)).scalar()
    first = r.agg(F.min(year)).scalar()
    a = r.where(year < last)
    b = r.where(year > first).withColumn("contrast", (year - 1).cast("string"))
    return a, b


def rank_query(spark: SparkSession, sf: str) -> DataFrame:
    r = cc.normalized(results(spark, sf))
    ranked = with_rank(r, KEYS, cc.result_order(False))
    return ranked.select(*KEYS, "id", F.col("rank").cast("bigint").alias("rank"))


def concordance_query(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(spark, sf)
    out = cc.concordance(a, b, KEYS)
    return out.withColumns(
        {c: F.round(c, 6) for c in ("top10_overlap", "top20_overlap", "sig_jaccard", "padj_rel_err_median")}
    )


def topk_query(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(spark, sf)
    return cc.topk_overlap(a, b, 10, KEYS).withColumn("top10_overlap", F.round("top10_overlap", 6))


def gate_query(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(spark, sf)
    gated = cc.gate(cc.concordance(a, b, KEYS), LIMITS, ["contrast"])
    return gated.withColumn("value", F.round("value", 6))


def batch_query(spark: SparkSession, sf: str) -> DataFrame:
    """Both gates per year: the formal one is stricter and fails on second-level limits."""
    a, b = sides(spark, sf)
    metrics = cut_lineage(cc.concordance(a, b, KEYS))
    loose = [row for row in LIMITS if row[1] == "size" and row[3] == "L1"]
    smoke = cc.gate(metrics, [(*row[:4], 50.0, None, False) for row in loose], ["contrast"])
    formal = cc.gate(metrics, LIMITS[4:5], ["contrast"], enforce_l2=True)
    return cc.batch_summary(smoke, formal)


def difference_query(spark: SparkSession, sf: str) -> DataFrame:
    """Shared, only-a and only-b ids among rows with p up to 0.5."""
    a, b = sides(spark, sf)
    pairs = cc.full_pairs(a.where("pvalue <= 0.5"), b.where("pvalue <= 0.5"), KEYS)
    kind = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "a_only").otherwise("b_only")
    return pairs.select(*KEYS, "id", kind.alias("kind"))


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both sides with p up to 0.5, side a unfiltered, and set sizes with overlaps."""
    a, b = sides(spark, sf)
    ranked = cut_lineage(rank_genes(part_table(spark, sf).select("contrast", "gene_id", "value")))
    scores = enrichment_scores(ranked, part_sets(spark, sf), 1, 1000)
    counts = scores.select(
        F.lit("ora").alias("analysis"), F.col("collection").alias("db"), "contrast",
        F.col("term_id").alias("id"), F.col("set_size"), F.col("set_size").alias("overlap_size"),
        F.round("es", 6).alias("es"),
    )
    return a.where("pvalue <= 0.5"), b.where("pvalue <= 0.5"), a, counts


def diagnose_query(spark: SparkSession, sf: str) -> DataFrame:
    a, b, loose, counts = _scored(spark, sf)
    details = cc.diagnose_gsea(a, b, counts, loose, KEYS, min_size=30, max_size=90)
    return details.select(
        *KEYS, "id", "category", "reason", "overlap_size", "a_pvalue", "b_pvalue", "a_padj", "b_padj",
        "a_unfiltered_padj", F.round("padj_rel_diff", 6).alias("padj_rel_diff"),
    )


def reasons_query(spark: SparkSession, sf: str) -> DataFrame:
    """Reason counts among sets in the top 20 of one side only."""
    a, b, loose, counts = _scored(spark, sf)
    details = cc.diagnose_gsea(a, b, counts, loose, KEYS, min_size=30, max_size=90)
    tops = [cc.top_ranked(df, KEYS, 20, False).select(*KEYS, "id") for df in (a, b)]
    one_sided = tops[0].join(tops[1], [*KEYS, "id"], "left_anti").unionByName(
        tops[1].join(tops[0], [*KEYS, "id"], "left_anti")
    )
    return cc.reason_counts(details, KEYS, one_sided)


def ratio_query(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(spark, sf)
    pairs = cc.ora_ratio_pairs(a, b, KEYS)
    return cc.ora_bias(pairs, KEYS)


def errors_query(spark: SparkSession, sf: str) -> DataFrame:
    a, b = sides(spark, sf)
    top = cc.largest_errors(cc.ora_ratio_pairs(a, b, KEYS), 10, KEYS)
    return top.select(
        *KEYS, "id", "a_overlap", "b_overlap", F.round("padj_rel_err", 6).alias("padj_rel_err"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def standard_query(spark: SparkSession, sf: str) -> DataFrame:
    """Results without names: description from nation names where they exist, else the id."""
    r = results(spark, sf).withColumn(
        "description", F.when(F.col("pvalue") < 0.5, F.concat(F.lit("about "), "id")).otherwise("")
    )
    return cc.standardize_results(r, ["nes_text"]).select(*KEYS, "id", "name", "description", "nes_text")


# -- SQL of the same ---------------------------------------------------------------------------

RESULTS_SQL = f"""{PART_TABLE_SQL}, {part_sets_sql()}, {_ALL}, {_TABLE_U},
{ora_sql('hits', 'part_sets', 'u', 'contrast', 4, 1000)},
r AS (SELECT 'ora' AS analysis, collection AS db, contrast, term_id AS id, round(pvalue, 6) AS pvalue,
  round(padj, 6) AS padj, round(padj, 6) AS qvalue, overlap, n_hits, set_size, n_universe FROM adjusted),
a AS (SELECT * FROM r WHERE CAST(contrast AS INT) < (SELECT max(CAST(contrast AS INT)) FROM r)),
b AS (SELECT * REPLACE (CAST(CAST(contrast AS INT) - 1 AS VARCHAR) AS contrast) FROM r
      WHERE CAST(contrast AS INT) > (SELECT min(CAST(contrast AS INT)) FROM r))"""

TOP_SQL = """
top_a AS (SELECT *, row_number() OVER (PARTITION BY analysis, db, contrast ORDER BY padj, pvalue, qvalue, id) AS rank FROM a),
top_b AS (SELECT *, row_number() OVER (PARTITION BY analysis, db, contrast ORDER BY padj, pvalue, qvalue, id) AS rank FROM b)"""


def _top(k: int) -> str:
    return f"""top{k} AS (SELECT analysis, db, contrast,
  count(*) FILTER (x.id IS NOT NULL AND y.id IS NOT NULL) /
  greatest(1, least({k}, greatest(count(x.id), count(y.id)))) AS top{k}_overlap
  FROM (SELECT * FROM top_a WHERE rank <= {k}) x FULL JOIN (SELECT * FROM top_b WHERE rank <= {k}) y
  USING (analysis, db, contrast, id) GROUP BY 1, 2, 3)"""


METRICS_SQL = f"""{RESULTS_SQL}, {TOP_SQL}, {_top(10)}, {_top(20)},
pairs AS (SELECT analysis, db, contrast, id, x.id IS NOT NULL AS in_a, y.id IS NOT NULL AS in_b,
    x.padj AS a_padj, y.padj AS b_padj, x.pvalue AS a_pvalue, y.pvalue AS b_pvalue,
    coalesce(x.qvalue <= 0.05, false) AS sa, coalesce(y.qvalue <= 0.05, false) AS sb
  FROM a x FULL JOIN b y USING (analysis, db, contrast, id)),
metrics AS (SELECT analysis, db, contrast, count(*) FILTER (in_a) AS a_rows, count(*) FILTER (in_b) AS b_rows,
    count(*) FILTER (in_a AND in_b) AS shared_rows,
    CASE WHEN count(*) FILTER (sa OR sb) = 0 THEN 1.0 ELSE count(*) FILTER (sa AND sb) / count(*) FILTER (sa OR sb) END AS sig_jaccard,
    median(abs(a_padj - b_padj) / greatest(abs(b_padj), 1e-12)) AS padj_rel_err_median
  FROM pairs GROUP BY 1, 2, 3),
full_metrics AS (SELECT analysis, db, contrast, a_rows, b_rows, shared_rows, round(top10_overlap, 6) AS top10_overlap,
    round(top20_overlap, 6) AS top20_overlap, round(sig_jaccard, 6) AS sig_jaccard,
    round(padj_rel_err_median, 6) AS padj_rel_err_median, CAST(NULL AS DOUBLE) AS nes_abs_err_median
  FROM metrics JOIN top10 USING (analysis, db, contrast) JOIN top20 USING (analysis, db, contrast))"""


def limits_sql(rows) -> str:
    def lit(v):
        return "NULL" if v is None else (str(v).lower() if isinstance(v, bool) else repr(v))

    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"""(SELECT analysis, db, metric, level, CAST(smallest AS DOUBLE) AS smallest, CAST(largest AS DOUBLE) AS largest, required
  FROM (VALUES {values}) t(analysis, db, metric, level, smallest, largest, required))"""


def gate_sql(rows, enforce: bool = False) -> str:
    return f"""SELECT contrast, analysis, db, metric, level, smallest, largest, value,
  CASE WHEN value IS NOT NULL AND coalesce(value >= smallest, true) AND coalesce(value <= largest, true) THEN 'pass'
       WHEN {str(not enforce).lower()} AND level = 'L2' THEN 'warn' ELSE 'fail' END AS status
FROM (SELECT * FROM (SELECT DISTINCT contrast FROM full_metrics), {limits_sql(rows)}) l
LEFT JOIN (UNPIVOT (SELECT analysis, db, contrast, CAST(shared_rows AS DOUBLE) AS shared_rows,
    CAST(a_rows AS DOUBLE) AS a_rows, CAST(b_rows AS DOUBLE) AS b_rows, sig_jaccard, top20_overlap FROM full_metrics)
  ON shared_rows, a_rows, b_rows, sig_jaccard, top20_overlap INTO NAME metric VALUE value) v
USING (contrast, analysis, db, metric) WHERE value IS NOT NULL OR required"""


DETAILS_SQL = f"""{METRICS_SQL},
{SCORES_SQL.replace('BETWEEN 4 AND', 'BETWEEN 1 AND')},
c AS (SELECT contrast, collection AS db, term_id AS id, set_size AS overlap_size FROM scored),
details AS (
  SELECT analysis, db, contrast, id, CASE WHEN in_a AND in_b THEN 'shared' WHEN in_a THEN 'a_only' ELSE 'b_only' END AS category,
    CASE WHEN coalesce(overlap_size, 0) < 30 THEN 'filtered_by_minGSSize'
      WHEN overlap_size > 90 THEN 'filtered_by_maxGSSize' WHEN in_a AND in_b THEN 'shared'
      WHEN in_b AND NOT in_a AND l.padj > 0.05 THEN 'filtered_by_go_padj_cutoff'
      WHEN in_b AND NOT in_a AND l.padj IS NOT NULL THEN 'go_unfiltered_present_but_filtered_or_sorted_out'
      WHEN in_b AND NOT in_a THEN 'missing_in_go_unfiltered' ELSE 'r_not_significant_or_ranking_diff' END AS reason,
    coalesce(overlap_size, 0) AS overlap_size, a_pvalue, b_pvalue, a_padj, b_padj, l.padj AS a_unfiltered_padj,
    round(abs(a_padj - b_padj) / greatest(abs(b_padj), 1e-12), 6) AS padj_rel_diff
  FROM (SELECT analysis, db, contrast, id, x.id IS NOT NULL AS in_a, y.id IS NOT NULL AS in_b,
      x.padj AS a_padj, y.padj AS b_padj, x.pvalue AS a_pvalue, y.pvalue AS b_pvalue
    FROM (SELECT * FROM a WHERE pvalue <= 0.5) x FULL JOIN (SELECT * FROM b WHERE pvalue <= 0.5) y
    USING (analysis, db, contrast, id))
  LEFT JOIN c USING (contrast, db, id) LEFT JOIN a l USING (analysis, db, contrast, id))"""

QUERIES = {
    "result_ranks": rank_query,
    "concordance": concordance_query,
    "topk_overlap": topk_query,
    "gate": gate_query,
    "batch_summary": batch_query,
    "id_differences": difference_query,
    "diagnose_gsea": diagnose_query,
    "diagnose_reasons": reasons_query,
    "diagnose_ora_bias": ratio_query,
    "diagnose_ora_errors": errors_query,
    "standardize_results": standard_query,
}

ORACLES = {
    "result_ranks": f"""WITH {RESULTS_SQL} SELECT analysis, db, contrast, id,
  row_number() OVER (PARTITION BY analysis, db, contrast ORDER BY padj, pvalue, qvalue, id) AS rank FROM r""",
    "concordance": f"WITH {METRICS_SQL} SELECT * FROM full_metrics",
    "topk_overlap": f"WITH {METRICS_SQL} SELECT analysis, db, contrast, top10_overlap FROM full_metrics",
    "gate": f"WITH {METRICS_SQL} {gate_sql(LIMITS)}",
    "batch_summary": f"""WITH {METRICS_SQL},
s AS (SELECT contrast, count(*) FILTER (status = 'fail') AS f FROM
  ({gate_sql([('ora', 'size', 'shared_rows', 'L1', 50.0, None, False)])}) GROUP BY 1),
o AS (SELECT contrast, count(*) FILTER (status = 'fail') AS f FROM ({gate_sql(LIMITS[4:5], True)}) GROUP BY 1)
SELECT s.contrast, s.f = 0 AS smoke_ok, s.f AS smoke_failures, s.f = 0 AND coalesce(o.f = 0, false) AS formal_ok,
  CASE WHEN s.f > 0 THEN 'skipped: smoke gate failed' WHEN o.f IS NULL THEN 'missing formal result'
    WHEN o.f > 0 THEN o.f || ' limits failed' ELSE '' END AS formal_error
FROM s LEFT JOIN o USING (contrast)""",
    "id_differences": f"""WITH {RESULTS_SQL} SELECT analysis, db, contrast, id,
  CASE WHEN x.pvalue IS NOT NULL AND y.pvalue IS NOT NULL THEN 'shared' WHEN x.pvalue IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS kind
FROM (SELECT * FROM a WHERE pvalue <= 0.5) x FULL JOIN (SELECT * FROM b WHERE pvalue <= 0.5) y USING (analysis, db, contrast, id)""",
    "diagnose_gsea": f"WITH {DETAILS_SQL} SELECT * FROM details",
    "diagnose_reasons": f"""WITH {DETAILS_SQL},
ta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis, db, contrast ORDER BY padj, pvalue, qvalue, id) AS k
  FROM a WHERE pvalue <= 0.5) WHERE k <= 20),
tb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis, db, contrast ORDER BY padj, pvalue, qvalue, id) AS k
  FROM b WHERE pvalue <= 0.5) WHERE k <= 20),
one AS (SELECT analysis, db, contrast, id FROM ta FULL JOIN tb USING (analysis, db, contrast, id) WHERE ta.k IS NULL OR tb.k IS NULL)
SELECT analysis, db, contrast, category, reason, count(*) AS sets FROM details JOIN one USING (analysis, db, contrast, id) GROUP BY 1, 2, 3, 4, 5""",
    "diagnose_ora_bias": f"""WITH {RESULTS_SQL},
p AS (SELECT analysis, db, contrast, x.n_hits AS ah, y.n_hits AS bh, x.n_universe AS au, y.n_universe AS bu
  FROM a x JOIN b y USING (analysis, db, contrast, id))
SELECT analysis, db, contrast, 'n_hits' AS count_name, list_sort(list_distinct(list(ah))) <> list_sort(list_distinct(list(bh))) AS mismatch
FROM p GROUP BY 1, 2, 3
UNION ALL SELECT analysis, db, contrast, 'n_universe', list_sort(list_distinct(list(au))) <> list_sort(list_distinct(list(bu)))
FROM p GROUP BY 1, 2, 3""",
    "diagnose_ora_errors": f"""WITH {RESULTS_SQL},
p AS (SELECT analysis, db, contrast, id, x.overlap AS a_overlap, y.overlap AS b_overlap,
  abs(x.padj - y.padj) / greatest(abs(y.padj), 1e-12) AS e FROM a x JOIN b y USING (analysis, db, contrast, id))
SELECT analysis, db, contrast, id, a_overlap, b_overlap, round(e, 6) AS padj_rel_err, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY analysis, db, contrast ORDER BY e DESC, id DESC) AS rank FROM p) WHERE rank <= 10""",
    "standardize_results": f"""WITH {RESULTS_SQL} SELECT analysis, db, contrast, 'path:' || id AS id,
  CASE WHEN pvalue < 0.5 THEN 'about path:' || id ELSE 'path:' || id END AS name,
  CASE WHEN pvalue < 0.5 THEN 'about path:' || id ELSE 'path:' || id END AS description,
  CAST(NULL AS VARCHAR) AS nes_text FROM r""",
}
