"""Comparing result tables: shared rows, agreement metrics, gates and reasons for differences.

Results carry (*keys, id, name, pvalue, padj, qvalue) and for ranked analyses nes; missing
numbers are null. ``keys`` (for example analysis, db, contrast) group independent pairs, so a
whole batch is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setspan.functions.ids import normalize_set_id, ratio_part
from setspan.operators.scan import GROUP_ROWS, largest_group, with_rank

KEYS = ("analysis", "db")
SIGNIFICANT = 0.05
REL_FLOOR = 1e-12


def standardize_results(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill name and description from each other and the id; missing columns become null."""
    for c in (*columns, "id", "name", "description", "pvalue", "padj", "qvalue"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double" if c in ("pvalue", "padj", "qvalue") else "string"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("description", F.lit("")), F.col("id"))
    filled = df.withColumn("name", name)
    return filled.withColumn("description", F.coalesce(F.nullif("description", F.lit("")), F.col("name")))


def result_order(ranked: bool) -> list[Column]:
    """padj, p, then q (or effect size), then id; nulls last."""
    nulls_last = [F.col("padj").asc_nulls_last(), F.col("pvalue").asc_nulls_last()]
    if ranked:
        return [*nulls_last, F.coalesce(F.abs("nes"), F.lit(0.0)).desc(), F.col("id").asc()]
    return [*nulls_last, F.col("qvalue").asc_nulls_last(), F.col("id").asc()]


def normalized(df: DataFrame) -> DataFrame:
    out = df.withColumn("id", normalize_set_id("id"))
    return out if "nes" in df.columns else out.withColumn("nes", F.lit(None).cast("double"))


def unique_results(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per id; of repeats the worst-ranked one counts."""
    order = F.struct(*[F.coalesce(F.col(c), F.lit(float("inf"))).alias(c) for c in ("padj", "pvalue", "qvalue")])
    row = F.struct("pvalue", "padj", "qvalue", "nes")
    return df.groupBy(*keys, "id").agg(F.max_by(row, order).alias("r")).select(*keys, "id", "r.*")


def full_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both sides by id, prefixed a_ and b_, with presence flags."""
    keys = list(keys)

    def side(df: DataFrame, p: str) -> DataFrame:
        one = unique_results(normalized(df), keys)
        return one.select(
            *keys, "id", *[F.col(c).alias(f"{p}_{c}") for c in ("pvalue", "padj", "qvalue", "nes")],
            F.lit(True).alias(f"in_{p}"),
        )

    both = side(a, "a").join(side(b, "b"), [*keys, "id"], "full_outer")
    return both.withColumn("in_a", F.coalesce("in_a", F.lit(False))).withColumn(
        "in_b", F.coalesce("in_b", F.lit(False))
    )


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(REL_FLOOR))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, split: bool) -> DataFrame:
    """Exact median per group from its one or two middle ranks; no group is collected."""
    keys = list(keys)
    numbers = df.where(F.col(value).isNotNull()).select(*keys, "id", value)
    ranked = with_rank(numbers, keys, [F.col(value).asc(), F.col("id").asc()], "_r", split)
    size = numbers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    middle = F.col("_r").isin(F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2))
    return ranked.join(size, keys).where(middle).groupBy(*keys).agg(F.avg(value).alias(out))


def top_ranked(df: DataFrame, keys: Sequence[str], k: int, ranked: bool) -> DataFrame:
    """First k ids per group; the limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*result_order(ranked))
    return normalized(df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_overlap(
    a: DataFrame, b: DataFrame, k: int, keys: Sequence[str] = KEYS, ranked: bool = False
) -> DataFrame:
    """Shared share of both top-k lists, over min(k, the longer list); both empty gives 1."""
    keys = list(keys)
    tops = [
        top_ranked(df, keys, k, ranked).select(*keys, "id", F.lit(i).alias("_side"))
        for i, df in enumerate((a, b))
    ]
    ids = tops[0].unionByName(tops[1]).groupBy(*keys, "id").agg(
        F.count_if(F.col("_side") == 0).alias("_a"), F.count_if(F.col("_side") == 1).alias("_b")
    )
    counted = ids.groupBy(*keys).agg(
        F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"),
        F.count_if((F.col("_a") > 0) & (F.col("_b") > 0)).alias("_both"),
    )
    longest = F.greatest(F.lit(1), F.least(F.lit(k), F.greatest("_na", "_nb")))
    return counted.select(*keys, (F.col("_both") / longest).alias(f"top{k}_overlap"))


def concordance(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, ranked: bool = False
) -> DataFrame:
    """One row of agreement metrics per group present on either side."""
    keys = list(keys)
    pairs = full_pairs(a, b, keys)
    shared = F.col("in_a") & F.col("in_b")
    sig = [F.coalesce(F.col(f"{p}_qvalue"), F.col(f"{p}_padj")) <= SIGNIFICANT for p in "ab"]
    sig = [F.coalesce(s, F.lit(False)) for s in sig]
    errors = pairs.where(shared).select(
        *keys, "id",
        relative_error(F.col("a_padj"), F.col("b_padj")).alias("_padj_err"),
        F.abs(F.col("a_nes") - F.col("b_nes")).alias("_nes_err"),
    )
    split = largest_group(errors.select(*keys), keys) > GROUP_ROWS
    counts = pairs.groupBy(*keys).agg(
        F.count_if(shared).alias("shared_rows"),
        F.count_if(sig[0] | sig[1]).alias("_union"),
        F.count_if(sig[0] & sig[1]).alias("_both"),
    )
    out = counts.withColumn(
        "sig_jaccard", F.when(F.col("_union") > 0, F.col("_both") / F.col("_union")).otherwise(1.0)
    ).drop("_union", "_both")
    sides = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}_rows")) for p, df in (("a", a), ("b", b))]
    for part in sides:
        out = out.join(part, keys, "left")
    for k in (10, 20):
        out = out.join(topk_overlap(a, b, k, keys, ranked), keys, "left")
    out = out.join(exact_median(errors, keys, "_padj_err", "padj_rel_err_median", split), keys, "left")
    if ranked:
        out = out.join(exact_median(errors, keys, "_nes_err", "nes_abs_err_median", split), keys, "left")
    else:
        out = out.withColumn("nes_abs_err_median", F.lit(None).cast("double"))
    filled = {f"{p}_rows": F.coalesce(F.col(f"{p}_rows"), F.lit(0)) for p in "ab"}
    return out.withColumns(filled).select(
        *keys, "a_rows", "b_rows", "shared_rows", "top10_overlap", "top20_overlap", "sig_jaccard",
        "padj_rel_err_median", "nes_abs_err_median",
    )


# Gate limits (analysis, db, metric, level, smallest, largest).
THRESHOLDS = [
    ("gsea", "kegg", "shared_rows", "L1", 1.0, None),
    ("gsea", "kegg", "sig_jaccard", "L1", 0.0, None),
    ("gsea", "kegg", "nes_abs_err_median", "L1", None, 0.02),
    ("gsea", "go", "shared_rows", "L1", 1.0, None),
    ("gsea", "go", "sig_jaccard", "L1", 0.0, None),
    ("gsea", "go", "nes_abs_err_median", "L1", None, 0.02),
    ("gsea", "reactome", "shared_rows", "L1", 1.0, None),
    ("gsea", "reactome", "sig_jaccard", "L1", 0.0, None),
    ("gsea", "reactome", "nes_abs_err_median", "L1", None, 0.05),
    ("gsea", "msigdb", "shared_rows", "L1", 1.0, None),
    ("gsea", "msigdb", "sig_jaccard", "L1", 0.75, None),
    ("gsea", "msigdb", "nes_abs_err_median", "L1", None, 0.05),
    ("gsea", "kegg", "top20_overlap", "L2", 0.80, None),
    ("gsea", "go", "top20_overlap", "L2", 0.60, None),
    ("gsea", "reactome", "top20_overlap", "L2", 0.40, None),
    ("gsea", "msigdb", "top20_overlap", "L2", 0.10, None),
]
# Pairs that must be present and non-empty.
REQUIRED = [("ora", "kegg"), ("gsea", "kegg"), ("gsea", "go")]
METRICS = ("shared_rows", "sig_jaccard", "nes_abs_err_median", "top20_overlap", "a_rows", "b_rows")


def limits(thresholds=None, required=None) -> list[tuple]:
    """Gate limits (analysis, db, metric, level, smallest, largest, required).

    Each required pair adds non-empty limits on its row counts.
    """
    rows = [(*t, False) for t in (THRESHOLDS if thresholds is None else thresholds)]
    for analysis, db in REQUIRED if required is None else required:
        rows += [(analysis, db, m, "L1", 1.0, None, True) for m in ("a_rows", "b_rows", "shared_rows")]
    return rows


LIMIT_TYPES = (
    ("analysis", "string"), ("db", "string"), ("metric", "string"), ("level", "string"),
    ("smallest", "double"), ("largest", "double"), ("required", "boolean"),
)


def gate(
    metrics: DataFrame, limit_rows: list[tuple], keys: Sequence[str] = (), enforce_l2: bool = False
) -> DataFrame:
    """One row per applicable limit: pass, warn (second level) or fail.

    Limits of a pair without metrics apply only when the pair is required. ``keys`` are extra
    group columns of ``metrics``, such as the contrast of a batch; every group is held against
    the same short literal list of limits.
    """
    keys = list(keys)
    flat = metrics.select(
        *keys, "analysis", "db",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("s"),
    ).select(*keys, "analysis", "db", "s.*").withColumn("_present", F.lit(True))
    literal = F.array(
        *[
            F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, LIMIT_TYPES)])
            for row in limit_rows
        ]
    )
    groups = metrics.select(*keys).distinct() if keys else metrics.sparkSession.range(1).select()
    wanted = groups.select(*keys, F.explode(literal).alias("l")).select(*keys, "l.*")
    joined = wanted.join(flat, [*keys, "analysis", "db", "metric"], "left")
    value = F.col("value")
    ok = (
        value.isNotNull()
        & F.coalesce(value >= F.col("smallest"), F.lit(True))
        & F.coalesce(value <= F.col("largest"), F.lit(True))
    )
    soft = F.lit(not enforce_l2) & (F.col("level") == "L2")
    return joined.where(F.col("_present").isNotNull() | F.col("required")).select(
        *keys, "analysis", "db", "metric", "level", "smallest", "largest", "value",
        F.when(ok, "pass").when(soft, "warn").otherwise("fail").alias("status"),
    )


def gate_verdict(gated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return gated.groupBy(*keys).agg(
        (F.count_if(F.col("status") == "fail") == 0).alias("ok"),
        F.count_if(F.col("status") == "fail").alias("failures"),
        F.count_if(F.col("status") == "warn").alias("warnings"),
    )


def batch_summary(smoke: DataFrame, formal: DataFrame, key: str = "contrast") -> DataFrame:
    """Both gates per dataset; the formal one counts only where the smoke gate held.

    smoke, formal: gate rows with the dataset key.
    """
    first = gate_verdict(smoke, [key]).select(key, F.col("ok").alias("smoke_ok"), F.col("failures").alias("smoke_failures"))
    second = gate_verdict(formal, [key]).select(key, F.col("ok").alias("_formal"), F.col("failures").alias("_f"))
    return first.join(second, key, "left").select(
        key, "smoke_ok", "smoke_failures",
        (F.col("smoke_ok") & F.coalesce("_formal", F.lit(False))).alias("formal_ok"),
        F.when(~F.col("smoke_ok"), "skipped: smoke gate failed")
        .when(F.col("_formal").isNull(), "missing formal result")
        .when(~F.col("_formal"), F.concat(F.col("_f").cast("string"), F.lit(" limits failed")))
        .otherwise("").alias("formal_error"),
    )


# The reasons users filter on; {a} and {b} stand for the names of the two sides.
REASONS = {
    "small": "filtered_by_minGSSize",
    "large": "filtered_by_maxGSSize",
    "shared": "shared",
    "cutoff": "filtered_by_{a}_padj_cutoff",
    "sorted_out": "{a}_unfiltered_present_but_filtered_or_sorted_out",
    "missing": "missing_in_{a}_unfiltered",
    "only_a": "{b}_not_significant_or_ranking_diff",
}


def diagnose_gsea(
    a: DataFrame,
    b: DataFrame,
    set_counts: DataFrame,
    unfiltered: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    min_size: int = 10,
    max_size: int = 500,
    sides: tuple[str, str] = ("go", "r"),
) -> DataFrame:
    """Why each set of either result is in one, both or neither.

    ``sides`` names a and b in the reasons. set_counts: (*keys, id, set_size, overlap_size). ``unfiltered`` is side a before its cutoff.
    """
    keys = list(keys)
    rows = [*keys, "id"]
    pairs = full_pairs(a, b, keys)
    if unfiltered is not None:
        loose = unique_results(normalized(unfiltered), keys).select(
            *rows, F.col("padj").alias("a_unfiltered_padj"), F.lit(True).alias("_loose")
        )
    else:
        loose = pairs.where(F.lit(False)).select(
            *rows, F.col("a_padj").alias("a_unfiltered_padj"), F.lit(True).alias("_loose")
        )
    joined = pairs.join(set_counts, rows, "left").join(loose, rows, "left")
    overlap = F.coalesce("overlap_size", F.lit(0))
    only_b = F.col("in_b") & ~F.col("in_a")
    loosely = F.coalesce("_loose", F.lit(False))
    said = {k: v.format(a=sides[0], b=sides[1]) for k, v in REASONS.items()}
    reason = (
        F.when(overlap < min_size, said["small"])
        .when(overlap > max_size, said["large"])
        .when(F.col("in_a") & F.col("in_b"), said["shared"])
        .when(only_b & loosely & (F.col("a_unfiltered_padj") > SIGNIFICANT), said["cutoff"])
        .when(only_b & loosely, said["sorted_out"])
        .when(only_b, said["missing"])
        .otherwise(said["only_a"])
    )
    category = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "a_only").otherwise("b_only")
    return joined.select(
        *rows, category.alias("category"), reason.alias("reason"),
        F.coalesce("set_size", F.lit(0)).alias("set_size"), overlap.alias("overlap_size"),
        "a_nes", "b_nes", "a_pvalue", "b_pvalue", "a_padj", "b_padj", "a_unfiltered_padj",
        F.abs(F.col("a_nes") - F.col("b_nes")).alias("nes_abs_diff"),
        relative_error(F.col("a_padj"), F.col("b_padj")).alias("padj_rel_diff"),
    )


def reason_counts(details: DataFrame, keys: Sequence[str] = KEYS, within: DataFrame | None = None) -> DataFrame:
    """Rows per reason, overall or only for the ids in ``within`` (*keys, id)."""
    if within is not None:
        details = details.join(within, [*keys, "id"], "left_semi")
    return details.groupBy(*keys, "category", "reason").agg(F.count(F.lit(1)).alias("sets"))


def ora_ratio_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shared ids with the four counts of both sides, parsed from their ratio texts."""
    keys = list(keys)

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(
            *keys, normalize_set_id("id").alias("id"),
            ratio_part("gene_ratio", 0).alias(f"{p}_overlap"), ratio_part("gene_ratio", 1).alias(f"{p}_n_hits"),
            ratio_part("bg_ratio", 0).alias(f"{p}_set_size"), ratio_part("bg_ratio", 1).alias(f"{p}_n_universe"),
            F.col("padj").alias(f"{p}_padj"),
        )

    return side(a, "a").join(side(b, "b"), [*keys, "id"]).withColumn(
        "padj_rel_err", relative_error(F.col("a_padj"), F.col("b_padj"))
    )


def ora_bias(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per group: do the sides differ in their sets of hit counts or universe sizes."""
    keys = list(keys)
    counts = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("count_name"), F.lit(p == "a").alias("is_a"), F.col(f"{p}_{m}").alias("v"))
                for m in ("n_hits", "n_universe") for p in "ab"
            ]
        )
    )
    flat = pairs.select(*keys, counts.alias("s")).select(*keys, "s.*").where("v is not null")
    per_value = flat.groupBy(*keys, "count_name", "v").agg(
        F.bool_or("is_a").alias("_a"), F.bool_or(~F.col("is_a")).alias("_b")
    )
    return per_value.groupBy(*keys, "count_name").agg(F.bool_or(F.col("_a") != F.col("_b")).alias("mismatch"))


def largest_errors(pairs: DataFrame, k: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k largest relative padj errors per group; the limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("padj_rel_err").desc(), F.col("id").desc())
    known = pairs.where("padj_rel_err is not null")
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
