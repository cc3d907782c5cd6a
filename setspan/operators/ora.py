"""Over-representation analysis for all contrasts, directions and collections in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.functions.ids import ratio_text
from setspan.functions.stats import hypergeom_upper_tail
from setspan.operators.scan import GROUP_ROWS, bh_scan, has_hubs, in_bounds, join_hubs

KEYS = ("contrast", "direction")


def overlap_counts(
    hits: DataFrame, term_gene: DataFrame, keys: Sequence[str] = KEYS, hubs: bool | None = None
) -> DataFrame:
    """Hits per (group, set); sets without a hit never appear.

    The join result is counted map-side before it is shuffled to (group, set), so a gene in
    very many sets or contrasts costs one task no more than its share of the join. A column
    ``set_size`` of the members is carried along.
    """
    carried = [c for c in ("set_size",) if c in term_gene.columns]
    return (
        join_hubs(hits, term_gene, "gene_id", hubs)
        .groupBy(*keys, "collection", "term_id", *carried)
        .agg(F.count(F.lit(1)).alias("overlap"))
    )


def ora(
    hits: DataFrame,
    term_gene: DataFrame,
    universe: DataFrame,
    keys: Sequence[str] = KEYS,
    min_size: int = 10,
    max_size: int | None = 500,
    q_cutoff: float | None = 0.05,
    hit_counts: DataFrame | None = None,
    universe_genes: DataFrame | None = None,
) -> DataFrame:
    """Hypergeometric test of every (group, set), corrected per group and collection.

    hits: (*keys, gene_id). term_gene: (collection, term_id, gene_id). universe: n_universe for
    any of the columns keys + collection. ``hit_counts`` overrides the distinct hit count n
    (used to count repeated rows). ``universe_genes`` (gene_id) restricts sets to it first.
    ``q_cutoff=None`` keeps every tested set; ``max_size=None`` tests sets of any size.
    """
    members = term_gene.select("collection", "term_id", "gene_id").dropna().distinct()
    if universe_genes is not None:
        members = members.join(universe_genes.select("gene_id").distinct(), "gene_id", "left_semi")
    sized = sized_members(members, min_size, max_size)
    return ora_sized(
        hits, sized, universe, has_hubs(term_gene, "gene_id"), keys, max_size, q_cutoff, hit_counts
    )


def sized_members(members: DataFrame, min_size: int = 1, max_size: int | None = None) -> DataFrame:
    """Distinct members with the ``set_size`` of their sets, of sets in bounds.

    Sets out of bounds leave before the join with hits, so a huge set is never multiplied.
    """
    sizes = (
        members.groupBy("collection", "term_id")
        .agg(F.count(F.lit(1)).alias("set_size"))
        .where(in_bounds("set_size", min_size, max_size))
    )
    return members.join(sizes, ["collection", "term_id"])


def ora_sized(
    hits: DataFrame,
    sized: DataFrame,
    universe: DataFrame,
    hubs: bool,
    keys: Sequence[str] = KEYS,
    max_size: int | None = None,
    q_cutoff: float | None = 0.05,
    hit_counts: DataFrame | None = None,
) -> DataFrame:
    """``ora`` for members that are distinct and know their set's size.

    ``hubs``: whether some gene has so many memberships that the join must split it. ``max_size`` is
    the caller's bound on the sizes there are.
    """
    keys = list(keys)
    # Null ids match nothing; dropping them here lets both uses of each frame share its shuffle.
    distinct_hits = hits.select(*keys, "gene_id").dropna().distinct()
    if hit_counts is None:
        hit_counts = distinct_hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"))
    shared = [c for c in universe.columns if c != "n_universe"]
    overlaps = overlap_counts(distinct_hits, sized, keys, hubs)
    # p depends on four counts alone, so rows are reduced to distinct (overlap, set size) pairs per
    # group before the per-group counts are joined, the test runs and p is corrected: at most
    # max_size^2 / 2 rows per group, however many sets there are; without a bound the rows are
    # counted before they are corrected.
    pair = [*keys, "collection", "overlap", "set_size"]
    pairs = (
        overlaps.groupBy(*pair)
        .agg(F.count(F.lit(1)).alias("_sets"))
        .join(hit_counts, keys)
        .join(universe, shared)
        .withColumn("pvalue", hypergeom_upper_tail("overlap", "n_hits", "set_size", "n_universe"))
    )
    split = False if max_size is not None and max_size * max_size / 2 <= GROUP_ROWS else None
    tested = bh_scan(pairs, [*keys, "collection"], "pvalue", "_sets", split=split)
    adjusted = overlaps.join(tested.drop("_sets"), pair)
    result = adjusted.withColumn("qvalue", F.col("padj"))
    if q_cutoff is not None:
        result = result.where(F.col("qvalue") <= q_cutoff)
    return result.select(
        *keys, "collection", "term_id", "overlap", "n_hits", "set_size", "n_universe",
        "pvalue", "padj", "qvalue",
    )


def with_hit_genes(
    result: DataFrame, hits: DataFrame, term_gene: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add the sorted overlap genes of surviving rows; a list is never longer than its set.

    Sets without a surviving row leave first; then hits meet members on the gene, as in the test,
    so members are only repeated for contrasts that hit them.
    """
    keys = list(keys)
    rows = [*keys, "collection", "term_id"]
    survivors = result.select("collection", "term_id").distinct()
    members = (
        term_gene.select("collection", "term_id", "gene_id")
        .dropna()
        .distinct()
        .join(survivors, ["collection", "term_id"], "left_semi")
    )
    listed = (
        join_hubs(hits.select(*keys, "gene_id").dropna().distinct(), members, "gene_id", has_hubs(term_gene, "gene_id"))
        .join(result.select(*rows), rows, "left_semi")
        .groupBy(*rows)
        .agg(F.array_sort(F.collect_list("gene_id")).alias("genes"))
    )
    return result.join(listed, rows, "left")


def with_ratios(result: DataFrame) -> DataFrame:
    return result.withColumn("gene_ratio", ratio_text("overlap", "n_hits")).withColumn(
        "bg_ratio", ratio_text("set_size", "n_universe")
    )


def ora_order() -> list[Column]:
    """Up before Down, then p, then id."""
    return [F.col("direction").desc(), F.col("pvalue").asc(), F.col("term_id").asc()]
