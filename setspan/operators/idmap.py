"""Identifier conversion as joins.

The canonical map is a long table (species, from_type, from_id, entrez_id, source): every type
is stored towards ENTREZID and read in either direction. Symbols match on their upper-case form
and keep their own spelling on output. Anything with columns (from_id, to_id) can be a layer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.functions.ids import UNKNOWN, clean, detect_id_type, normalize_id
from setspan.operators.scan import broadcast_if_small, join_hubs

ENTREZ = "ENTREZID"
POLICIES = ("best-effort", "threshold", "strict")
CONVERTIBLE = ("SYMBOL", ENTREZ, "KEGG")


def canonical_direction(from_type: str, to_type: str) -> tuple[str, bool]:
    """(stored type, forward) of a conversion; one side must be ENTREZID and not both."""
    from_type, to_type = from_type.strip().upper(), to_type.strip().upper()
    if from_type != to_type and to_type == ENTREZ:
        return from_type, True
    if from_type != to_type and from_type == ENTREZ:
        return to_type, False
    raise ValueError(f"unsupported map direction {from_type} -> {to_type}")


def map_direction(idmap: DataFrame, species: str, from_type: str, to_type: str) -> DataFrame:
    """(from_id, to_id) of one direction, distinct; filters prune the map's partitions."""
    stored, forward = canonical_direction(from_type, to_type)
    rows = idmap.where((F.col("species") == species.lower()) & (F.col("from_type") == stored))
    pair = ("from_id", "entrez_id") if forward else ("entrez_id", "from_id")
    return rows.select(F.col(pair[0]).alias("from_id"), F.col(pair[1]).alias("to_id")).distinct()


def scan_idmap(idmap: DataFrame, species: str, from_type: str, to_type: str) -> DataFrame:
    return map_direction(idmap, species, from_type, to_type).orderBy("from_id", "to_id")


def lookup_idmap(
    ids: DataFrame, idmap: DataFrame, species: str, from_type: str, to_type: str
) -> DataFrame:
    """(id, target) for ids present in the map; missing ids are absent."""
    pairs = map_direction(idmap, species, from_type, to_type)
    fold = F.upper if "SYMBOL" == from_type.upper() else (lambda c: c)
    wanted = ids.select("id", fold(F.trim(F.col("id"))).alias("_key")).distinct()
    keyed = pairs.select(fold(F.trim(F.col("from_id"))).alias("_key"), clean("to_id").alias("target"))
    return wanted.join(keyed.where("target is not null"), "_key").select("id", "target").distinct()


def convert_ids(
    ids: DataFrame, idmap: DataFrame, species: str, from_type: str, to_type: str
) -> DataFrame:
    """(id, target) through ENTREZID; KEGG ids are ENTREZ ids with a species prefix."""
    if from_type not in CONVERTIBLE or to_type not in CONVERTIBLE:
        raise ValueError(f"unsupported conversion {from_type} -> {to_type}")
    distinct = ids.select("id").distinct()
    if from_type == "SYMBOL":
        hop = lookup_idmap(distinct, idmap, species, "SYMBOL", ENTREZ)
        hop = hop.withColumnRenamed("target", "entrez")
    else:
        entrez = F.nullif(normalize_id("id", ENTREZ, species), F.lit(""))
        hop = distinct.select("id", entrez.alias("entrez")).where("entrez is not null")
    if to_type == ENTREZ:
        return hop.select("id", F.col("entrez").alias("target")).distinct()
    if to_type == "KEGG":
        prefixed = F.concat(F.lit(species + ":"), F.col("entrez"))
        return hop.select("id", prefixed.alias("target")).distinct()
    back = map_direction(idmap, species, ENTREZ, "SYMBOL")
    return (
        hop.join(back, hop["entrez"] == back["from_id"])
        .select("id", clean("to_id").alias("target"))
        .where("target is not null")
        .distinct()
    )


def is_converted(target: Column, source: Column) -> Column:
    return clean(target).isNotNull() & (target != source)


def convert_layers(ids: DataFrame, layers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(id, target, layer): each id takes the first layer that gives an id other than itself.

    All layers are joined at once and the smallest priority per id wins; ids no layer converts
    map to themselves with a null layer. A layer that could not be read is simply not passed.
    """
    if not layers:
        raise ValueError("no conversion layers")
    stacked = None
    for priority, (name, pairs) in enumerate(layers):
        rows = pairs.select(
            F.col("from_id").alias("id"), clean("to_id").alias("target"),
            F.lit(priority).alias("_priority"), F.lit(name).alias("layer"),
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    distinct = ids.select("id").distinct()
    # A layer wins for an id as a whole, so its unchanged targets stay with the changed ones.
    changed = stacked.where(is_converted(F.col("target"), F.col("id")))
    best = changed.groupBy("id").agg(F.min("_priority").alias("_priority"))
    found = stacked.join(best, ["id", "_priority"]).where("target is not null")
    return (
        distinct.join(found.select("id", "target", "layer").distinct(), "id", "left")
        .withColumn("target", F.coalesce("target", "id"))
    )


def species_table_layer(pairs: DataFrame, species: str, from_type: str, to_type: str) -> DataFrame:
    """Layer from one species table (entrez_id, symbol) for SYMBOL, ENTREZID and KEGG ids."""
    def form(kind: str) -> Column:
        if kind == "SYMBOL":
            return F.col("symbol")
        if kind == ENTREZ:
            return F.col("entrez_id")
        if kind == "KEGG":
            return F.concat(F.lit(species + ":"), F.col("entrez_id"))
        raise ValueError(f"unsupported id type {kind}")

    return pairs.select(form(from_type).alias("from_id"), form(to_type).alias("to_id")).distinct()


def layer_hits(converted: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Distinct ids each layer converted; per contrast when table rows (contrast, id) are given."""
    hit = converted.where("layer is not null").select("id", "layer").distinct()
    if rows is None:
        return hit.groupBy("layer").agg(F.count(F.lit(1)).alias("hits"))
    distinct = rows.select("contrast", "id").distinct()
    return distinct.join(hit, "id").groupBy("contrast", "layer").agg(F.count(F.lit(1)).alias("hits"))


def majority_id_type(rows: DataFrame, keys: Sequence[str] = ("contrast",)) -> DataFrame:
    """Type of more than half of a list's ids, unknown ids counted in the total; else unknown."""
    keys = list(keys)
    typed = rows.groupBy(*keys, detect_id_type("id").alias("id_type")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    known = F.when(F.col("id_type") != UNKNOWN, F.col("_n"))
    top = F.max_by("id_type", F.struct(known, "id_type"))
    return typed.groupBy(*keys).agg(
        F.when(F.max(known) / F.sum("_n") > 0.5, top).otherwise(UNKNOWN).alias("id_type"),
        F.sum("_n").alias("ids"),
    )


def conversion_report(
    rows: DataFrame,
    converted: DataFrame,
    target_type: str,
    policy: str = "threshold",
    min_rate: float = 0.9,
) -> DataFrame:
    """One row per contrast: ids seen, mapped and unmapped (repeats counted), rate, verdict.

    rows: (contrast, id). converted: (id, target). A contrast already of the target type
    counts as fully mapped; one without a majority type never passes.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    min_rate = 0.9 if min_rate <= 0 else min(min_rate, 1.0)
    mapped = converted.where(is_converted(F.col("target"), F.col("id"))).select("id").distinct()
    types = majority_id_type(rows).select("contrast", F.col("id_type").alias("input_type"))
    # Repeats become counts before the join, so an id in a third of the rows is one row there.
    seen = rows.groupBy("contrast", "id").agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col("_hit").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    counted = (
        seen.join(mapped.withColumn("_hit", F.lit(1)), "id", "left")
        .groupBy("contrast")
        .agg(F.sum("_n").alias("total"), F.sum(hit).alias("_mapped"))
    )
    same = F.col("input_type") == target_type
    report = (
        counted.join(types, "contrast")
        .withColumn("mapped", F.when(same, F.col("total")).otherwise(F.col("_mapped")))
        .withColumn("unmapped", F.col("total") - F.col("mapped"))
        .withColumn("rate", F.col("mapped") / F.col("total"))
    )
    verdict = {
        "best-effort": F.lit(True),
        "threshold": F.col("rate") >= min_rate,
        "strict": F.col("unmapped") == 0,
    }[policy]
    return report.select(
        "contrast", "total", "mapped", "unmapped", "rate", "input_type",
        F.lit(target_type).alias("target_type"), F.lit(policy).alias("policy"),
        (verdict & (F.col("input_type") != UNKNOWN)).alias("passed"),
    )


def require_conversion(report: DataFrame) -> None:
    """Raise when some contrast fails its policy; reads at most five report rows."""
    failing = report.where("not passed").select("contrast", "mapped", "total").limit(5).collect()
    if failing:
        raise ValueError("id conversion failed: " + "; ".join(f"{r[0]} {r[1]}/{r[2]}" for r in failing))


def apply_conversion(
    de: DataFrame, converted: DataFrame, report: DataFrame | None = None, hits_only: bool = False
) -> DataFrame:
    """Table with converted gene ids, one row per new id, first source in row order winning.

    A new id is significant when any of its sources is. ``hits_only`` converts and keeps only
    significant rows. Contrasts whose ``report`` row did not pass, and those whose ids are of the
    target type already, keep their ids.
    """
    carried = [c for c in ("value", "direction") if c in de.columns]
    rows = collapse_genes(de.where("is_sig") if hits_only else de, carried)
    pairs = converted.select(F.col("id").alias("gene_id"), clean("target").alias("_new"))
    moved = rows.join(pairs.where("_new is not null"), "gene_id")
    if report is not None:
        moves = F.col("passed")
        if {"input_type", "target_type"} <= set(report.columns):
            moves = moves & ~F.col("input_type").eqNullSafe(F.col("target_type"))
        verdict = broadcast_if_small(report.select("contrast", moves.alias("_moves")))
        moved = moved.join(verdict, "contrast").where("_moves").drop("_moves")
        kept = rows.join(verdict, "contrast").where("not _moves").drop("_moves")
        moved = moved.unionByName(kept.withColumn("_new", F.col("gene_id")))
    return collapse_genes(moved.drop("gene_id").withColumnRenamed("_new", "gene_id"), carried)


def collapse_genes(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per (contrast, gene): the first in row order, significant if any was.

    Run before the join as well as after it: a much repeated gene is one row per map task there.
    """
    row = F.struct(*carried, "row_no")
    first = F.min_by(row, F.struct("row_no", row))
    return (
        rows.groupBy("contrast", "gene_id")
        .agg(first.alias("_row"), F.bool_or("is_sig").alias("is_sig"))
        .select("contrast", "gene_id", "_row.*", "is_sig")
    )


def display_genes(
    results: DataFrame, keys: Sequence[str], genes: str, pairs: DataFrame, symbols: DataFrame
) -> DataFrame:
    """Readable ids of surviving result genes, in their order.

    pairs: (id, shown) from the conversion, used first; symbols: (id, shown) fills the gaps;
    an id in neither is shown as it is. Lists stay as long as they were. Either may have some of
    the ``keys``, and then holds for rows of those alone. Names are looked up once for each
    distinct id; an id in very many lists is split when it meets them again.
    """
    keys = list(keys)
    scoped = [k for k in keys if k in pairs.columns or k in symbols.columns]
    rows = results.select(*keys, F.posexplode(genes).alias("_pos", "id")).withColumn(
        "_key", F.struct(*scoped, "id")
    )
    named = rows.select("_key").distinct().select("_key", "_key.*")
    for names, out in ((pairs, "_pair"), (symbols, "_symbol")):
        on = [*[k for k in scoped if k in names.columns], "id"]
        named = named.join(names.groupBy(*on).agg(F.min("shown").alias(out)), on, "left")
    names = named.select("_key", F.coalesce("_pair", "_symbol", "id").alias("_shown"))
    shown = (
        join_hubs(names, rows.drop("id"), "_key")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_shown"))).getField("_shown").alias(genes))
    )
    return results.drop(genes).join(shown, keys, "left")


def distinct_rates(rows: DataFrame, idmap: DataFrame, threshold: float) -> DataFrame:
    """Share of distinct ids found in the map, all and significant, per contrast.

    rows: (contrast, gene_id, is_sig). The verdict looks at the significant ids.
    """
    known = idmap.select(F.upper(F.trim(F.col("from_id"))).alias("_key")).distinct()
    ids = (
        rows.select("contrast", clean("gene_id").alias("id"), "is_sig")
        .where("id is not null")
        .groupBy("contrast", "id")
        .agg(F.bool_or("is_sig").alias("is_sig"))
        .withColumn("_key", F.upper("id"))
        .join(known.withColumn("_hit", F.lit(True)), "_key", "left")
    )
    hit = F.col("_hit").isNotNull()
    counted = ids.groupBy("contrast").agg(
        F.count(F.lit(1)).alias("all_total"),
        F.count_if(hit).alias("all_mapped"),
        F.count_if("is_sig").alias("sig_total"),
        F.count_if(hit & F.col("is_sig")).alias("sig_mapped"),
    )
    def rate(kind: str) -> Column:
        total, mapped = F.col(f"{kind}_total"), F.col(f"{kind}_mapped")
        return F.when(total > 0, mapped / total).otherwise(0.0)

    return (
        counted.withColumn("all_rate", rate("all"))
        .withColumn("sig_rate", rate("sig"))
        .withColumn("passed", F.col("sig_rate") >= threshold)
    )
