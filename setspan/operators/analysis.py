"""Whole analyses of many contrasts in one plan, each by rules of its own.

Rules are rows, one a contrast:

* ``contrast``, ``db`` (whose sets it is tested with) and ``species``;
* ``id_type``: entrez, symbol, uniprot or kegg; null, blank, auto and anything else leave it to
  the database;
* ``policy`` (strict, threshold, best-effort; null is threshold), ``min_rate`` (null or not
  positive is 0.9, above 1 is 1) and ``fallback``, whether ids stay as they are if conversion fails;
* ``background``: ``table`` to count all genes of the contrast's table, anything else for the
  genes of the sets united with the hits.

Every step is a join with these rows, so contrasts of different id types, databases, policies
and universes share one plan. Genes and collections carry their database while they meet, so no
contrast sees the sets of another database.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.functions.ids import DATABASE_ID_TYPE, UNKNOWN, clean, normalize_id
from setspan.operators.de import directed_hits
from setspan.operators.idmap import (
    ENTREZ,
    collapse_genes,
    display_genes,
    is_converted,
    majority_id_type,
)
from setspan.operators.ora import KEYS, ora, with_hit_genes
from setspan.operators.scan import broadcast_if_small
from setspan.session import cut_lineage, task_slots

RULES = (
    "contrast string, db string, species string, id_type string, policy string, min_rate double, "
    "fallback boolean, background string"
)

# Names of id types in requests.
REQUESTED_TYPES = {"entrez": ENTREZ, "symbol": "SYMBOL", "uniprot": "UNIPROT", "kegg": "KEGG"}

# Databases whose universe is the genes they annotate.
ANNOTATED = ("go",)

# What became of a contrast's ids.
KEPT, CONVERTED, FALLBACK, FAILED = "kept", "converted", "fallback", "failed"

PREFIX_LAYER = "prefix"
TYPED = ["species", "from_type", "to_type"]


def _choose(column: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(F.coalesce(column, F.lit("")))))


def target_type(db: str = "db", id_type: str = "id_type") -> Column:
    """The id type a contrast is converted to, or null: the requested one, else the database's."""
    return F.coalesce(
        _choose(F.col(id_type), REQUESTED_TYPES), _choose(F.col(db), DATABASE_ID_TYPE)
    )


def match_key(c: Column, kind: Column, species: Column) -> Column:
    """The form in which ids of a type are compared."""
    bare = F.trim(c)
    prefix = F.concat(F.lower(species), F.lit(":"))
    own = F.when(bare.startswith(prefix), F.substring(bare, F.length(prefix) + 1, F.length(bare)))
    entrez = normalize_id(F.coalesce(own, bare), ENTREZ, "")
    key = F.when(kind.isin(ENTREZ, "KEGG"), entrez)
    for name in ("SYMBOL", "UNIPROT", "ENSEMBL", "REFSEQ"):
        key = key.when(kind == name, normalize_id(c, name, ""))
    return key.otherwise(bare)


def map_layer(idmap: DataFrame, layer: str, priority: int) -> DataFrame:
    """All directions of a canonical map (species, from_type, from_id, entrez_id) as one layer.

    Every type goes to ENTREZID and back, and to and from KEGG, which is ENTREZID with a prefix.
    """
    kegg = F.concat(F.lower("species"), F.lit(":"), F.col("entrez_id"))
    ways = [
        (F.col("from_type"), F.lit(ENTREZ), F.col("from_id"), F.col("entrez_id")),
        (F.lit(ENTREZ), F.col("from_type"), F.col("entrez_id"), F.col("from_id")),
        (F.col("from_type"), F.lit("KEGG"), F.col("from_id"), kegg),
        (F.lit("KEGG"), F.col("from_type"), kegg, F.col("from_id")),
    ]
    rows = F.array(
        *[
            F.struct(a.alias("from_type"), b.alias("to_type"), c.alias("from_id"), d.alias("to_id"))
            for a, b, c, d in ways
        ]
    )
    return (
        idmap.where(F.col("from_type") != ENTREZ)
        .select(F.lower("species").alias("species"), F.explode(rows).alias("w"))
        .select(F.lit(priority).alias("priority"), F.lit(layer).alias("layer"), "species", "w.*")
    )


def convert_typed(wanted: DataFrame, layers: DataFrame) -> DataFrame:
    """(species, from_type, to_type, id, target, layer) for distinct wanted ids of any types.

    An id takes the first layer that gives it an id other than itself, with all that the layer
    gives; ids that none converts map to themselves with a null layer. ENTREZID and KEGG turn
    into each other by their form, which comes before any layer.
    """
    ids = [*TYPED, "id"]
    keyed = wanted.select(*ids).distinct().withColumn(
        "_key", match_key(F.col("id"), F.col("from_type"), F.col("species"))
    )
    entrez = F.col("_key")
    formed = F.when(F.col("to_type") == "KEGG", F.concat(F.col("species"), F.lit(":"), entrez)).otherwise(entrez)
    pair = F.col("from_type").isin(ENTREZ, "KEGG") & F.col("to_type").isin(ENTREZ, "KEGG")
    by_form = keyed.where(pair & (F.col("_key") != "")).select(
        *ids, F.lit(-1).alias("priority"), F.lit(PREFIX_LAYER).alias("layer"), formed.alias("target")
    )
    # A map comes in a few splits of small files that hold many rows: keys are made by all tasks.
    rows = layers.repartition(task_slots(layers.sparkSession)).select(
        "priority", "layer", *TYPED, clean("to_id").alias("target"),
        match_key(F.col("from_id"), F.col("from_type"), F.col("species")).alias("_key"),
    ).where("target is not null and _key <> ''")
    # Merged here and below: maps and sets are judged by their files and would be broadcast.
    by_layer = keyed.where(~pair).join(rows.hint("merge"), [*TYPED, "_key"]).select(*ids, "priority", "layer", "target")
    given = by_form.unionByName(by_layer).distinct()
    # Few rows an id: what the layers know of it.
    best = (
        given.where(is_converted(F.col("target"), F.col("id")))
        .groupBy(*ids)
        .agg(F.min("priority").alias("priority"))
    )
    found = given.join(best.hint("merge"), [*ids, "priority"]).select(*ids, "target", "layer")
    return (
        keyed.select(*ids)
        .join(found.hint("merge"), ids, "left")
        .withColumn("target", F.coalesce("target", "id"))
    )


def conversion_outcome(de: DataFrame, rules: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(converted, outcome): what ids turn into, and one row a contrast on how it went.

    Whether a contrast needs conversion is told by the type of most of its significant ids; the
    type converted from by that of all its ids. Rules without a table have no outcome. outcome: contrast, db, species, from_type,
    to_type, total, mapped, rate (repeated rows counted) and status. A contrast whose conversion
    does not pass its policy is ``fallback`` or ``failed``.
    """
    kinds = rules.withColumn("to_type", target_type()).withColumn("species", F.lower("species"))
    hits = majority_id_type(de.where("is_sig").select("contrast", F.col("gene_id").alias("id")))
    every = majority_id_type(de.select("contrast", F.col("gene_id").alias("id")))
    typed = (
        kinds.join(hits.select("contrast", F.col("id_type").alias("_hits")), "contrast", "left")
        .join(every.select("contrast", F.col("id_type").alias("from_type")), "contrast")
        .withColumn("_hits", F.coalesce("_hits", F.lit(UNKNOWN)))
        .withColumn(
            "_moves",
            F.col("to_type").isNotNull() & (F.col("_hits") != UNKNOWN) & (F.col("_hits") != F.col("to_type")),
        )
    )
    typed = cut_lineage(typed)  # a row a contrast
    few = broadcast_if_small(typed)
    # Repeats become counts first, so an id in a third of the rows is one row from here on.
    seen = (
        de.groupBy("contrast", F.col("gene_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(few.where("_moves"), "contrast")
        .select("contrast", *TYPED, "id", "_n")
    )
    converted = cut_lineage(convert_typed(seen, layers))
    mapped = converted.where(is_converted(F.col("target"), F.col("id"))).select(*TYPED, "id").distinct()
    counted = (
        seen.join(mapped.withColumn("_hit", F.lit(True)).hint("merge"), [*TYPED, "id"], "left")
        .groupBy("contrast")
        .agg(
            F.sum("_n").alias("total"),
            F.sum(F.when(F.col("_hit") | (F.col("from_type") == F.col("to_type")), F.col("_n")).otherwise(0)).alias("mapped"),
        )
    )
    least = F.least(F.when(F.col("min_rate") > 0, F.col("min_rate")).otherwise(0.9), F.lit(1.0))
    policy = F.coalesce(F.col("policy"), F.lit("threshold"))
    passes = (F.col("from_type") != UNKNOWN) & (
        F.when(policy == "best-effort", True)
        .when(policy == "strict", F.col("mapped") == F.col("total"))
        .otherwise(F.col("mapped") / F.col("total") >= least)
    )
    status = (
        F.when(~F.col("_moves"), KEPT)
        .when(passes, CONVERTED)
        .when(F.coalesce("fallback", F.lit(False)), FALLBACK)
        .otherwise(FAILED)
    )
    outcome = typed.join(counted, "contrast", "left").select(
        "contrast", "db", *TYPED, "background", "total", "mapped",
        (F.col("mapped") / F.col("total")).alias("rate"), status.alias("status"),
    )
    return converted, cut_lineage(outcome)


def convert_tables(de: DataFrame, converted: DataFrame, outcome: DataFrame) -> DataFrame:
    """The tables with converted ids where that went well; failed contrasts are left out.

    One row a (contrast, gene): the first source in row order gives value and direction, and a
    gene is significant if any of its sources is.
    """
    carried = [c for c in ("value", "direction") if c in de.columns]
    rows = collapse_genes(de, carried).join(
        broadcast_if_small(outcome.select("contrast", *TYPED, "status")), "contrast"
    )
    moved = (
        rows.where(F.col("status") == CONVERTED)
        .withColumnRenamed("gene_id", "id")
        .join(converted.select(*TYPED, "id", "target").hint("merge"), [*TYPED, "id"])
        .withColumnRenamed("target", "gene_id")
    )
    columns = ["contrast", "gene_id", *carried, "row_no", "is_sig"]
    kept = rows.where(F.col("status").isin(KEPT, FALLBACK))
    return collapse_genes(moved.select(*columns), carried).unionByName(kept.select(*columns))


def resolve_universe(
    hits: DataFrame,
    de: DataFrame,
    sets: DataFrame,
    outcome: DataFrame,
    lists: DataFrame | None = None,
    annotated: Sequence[str] = ANNOTATED,
) -> tuple[DataFrame, DataFrame]:
    """(hits, universe): hits restricted as their universe asks, and its size as rows.

    Of the universes a contrast could have the first of these is taken: ``list``, the genes given
    for it in ``lists`` (contrast, gene_id); ``annotated``, the genes of a database that is its own
    universe; ``table``, all genes of its table, if its rules say so; ``sets``, the genes of the
    database's sets united with the group's hits. The first two restrict hits to their genes.
    universe: (contrast, direction, universe, n_universe).
    """
    if lists is None:
        lists = hits.select("contrast", "gene_id").limit(0)
    listed = lists.select("contrast", clean("gene_id").alias("gene_id")).where("gene_id is not null").distinct()
    set_genes = sets.select("db", "gene_id").dropna().distinct()
    given = listed.groupBy("contrast").agg(F.count(F.lit(1)).alias("_list"))
    own = set_genes.groupBy("db").agg(F.count(F.lit(1)).alias("_genes"))
    whole = de.groupBy("contrast").agg(F.countDistinct("gene_id").alias("_table"))
    kind = (
        F.when(F.col("_list").isNotNull(), "list")
        .when(F.lower("db").isin(*annotated), "annotated")
        .when(F.col("background") == "table", "table")
        .otherwise("sets")
    )
    sizes = (
        outcome.select("contrast", "db", "background")
        .join(given, "contrast", "left")
        .join(own, "db", "left")
        .join(whole, "contrast", "left")
        .withColumn("universe", kind)
    )
    sizes = broadcast_if_small(cut_lineage(sizes))  # a row a contrast
    rows = hits.join(sizes.select("contrast", "db", "universe"), "contrast")
    free = rows.where("universe in ('table', 'sets')")
    in_list = rows.where("universe = 'list'").join(listed.hint("merge"), ["contrast", "gene_id"], "left_semi")
    known = rows.join(set_genes.withColumn("_known", F.lit(True)).hint("merge"), ["db", "gene_id"])
    in_sets = known.where("universe = 'annotated'").drop("_known")
    restricted = free.unionByName(in_list).unionByName(in_sets).select("contrast", "direction", "gene_id")
    # Set genes are counted once a database; a group adds its hits that no set knows.
    groups = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_hits"))
    covered = known.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_known"))
    united = F.coalesce("_genes", F.lit(0)) + F.col("_hits") - F.coalesce("_known", F.lit(0))
    size = (
        F.when(F.col("universe") == "list", F.col("_list"))
        .when(F.col("universe") == "annotated", F.col("_genes"))
        .when(F.col("universe") == "table", F.col("_table"))
        .otherwise(united)
    )
    universe = (
        groups.join(covered, list(KEYS), "left")
        .join(sizes, "contrast")
        .select(*KEYS, "universe", size.alias("n_universe"))
    )
    return restricted, universe


def analyse(
    de: DataFrame,
    sets: DataFrame,
    rules: DataFrame,
    layers: DataFrame,
    lists: DataFrame | None = None,
    symbols: DataFrame | None = None,
    annotated: Sequence[str] = ANNOTATED,
    **bounds,
) -> tuple[DataFrame, DataFrame]:
    """(results, outcome): conversion, universes, tests, gene lists and readable genes in one.

    de: (contrast, row_no, gene_id, value, direction, is_sig). sets: (db, collection, term_id,
    gene_id). symbols: (db, id, shown), names for genes that conversion did not bring along.
    ``bounds`` goes to ``ora``. The genes of a result are shown as the ids they came from (the
    smallest of several), else by ``symbols``, else as they are.
    """
    converted, outcome = conversion_outcome(de, rules, layers)
    tables = cut_lineage(convert_tables(de, converted, outcome))
    hits, universe = resolve_universe(directed_hits(tables), tables, sets, outcome, lists, annotated)
    databases = broadcast_if_small(outcome.select("contrast", "db"))
    # The database goes with a gene as one value: no contrast meets the sets of another one.
    own = F.struct("db", "gene_id").alias("gene_id")
    placed = cut_lineage(hits.join(databases, "contrast").select(*KEYS, own))
    members = sets.dropna(subset=["db", "collection", "term_id", "gene_id"]).select(
        F.struct("db", "collection").alias("collection"), "term_id", own
    )
    sizes = cut_lineage(universe)
    result = cut_lineage(ora(placed, members, sizes.drop("universe"), **bounds))
    listed = with_hit_genes(result, placed, members).join(
        broadcast_if_small(sizes.select(*KEYS, "universe")), list(KEYS)
    )
    plain = listed.withColumn("genes", F.transform("genes", lambda g: g["gene_id"])).select(
        *KEYS, "collection.*", *[c for c in listed.columns if c not in (*KEYS, "collection")]
    )
    moved = outcome.where(F.col("status") == CONVERTED).select("contrast", *TYPED)
    sources = de.select("contrast", F.col("gene_id").alias("id")).distinct()
    pairs = (
        sources.join(broadcast_if_small(moved), "contrast")
        .join(converted.select(*TYPED, "id", "target").hint("merge"), [*TYPED, "id"])
        .select("contrast", F.col("target").alias("id"), F.col("id").alias("shown"))
    )
    if symbols is None:
        symbols = pairs.select(F.lit("").alias("db"), "id", "shown").limit(0)
    keys = [*KEYS, "db", "collection", "term_id"]
    return display_genes(plain, keys, "genes", pairs, symbols), outcome
