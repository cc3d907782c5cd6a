"""Composed analyses: rules per contrast, conversion by layers, universes in order of priority."""

import pytest

from setspan.operators import analysis as an

DE = "contrast string, row_no long, gene_id string, value double, direction string, is_sig boolean"
LAYERS = "priority int, layer string, species string, from_type string, to_type string, from_id string, to_id string"


@pytest.fixture(scope="module")
def layers(spark):
    idmap = spark.createDataFrame(
        [("HSA", "SYMBOL", f"GENE{k}", str(k)) for k in range(1, 9)]
        + [("hsa", "SYMBOL", "Twin", "1"), ("hsa", "UNIPROT", "P1234", "3"), ("mmu", "SYMBOL", "GENE1", "900")],
        "species string, from_type string, from_id string, entrez_id string",
    )
    late = spark.createDataFrame([("hsa", "SYMBOL", "GENE9", "9"), ("hsa", "SYMBOL", "GENE1", "77")], idmap.schema)
    return an.map_layer(idmap, "first", 0).unionByName(an.map_layer(late, "second", 1))


def test_target_type(spark):
    rows = spark.createDataFrame(
        [("kegg", None), ("GO", ""), ("reactome", "auto"), ("msigdb", "entrez"), ("custom", None), ("custom", " KEGG "), (None, "odd")],
        "db string, id_type string",
    ).select(an.target_type().alias("t"))
    assert [r.t for r in rows.collect()] == ["ENTREZID", "SYMBOL", "SYMBOL", "ENTREZID", None, "KEGG", None]


def test_typed_conversion(spark, layers):
    wanted = [
        ("hsa", "SYMBOL", "ENTREZID", " gene1 "), ("hsa", "SYMBOL", "ENTREZID", "GENE9"),
        ("hsa", "SYMBOL", "ENTREZID", "missing"), ("mmu", "SYMBOL", "ENTREZID", "GENE1"),
        ("hsa", "ENTREZID", "SYMBOL", "1"), ("hsa", "KEGG", "SYMBOL", "hsa:2"), ("hsa", "SYMBOL", "KEGG", "GENE3"),
        ("hsa", "KEGG", "ENTREZID", "hsa:55"), ("hsa", "ENTREZID", "KEGG", "ncbi-geneid:56"),
        ("hsa", "UNIPROT", "ENTREZID", "up:P1234"), ("hsa", "ENSEMBL", "ENTREZID", "ENSG1"),
    ]
    frame = spark.createDataFrame(wanted + wanted[:2], "species string, from_type string, to_type string, id string")
    got = {}
    for r in an.convert_typed(frame, layers).collect():
        got.setdefault((r.species, r.from_type, r.to_type, r.id), set()).add((r.target, r.layer))
    assert [got[w] for w in wanted] == [
        {("1", "first")}, {("9", "second")}, {("missing", None)}, {("900", "first")},
        {("GENE1", "first"), ("Twin", "first")}, {("GENE2", "first")}, {("hsa:3", "first")},
        {("55", "prefix")}, {("hsa:56", "prefix")}, {("3", "first")}, {("ENSG1", None)},
    ]


def table(contrast, genes, hits=None):
    return [(contrast, k, g, 2.0, "Up", hits is None or g in hits) for k, g in enumerate(genes)]


def outcomes(spark, layers, rules, rows):
    converted, outcome = an.conversion_outcome(
        spark.createDataFrame(rows, DE), spark.createDataFrame(rules, an.RULES), layers
    )
    return converted, outcome, {r.contrast: r for r in outcome.collect()}


def test_policies_and_fallback(spark, layers):
    good, poor = [f"GENE{k}" for k in range(1, 9)], [f"GENE{k}" for k in range(7, 11)]
    rules, rows = [], []
    for name, genes, policy, rate, fallback in [
        ("all", good, "strict", None, False), ("strict", poor, "strict", None, False),
        ("fall", poor, "strict", None, True), ("half", poor, "threshold", 0.5, False),
        ("ninety", poor, None, -1.0, False), ("best", poor, "best-effort", None, False),
    ]:
        rules.append((name, "kegg", "hsa", None, policy, rate, fallback, "table"))
        rows += table(name, genes)
    rules += [("keys", "kegg", "hsa", None, None, None, False, "sets"), ("free", "own", "hsa", None, None, None, False, "sets"),
              ("odd", "kegg", "hsa", None, None, None, False, "sets"), ("absent", "kegg", "hsa", None, None, None, False, "sets")]
    rows += table("keys", ["1", "2"]) + table("free", good) + table("odd", ["?", "-"])
    converted, outcome, by = outcomes(spark, layers, rules, rows)
    assert {c: r.status for c, r in by.items()} == {
        "all": "converted", "strict": "failed", "fall": "fallback", "half": "converted", "ninety": "failed",
        "best": "converted", "keys": "kept", "free": "kept", "odd": "kept",
    }
    # GENE7 and 8 by the first layer, 9 by the second, 10 by none.
    assert (by["half"].mapped, by["half"].total, by["half"].rate) == (3, 4, 0.75)
    tables = an.convert_tables(spark.createDataFrame(rows, DE), converted, outcome)
    genes = {}
    for r in tables.collect():
        genes.setdefault(r.contrast, set()).add(r.gene_id)
    assert "strict" not in genes and "ninety" not in genes
    assert genes["half"] == {"7", "8", "9", "GENE10"} and genes["fall"] == set(poor) and genes["keys"] == {"1", "2"}


def test_type_of_hits_decides(spark, layers):
    """Hits of the target type are left alone, whatever the rest of the table is."""
    rows = table("a", ["1", "2", "GENE3", "GENE4", "GENE5"], hits={"1", "2"})
    _, _, by = outcomes(spark, layers, [("a", "kegg", "hsa", None, None, None, False, "sets")], rows)
    assert by["a"].status == "kept" and by["a"].total is None


def test_first_row_wins(spark, layers):
    rows = [("a", 5, "GENE1", 3.0, "Up", False), ("a", 2, "Gene1", -1.0, "Down", True), ("a", 9, "GENE2", 1.5, "Up", True)]
    rules = [("a", "kegg", "hsa", "entrez", "best-effort", None, False, "table")]
    converted, outcome, _ = outcomes(spark, layers, rules, rows)
    got = an.convert_tables(spark.createDataFrame(rows, DE), converted, outcome).collect()
    assert sorted((r.gene_id, r.value, r.direction, r.is_sig) for r in got) == [
        ("1", -1.0, "Down", True), ("2", 1.5, "Up", True)
    ]


def test_universe_priority(spark):
    sets = spark.createDataFrame(
        [("go", "bp", "t", g) for g in "abcd"] + [("own", "x", "t", g) for g in "abx"] + [("own", "y", "u", "a")],
        "db string, collection string, term_id string, gene_id string",
    )
    names = [("list", "go", "table"), ("anno", "go", "table"), ("tab", "own", "table"), ("sets", "own", "sets")]
    outcome = spark.createDataFrame(names, "contrast string, db string, background string")
    rows = [r for n, _, _ in names for r in table(n, list("abcz") + ["q"], hits=set("abcz"))]
    de = spark.createDataFrame(rows, DE)
    lists = spark.createDataFrame([("list", g) for g in ("a", " z ", "z", None, "", "m")], "contrast string, gene_id string")
    hits = de.where("is_sig").select("contrast", "direction", "gene_id")
    restricted, universe = an.resolve_universe(hits, de, sets, outcome, lists)
    assert {r.contrast: (r.universe, r.n_universe) for r in universe.collect()} == {
        "list": ("list", 3), "anno": ("annotated", 4), "tab": ("table", 5),
        # Three set genes and the hits c and z that no set knows.
        "sets": ("sets", 5),
    }
    left = {}
    for r in restricted.collect():
        left.setdefault(r.contrast, set()).add(r.gene_id)
    assert left == {"list": {"a", "z"}, "anno": set("abc"), "tab": set("abcz"), "sets": set("abcz")}


def test_databases_stay_apart(spark, layers):
    """Two contrasts with the same genes and sets of the same name in two databases."""
    genes = [f"GENE{k}" for k in range(1, 7)]
    rules = [("k", "kegg", "hsa", None, None, None, False, "table"), ("m", "msigdb", "hsa", None, None, None, False, "table")]
    sets = spark.createDataFrame(
        [("kegg", "c", "t", str(k)) for k in range(1, 4)] + [("msigdb", "c", "t", g) for g in genes[3:]]
        + [("msigdb", "c", "t", "1")] + [("kegg", None, "t", "1")],
        "db string, collection string, term_id string, gene_id string",
    )
    de = spark.createDataFrame(table("k", genes) + table("m", genes), DE)
    symbols = spark.createDataFrame([("msigdb", "GENE5", "five"), ("kegg", "1", "never")], "db string, id string, shown string")
    results, outcome = an.analyse(de, sets, spark.createDataFrame(rules, an.RULES), layers, symbols=symbols,
                                  q_cutoff=None, min_size=1, max_size=10)
    got = {r.contrast: r for r in results.collect()}
    assert (got["k"].db, got["k"].overlap, got["k"].genes) == ("kegg", 3, ["GENE1", "GENE2", "GENE3"])
    assert (got["m"].db, got["m"].set_size, got["m"].genes) == ("msigdb", 4, ["GENE4", "five", "GENE6"])
    assert {r.contrast: r.status for r in outcome.collect()} == {"k": "converted", "m": "kept"}


def test_map_keys_are_made_by_all_tasks(spark):
    """a map in one split is spread before its keys are made."""
    from pyspark.sql import functions as F

    from setspan.operators.analysis import convert_typed, map_layer
    from setspan.session import task_slots

    idmap = spark.createDataFrame([("hsa", "SYMBOL", "A", "1"), ("hsa", "SYMBOL", "B", "2")], "species string, from_type string, from_id string, entrez_id string")
    wanted = spark.createDataFrame([("hsa", "SYMBOL", "ENTREZID", g) for g in "abc"], "species string, from_type string, to_type string, id string")
    out = convert_typed(wanted, map_layer(idmap.coalesce(1), "l", 0))
    shape = out._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression {task_slots(spark)}" in shape or f"Repartition {task_slots(spark)}" in shape
    assert sorted((r.id, r.target) for r in out.select("id", F.col("target")).collect()) == [("a", "1"), ("b", "2"), ("c", "c")]
