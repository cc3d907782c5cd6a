import pytest
from pyspark.sql import functions as F

from setspan.functions import ids
from setspan.operators import idmap as im

TYPED = [
    ("7157", "ENTREZID"), ("1", "ENTREZID"), ("TP53", "SYMBOL"), ("Egfr", "SYMBOL"), ("BRCA1", "SYMBOL"),
    ("ENSG00000141510", "ENSEMBL"), ("ensmusg00000059552", "ENSEMBL"), ("P04637", "UNIPROT"), ("Q12888", "UNIPROT"),
    ("NM_000546", "REFSEQ"), ("NP_000537", "REFSEQ"), ("NR_1", "REFSEQ"), ("hsa:7157", "KEGG"), ("mmu:22059", "KEGG"),
    ("HLA-A", "unknown"), ("a.b", "unknown"), ("", "unknown"), ("ENSG1", "SYMBOL"), ("7157\n", "ENTREZID"),
]


def test_id_types(spark):
    df = spark.createDataFrame(TYPED, "id string, want string")
    for r in df.select("id", "want", ids.detect_id_type("id").alias("got")).collect():
        assert r.got == r.want, r


def test_majority(spark):
    rows = [("a", x) for x in ("TP53", "EGFR", "7157")] + [("b", x) for x in ("TP53", "7157")] + [("c", x) for x in ("-", "?", "TP53")]
    got = {r.contrast: r.id_type for r in im.majority_id_type(spark.createDataFrame(rows, "contrast string, id string")).collect()}
    assert got == {"a": "SYMBOL", "b": "unknown", "c": "unknown"}


MAP = [
    ("hsa", "SYMBOL", "TP53", "7157", "s"), ("hsa", "SYMBOL", "Egfr", "1956", "s"), ("hsa", "SYMBOL", "A", "1", "s"),
    ("hsa", "SYMBOL", "A", "2", "s"), ("hsa", "SYMBOL", "B", "3", "s"), ("mmu", "SYMBOL", "TP53", "22059", "s"),
]


@pytest.fixture(scope="module")
def idmap(spark):
    return spark.createDataFrame(MAP, "species string, from_type string, from_id string, entrez_id string, source string")


def ids_frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def pairs(df):
    return sorted((r.id, r.target) for r in df.collect())


def test_lookup(spark, idmap):
    wanted = ids_frame(spark, "tp53", "EGFR", "MISSING", "A")
    assert pairs(im.lookup_idmap(wanted, idmap, "hsa", "SYMBOL", "ENTREZID")) == [("A", "1"), ("A", "2"), ("EGFR", "1956"), ("tp53", "7157")]
    assert pairs(im.lookup_idmap(ids_frame(spark, "7157", "9"), idmap, "hsa", "ENTREZID", "SYMBOL")) == [("7157", "TP53")]
    for bad in (("SYMBOL", "KEGG"), ("ENTREZID", "ENTREZID")):
        with pytest.raises(ValueError):
            im.lookup_idmap(wanted, idmap, "hsa", *bad)
    assert [r.from_id for r in im.scan_idmap(idmap, "hsa", "SYMBOL", "ENTREZID").collect()] == ["A", "A", "B", "Egfr", "TP53"]


def test_two_hop(spark, idmap):
    assert pairs(im.convert_ids(ids_frame(spark, "hsa:7157", "1956"), idmap, "hsa", "KEGG", "SYMBOL")) == [("1956", "Egfr"), ("hsa:7157", "TP53")]
    assert pairs(im.convert_ids(ids_frame(spark, "tp53"), idmap, "hsa", "SYMBOL", "KEGG")) == [("tp53", "hsa:7157")]
    assert pairs(im.convert_ids(ids_frame(spark, "hsa:5", "ncbi-geneid:6"), idmap, "hsa", "KEGG", "ENTREZID")) == [("hsa:5", "5"), ("ncbi-geneid:6", "6")]
    with pytest.raises(ValueError):
        im.convert_ids(ids_frame(spark, "x"), idmap, "hsa", "UNIPROT", "SYMBOL")


def layer(spark, *rows):
    return spark.createDataFrame(list(rows), "from_id string, to_id string")


def test_layers(spark):
    one = layer(spark, ("a", "a"), ("b", "b1"), ("b", "b2"), ("c", " "))
    two = layer(spark, ("a", "a9"), ("b", "zz"), ("c", "c9"))
    got = im.convert_layers(ids_frame(spark, "a", "b", "c", "d", "d"), [("one", one), ("two", two)])
    assert sorted((r.id, r.target, r.layer or "") for r in got.collect()) == [
        ("a", "a9", "two"), ("b", "b1", "one"), ("b", "b2", "one"), ("c", "c9", "two"), ("d", "d", "")
    ]
    assert {r.layer: r.hits for r in im.layer_hits(got).collect()} == {"one": 1, "two": 2}
    table = spark.createDataFrame([("7157", "TP53")], "entrez_id string, symbol string")
    kegg = im.species_table_layer(table, "hsa", "SYMBOL", "KEGG")
    assert pairs(im.convert_layers(ids_frame(spark, "TP53", "X"), [("t", kegg)])) == [("TP53", "hsa:7157"), ("X", "X")]


def test_policies(spark):
    rows = spark.createDataFrame([("a", x) for x in ("TP53", "TP53", "EGFR", "NOPE")] + [("b", "7157")], "contrast string, id string")
    conv = spark.createDataFrame([("TP53", "7157"), ("EGFR", "1956"), ("NOPE", "NOPE"), ("7157", "7157")], "id string, target string")
    def report(policy, rate):
        return {r.contrast: r for r in im.conversion_report(rows, conv, "ENTREZID", policy, rate).collect()}

    got = report("threshold", 0.7)
    assert (got["a"].total, got["a"].mapped, got["a"].unmapped, got["a"].rate, got["a"].passed) == (4, 3, 1, 0.75, True)
    assert got["b"].rate == 1.0 and got["b"].passed
    assert not report("threshold", 0.9)["a"].passed
    assert not report("strict", 0)["a"].passed and report("best-effort", 1)["a"].passed
    with pytest.raises(ValueError, match="a 3/4"):
        im.require_conversion(im.conversion_report(rows, conv, "ENTREZID", "strict"))
    im.require_conversion(im.conversion_report(rows, conv, "ENTREZID", "best-effort"))


def test_apply_first_source_wins(spark):
    de = spark.createDataFrame(
        [("c", 2, "a1", 5.0, "Up", False), ("c", 1, "a2", -7.0, "Down", True), ("c", 3, "b", 1.0, "Up", True), ("e", 1, "a1", 9.0, "Up", True)],
        "contrast string, row_no int, gene_id string, value double, direction string, is_sig boolean",
    )
    conv = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b", "B"), ("b", " ")], "id string, target string")
    got = sorted((r.contrast, r.gene_id, r.value, r.direction, r.is_sig) for r in im.apply_conversion(de, conv).collect())
    assert got == [("c", "A", -7.0, "Down", True), ("c", "B", 1.0, "Up", True), ("e", "A", 9.0, "Up", True)]
    report = spark.createDataFrame([("c", True), ("e", False)], "contrast string, passed boolean")
    kept = im.apply_conversion(de, conv, report)
    assert ("e", "a1") in {(r.contrast, r.gene_id) for r in kept.collect()}
    typed = spark.createDataFrame(
        [("c", True, "ENTREZID", "SYMBOL"), ("e", True, "SYMBOL", "SYMBOL")],
        "contrast string, passed boolean, input_type string, target_type string",
    )
    assert {(r.contrast, r.gene_id) for r in im.apply_conversion(de, conv, typed).collect()} == {("c", "A"), ("c", "B"), ("e", "a1")}
    hits = im.apply_conversion(de, conv, hits_only=True)
    assert hits.where("contrast = 'c' and gene_id = 'A'").first().value == -7.0


def test_display_and_placeholders(spark):
    df = spark.createDataFrame([("s", ["3", "1", "2"])], "term_id string, genes array<string>")
    a = spark.createDataFrame([("1", "ONE")], "id string, shown string")
    b = spark.createDataFrame([("1", "no"), ("3", "THREE")], "id string, shown string")
    assert im.display_genes(df, ["term_id"], "genes", a, b).first().genes == ["THREE", "ONE", "2"]
    names = spark.createDataFrame([("", "x"), ("-", "x"), ("PATH:X", "x"), ("fine", "x")], "name string, id string")
    assert [r[0] for r in names.select(ids.is_placeholder("name", "id")).collect()] == [True, True, True, False]


def test_small_expressions(spark):
    df = spark.createDataFrame([("NM_1.2", "3/40", "1e-3"), (".x", "x/1", "NA"), ("-", None, " ")], "a string, r string, n string")
    got = df.select(
        ids.strip_version("a").alias("a"), ids.ratio_part("r", 0).alias("k"), ids.ratio_part("r", 1).alias("n"), ids.parse_double("n").alias("v"),
        ids.ratio_text(F.lit(3), F.lit(4)).alias("t"),
    ).collect()
    assert [tuple(r) for r in got] == [("NM_1", 3, 40, 0.001, "3/4"), (".x", None, 1, None, "3/4"), (None, None, None, None, "3/4")]


def test_rates(spark):
    rows = spark.createDataFrame([("c", "tp53", True), ("c", "TP53 ", False), ("c", "x", False), ("c", "", True)], "contrast string, gene_id string, is_sig boolean")
    known = spark.createDataFrame([("TP53",)], "from_id string")
    r = im.distinct_rates(rows, known, 0.5).first()
    assert (r.all_total, r.all_mapped, r.sig_total, r.sig_mapped, r.passed) == (3, 2, 1, 1, True)
