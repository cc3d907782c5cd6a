import pytest
from pyspark.sql import functions as F

from setspan.catalog.store import CONTRACTS, Catalog, CatalogConflict, CollectionKey
from setspan.operators import quality as q
from setspan.operators.ora import ora_sized, overlap_counts
from setspan.sinks import files
from setspan.sources.sets import read_gmt
from setspan.sources.tables import read_ranked, read_results


def term_frames(spark, terms, genes):
    return (
        spark.createDataFrame(terms, "term_id string, name string, description string"),
        spark.createDataFrame(genes, "term_id string, gene_id string"),
    )


KEGG = CollectionKey("KEGG", "HSA")


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def fill(spark, catalog):
    catalog.replace_sets(KEGG, *term_frames(spark, [("p1", "one", " "), ("p2", "", "d"), (" ", "x", "y")],
                                            [("p1", "1"), ("p1", " 2 "), ("p1", "2"), ("p2", "3"), ("p2", ""), ("zz", "9")]), "ENTREZID", "v1")


def members(df):
    return sorted((r.term_id, r.name, r.gene_id or "") for r in df.collect())


def test_round_trip_and_replace(spark, catalog):
    fill(spark, catalog)
    assert KEGG.values() == {"db": "kegg", "species": "hsa", "ontology": "-", "collection": "-"}
    assert members(catalog.load(KEGG)) == [("p1", "one", "1"), ("p1", "one", "2"), ("p2", "p2", "3")]
    assert catalog.table("term").where("term_id = 'p1'").first().description == "-"
    assert catalog.table("dataset").first().gene_id_type == "ENTREZID"
    other = CollectionKey("go", "hsa", "bp")
    catalog.replace_sets(other, *term_frames(spark, [("g", "n", "d"), ("e", "empty", "d")], [("g", "TP53")]), "SYMBOL", "v1")
    # replacing a collection from its own rows leaves the other one alone
    own = catalog.load(KEGG).where("term_id = 'p1'")
    catalog.replace_sets(KEGG, own.select("term_id", "name", "description"), own.select("term_id", "gene_id"), "ENTREZID", "v2")
    assert members(catalog.load(KEGG)) == [("p1", "one", "1"), ("p1", "one", "2")]
    assert members(catalog.load(other)) == [("e", "empty", ""), ("g", "n", "TP53")]
    catalog.replace_sets(KEGG, *term_frames(spark, [], []), "ENTREZID", "v3")
    assert catalog.load(KEGG).count() == 0 and catalog.load(other).count() == 2


def test_readers_and_writers_at_once(spark, catalog):
    fill(spark, catalog)
    before, seen = catalog.load(KEGG), catalog.head("dataset", KEGG.values())
    assert seen == 1
    new = term_frames(spark, [("p9", "nine", "d")], [("p9", "9")])
    catalog.replace_sets(KEGG, *new, "ENTREZID", "v2", after=seen)
    # The second writer of the same state loses and leaves nothing behind.
    with pytest.raises(CatalogConflict):
        catalog.replace_sets(KEGG, *term_frames(spark, [("x", "x", "x")], [("x", "1")]), "ENTREZID", "v3", after=seen)
    assert members(before) == [("p1", "one", "1"), ("p1", "one", "2"), ("p2", "p2", "3")]
    assert members(catalog.load(KEGG)) == [("p9", "nine", "9")]
    assert len(catalog._list(f"{catalog.path('term')}/*/*/*/*/*")) == 2
    # An orphan of a crashed writer, and an entry whose file was made but never written.
    catalog._write("term", new[0].where("true"), KEGG.values(), "orphan")
    files, at = catalog._at(f"{catalog._log('dataset', KEGG.values())}/{3:012d}.json")
    files.create(at, False).close()
    assert members(catalog.load(KEGG)) == [("p9", "nine", "9")] and catalog.table("term").count() == 1
    assert catalog.vacuum(3600) == [] and before.count() == 3
    assert len(catalog.vacuum(0)) == 3  # two folders of the first version and the orphan
    assert members(catalog.load(KEGG)) == [("p9", "nine", "9")]
    catalog.replace_sets(KEGG, *new, "ENTREZID", "v4")
    assert catalog.head("dataset", KEGG.values()) == 4 and catalog.table("dataset").first().version == "v4"


def test_sets_laid_out_by_gene_are_not_shuffled(spark, catalog):
    """Between the scan of the stored sets and the join with hits there is no exchange."""
    fill(spark, catalog)
    other = CollectionKey("go", "hsa", "bp")
    catalog.replace_sets(other, *term_frames(spark, [("g", "n", "d")], [("g", "1"), ("g", "7")]), "SYMBOL", "v1")
    catalog.store_by_gene("all", [KEGG, other], 4)
    stored, facts = catalog.by_gene("all")
    rows = sorted(map(tuple, stored.select("collection", "term_id", "gene_id", "set_size").collect()))
    assert rows == [("go/hsa/BP/-", "g", "1", 2), ("go/hsa/BP/-", "g", "7", 2), ("kegg/hsa/-/-", "p1", "1", 2),
                    ("kegg/hsa/-/-", "p1", "2", 2), ("kegg/hsa/-/-", "p2", "3", 1)]
    assert facts == {"buckets": 4, "most_of_a_gene": 2, "largest_set": 2}
    hits = spark.createDataFrame([("c", "Up", g) for g in "127"], "contrast string, direction string, gene_id string")
    universe = spark.createDataFrame([("c", 50)], "contrast string, n_universe long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = overlap_counts(hits.repartition(facts["buckets"], "gene_id"), stored.where("set_size < 9"), hubs=False)
        plan = joined._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        scan = next(i for i, line in enumerate(plan) if "Scan parquet" in line and "by_gene" in line)
        above, at = [], depth(plan[scan])
        for line in reversed(plan[:scan]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        join = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:join]), "\n".join(plan)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = ora_sized(hits, stored, universe, False, q_cutoff=None)
    assert {(r.term_id, r.overlap, r.set_size) for r in got.collect()} == {("g", 2, 2), ("p1", 2, 2)}
    # Another session does not know the table, only its files.
    spark.sql(f"DROP TABLE {catalog._by_gene_table(catalog.current('by_gene').first().data_version)}")
    assert catalog.by_gene("all")[0].count() == 5
    catalog.store_by_gene("all", [other], 2)
    assert catalog.by_gene("all")[0].count() == 2
    with pytest.raises(KeyError):
        catalog.by_gene("none")


def map_frame(spark, *rows):
    return spark.createDataFrame(list(rows), "from_id string, to_id string")


def test_idmap_scopes(spark, catalog):
    assert not catalog.has_rows("hsa", "s", "SYMBOL")
    catalog.replace_idmap("hsa", "s", "SYMBOL", "ENTREZID", map_frame(spark, ("A", "1"), ("A", "2"), ("A", "2"), ("B", "3"), ("", "4"), ("5", "5")))
    catalog.replace_idmap("hsa", "t", "ENTREZID", "SYMBOL", map_frame(spark, ("7", "C")))
    got = sorted((r.source, r.from_type, r.from_id, r.entrez_id) for r in catalog.table("idmap").collect())
    assert got == [("s", "SYMBOL", "A", "1"), ("s", "SYMBOL", "A", "2"), ("s", "SYMBOL", "B", "3"), ("t", "SYMBOL", "C", "7")]
    assert catalog.has_rows("hsa", "s", "SYMBOL") and not catalog.has_rows("mmu", "s", "SYMBOL")
    ran = []

    def producer():
        ran.append(1)
        return map_frame(spark, ("Z", "9"))

    assert not catalog.sync_idmap("hsa", "s", "SYMBOL", "ENTREZID", producer) and not ran
    assert catalog.sync_idmap("hsa", "s", "SYMBOL", "ENTREZID", producer, force=True)
    assert catalog.table("idmap").where("source = 's'").count() == 1


def test_failed_producer_keeps_scope(spark, catalog):
    catalog.replace_idmap("hsa", "s", "SYMBOL", "ENTREZID", map_frame(spark, ("A", "1")))
    broken = map_frame(spark, ("A", "1"), ("B", "x")).withColumn("to_id", F.when(F.col("to_id") == "x", F.raise_error(F.lit("bad row")).cast("string")).otherwise(F.col("to_id")))
    with pytest.raises(Exception, match="bad row"):
        catalog.replace_idmap("hsa", "s", "SYMBOL", "ENTREZID", broken)
    assert catalog.table("idmap").count() == 1


def test_contract_and_profiles(spark, catalog):
    empty = q.row_counts(catalog.tables(), {"geneset": "term", "geneset_gene": "term_gene"})
    no_maps = catalog.table("idmap").groupBy("species", "from_type").agg(F.count(F.lit(1)).alias("row_count"))
    assert q.check_profile(spark, "embedded-hsa-seed", empty, no_maps).count() == 0
    assert q.check_profile(spark, "embedded-hsa-basic", empty, no_maps).where("passed").count() == 0
    with pytest.raises(ValueError):
        q.check_profile(spark, "other", empty, no_maps)
    fill(spark, catalog)
    catalog.replace_idmap("hsa", "s", "SYMBOL", "ENTREZID", map_frame(spark, ("A", "1")))
    counts = q.row_counts(catalog.tables(), {"geneset": "term", "geneset_gene": "term_gene"})
    assert {r.table_name: r.row_count for r in counts.collect()}["geneset_gene"] == 3
    maps = catalog.table("idmap").groupBy("species", "from_type").agg(F.count(F.lit(1)).alias("row_count"))
    assert q.check_profile(spark, "embedded-hsa-basic", counts, maps).where("not passed").count() == 0
    checks = q.check_contract(spark, catalog.tables(), CONTRACTS)
    assert q.verdict(checks).first().healthy
    bad = dict(catalog.tables())
    bad["term"] = bad["term"].drop("name").withColumn("description", F.lit(None).cast("string"))
    bad["term_gene"] = bad["term_gene"].unionByName(bad["term_gene"].withColumn("term_id", F.lit("orphan")))
    bad["dataset"] = bad["dataset"].unionByName(bad["dataset"]).withColumn("version", F.lit(1))
    del bad["idmap"]
    failed = {(r.table_name, r.check_name, r.target) for r in q.check_contract(spark, bad, CONTRACTS).where("not passed").collect()}
    assert {("term", "type", "name"), ("term", "not_null", "description"), ("dataset", "type", "version"), ("idmap", "table", "idmap")} <= failed
    assert any(c == "primary_key" and t == "dataset" for t, c, _ in failed)
    assert any(c == "foreign_key" and t == "term_gene" for t, c, _ in failed)


def lines(spark, path, keep_order=False):
    got = [r.value for r in spark.read.text(path).collect()]
    return got if keep_order else sorted(got)


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("Down", "s2", 1, 5, 10, 100, 0.5, 0.5, 0.5, ["b"]), ("Up", "s1", 2, 5, 10, 100, 0.000123, 0.00123, 0.00123, ["a", "b"])],
        "direction string, term_id string, overlap long, n_hits long, set_size long, n_universe long, pvalue double, padj double, qvalue double, genes array<string>",
    )
    files.write_ora(df, str(tmp_path / "o"))
    text = lines(spark, str(tmp_path / "o"))
    assert "Up\ts1\t\t2/5\t10/100\t1.23e-04\t1.23e-03\t1.23e-03\ta/b\t2\t" in text
    assert "Direction\tID\tName\tGeneRatio\tBgRatio\tPValue\tPAdjust\tQValue\tGenes\tCount\tDescription" in text
    files.write_ora(df, str(tmp_path / "j"), "json")
    assert {r.ID: r.Genes for r in spark.read.json(str(tmp_path / "j")).collect()} == {"s1": ["a", "b"], "s2": ["b"]}
    with pytest.raises(ValueError):
        files.write_ora(df, str(tmp_path / "x"), "xls")
    g = spark.createDataFrame([("s1", "n", -1.23456, 0.01, 0.02, 0.02, -0.5, ["x", "y"], "d")], "term_id string, name string, nes double, pvalue double, padj double, qvalue double, es double, lead_genes array<string>, description string")
    files.write_gsea(g, str(tmp_path / "g"), "csv")
    assert "s1,n,-1.2346,1.00e-02,2.00e-02,2.00e-02,-0.5000,x/y,d" in lines(spark, str(tmp_path / "g"))


def test_ranked_gmt_and_map_files(spark, tmp_path):
    ranked = spark.createDataFrame([("c", "a", 2.5, 1), ("c", "b", 30.0, 2), ("c", "d", -1e-7, 3), ("c", "e", 1 / 3, 4)], "contrast string, gene_id string, value double, rank int")
    files.write_ranked(ranked, str(tmp_path / "r"))
    assert set(lines(spark, str(tmp_path / "r"))) == {"gene\trank", "a\t2.5", "b\t30", "d\t-1e-07", "e\t0.333333333333333"}
    term = spark.createDataFrame([("k", "s1", "one"), ("k", "s2", "two")], "collection string, term_id string, name string")
    genes = spark.createDataFrame([("k", "s1", "b"), ("k", "s1", "a"), ("k", "s1", "a")], "collection string, term_id string, gene_id string")
    files.write_gmt(term, genes, str(tmp_path / "m"))
    assert lines(spark, str(tmp_path / "m")) == ["s1\tone\ta\tb", "s2\ttwo\t"]
    files.write_gmt(term, genes, str(tmp_path / "m2"), keep_empty=False)
    assert lines(spark, str(tmp_path / "m2")) == ["s1\tone\ta\tb"]
    pairs = spark.createDataFrame([("10", "B"), ("1", "A"), ("1", "A")], "entrez_id string, symbol string")
    files.write_idmap_tsv(pairs, str(tmp_path / "i"))
    assert lines(spark, str(tmp_path / "i"), True) == ["1\tA", "10\tB"]


def test_long_sets_take_several_lines(spark, tmp_path):
    term = spark.createDataFrame([("k", "s1", "one"), ("l", "s1", "other")], "collection string, term_id string, name string")
    genes = spark.createDataFrame(
        [("k", "s1", f"g{i}") for i in range(40)] + [("l", "s1", "h")], "collection string, term_id string, gene_id string"
    )
    files.write_gmt(term, genes, str(tmp_path / "m"), line_genes=10)
    text = [r for r in lines(spark, str(tmp_path / "m/collection=k")) if r]
    assert len(text) > 1 and all(r.startswith("s1\tone\t") for r in text)
    _, back = read_gmt(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, genes.collect()))


def test_result_files_keep_their_keys(spark, tmp_path):
    rows = [(c, k, "Up", "s1", 1, 5, 10, 100, 0.5, 0.5, 0.5, ["b"]) for c in ("01", "x/y") for k in ("go", "kegg")]
    df = spark.createDataFrame(
        rows,
        "contrast string, collection string, direction string, term_id string, overlap long, n_hits long, set_size long, n_universe long, pvalue double, padj double, qvalue double, genes array<string>",
    )
    files.write_ora(df, str(tmp_path / "o"))
    got = read_results(spark, str(tmp_path / "o")).select("contrast", "collection", "id").collect()
    assert {tuple(r) for r in got} == {(r[0], r[1], "s1") for r in rows}
    ranked = spark.createDataFrame([("01", "a", 2.5, 1), ("x/y", "a", 1.5, 1)], "contrast string, gene_id string, value double, rank int")
    files.write_ranked(ranked, str(tmp_path / "r"))
    back = read_ranked(spark, str(tmp_path / "r")).select("contrast", "gene_id", "value")
    assert {tuple(r) for r in back.collect()} == {("01", "a", 2.5), ("x/y", "a", 1.5)}


def test_failed_replacement_changes_nothing(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path / "c"))
    key = CollectionKey("kegg", "hsa")
    term = "term_id string, name string, description string"
    first = spark.createDataFrame([("p1", "one", "d")], term), spark.createDataFrame([("p1", "1")], "term_id string, gene_id string")
    second = spark.createDataFrame([("p2", "two", "d")], term), spark.createDataFrame([("p2", "2")], "term_id string, gene_id string")
    catalog.replace_sets(key, *first, "ENTREZID", "v1")

    def fails(self, *args, **fields):
        raise RuntimeError("lost")

    monkeypatch.setattr(Catalog, "_commit", fails)
    with pytest.raises(RuntimeError):
        catalog.replace_sets(key, *second, "ENTREZID", "v2")
    monkeypatch.undo()
    assert [(r.term_id, r.gene_id) for r in catalog.load(key).collect()] == [("p1", "1")]
    assert catalog.table("term_gene").count() == 1
    catalog.replace_sets(key, *second, "ENTREZID", "v2")
    assert [(r.term_id, r.gene_id) for r in catalog.load(key).collect()] == [("p2", "2")]


def test_contract_reads_each_table_once(spark, catalog):
    fill(spark, catalog)
    catalog.replace_idmap("hsa", "s", "SYMBOL", "ENTREZID", map_frame(spark, ("A", "1")))
    rows = {
        "child": [(1, 10), (1, 11), (2, None), (None, 99), (None, 99)],
        "parent": [(10,), (11,), (11,), (None,)],
    }
    tables = {
        "child": spark.createDataFrame(rows["child"], "id int, up int"),
        "parent": spark.createDataFrame(rows["parent"], "no long"),
    }
    contracts = {
        "child": q.TableContract({"id": "int"}, ["id", "up"], ["id"], [(["up"], "parent", ["no"])]),
        "parent": q.TableContract({"no": "bigint"}, [], ["no"]),
    }
    checks = q.check_contract(spark, tables, contracts)
    got = {(r.table_name, r.check_name, r.target): r.actual for r in checks.collect() if r.check_name not in ("table", "type")}
    assert got == {
        ("child", "not_null", "id"): "2", ("child", "not_null", "up"): "1", ("child", "primary_key", "id"): "2",
        # The null and the two of 99.
        ("child", "foreign_key", "up"): "3", ("parent", "primary_key", "no"): "1",
    }
    audit = q.check_contract(spark, catalog.tables(), CONTRACTS)
    plan = audit._jdf.queryExecution().sparkPlan().toString()
    # term, term_gene and idmap; what the log of versions says is JSON.
    assert plan.count("FileScan parquet") == 3, plan


def test_counts_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 5), (None, 7)], "s string, v int")
    out = str(tmp_path / "w")
    counts = q.write_observed(rows, F.col("v") > 4, lambda kept: kept.write.parquet(out), {"a": F.col("s") == "a", "b": F.col("s") == "b"})
    assert {tuple(r) for r in counts.collect()} == {("*", 4, 2, 2), ("a", 2, 2, 0), ("b", 1, 0, 1)}
    assert sorted(map(str, spark.read.parquet(out).collect())) == ["Row(s='a', v=1)", "Row(s='a', v=None)"]
