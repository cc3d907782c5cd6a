import pytest
from pyspark.sql import functions as F

from setspan.operators import concordance as cc
from setspan.streaming.ora_stream import DE_SCHEMA, ora_incremental, ora_incremental_parts, read_incremental

SCHEMA = "analysis string, db string, id string, pvalue double, padj double, qvalue double, nes double"


def result(spark, rows):
    return spark.createDataFrame([("gsea", "kegg", *r) for r in rows], SCHEMA)


def test_concordance_metrics(spark):
    a = result(spark, [("path:x", 0.001, 0.01, 0.01, 2.0), ("y", 0.02, 0.04, None, -1.0), ("z", 0.5, 0.6, 0.6, 0.5)])
    b = result(spark, [("x", 0.001, 0.02, 0.02, 1.5), ("y", 0.02, 0.2, None, -1.25), ("w", 0.5, 0.01, 0.01, 0.5)])
    m = cc.concordance(a, b, ranked=True).first()
    assert (m.a_rows, m.b_rows, m.shared_rows) == (3, 3, 2)
    assert m.sig_jaccard == pytest.approx(1 / 3)
    assert m.top10_overlap == pytest.approx(2 / 3)
    assert m.padj_rel_err_median == pytest.approx((0.5 + 0.8) / 2)
    assert m.nes_abs_err_median == pytest.approx(0.375)
    same = cc.concordance(a, a, ranked=True).first()
    assert (same.sig_jaccard, same.top20_overlap, same.nes_abs_err_median) == (1.0, 1.0, 0.0)


def test_split_median(spark):
    df = spark.createDataFrame([("g", str(i), float(i * i % 101)) for i in range(500)] + [("h", "1", 4.0), ("h", "2", None)], "g string, id string, v double")
    plain = {r.g: r.m for r in cc.exact_median(df, ["g"], "v", "m", False).collect()}
    cut = {r.g: r.m for r in cc.exact_median(df, ["g"], "v", "m", True).collect()}
    assert plain == cut and plain["h"] == 4.0


def test_gate(spark):
    metrics = spark.createDataFrame(
        [("gsea", "kegg", 5, 5, 5, 0.9, 0.5, 0.01), ("gsea", "go", 5, 5, 5, 0.9, 0.9, 0.5)],
        "analysis string, db string, a_rows long, b_rows long, shared_rows long, sig_jaccard double, top20_overlap double, nes_abs_err_median double",
    )
    got = {(r.analysis, r.db, r.metric): r.status for r in cc.gate(metrics, cc.limits()).collect()}
    assert got["gsea", "kegg", "top20_overlap"] == "warn" and got["gsea", "kegg", "nes_abs_err_median"] == "pass"
    assert got["gsea", "go", "nes_abs_err_median"] == "fail" and got["ora", "kegg", "a_rows"] == "fail"
    assert ("gsea", "reactome", "sig_jaccard") not in got
    hard = cc.gate(metrics, cc.limits(), enforce_l2=True)
    assert hard.where("status = 'warn'").count() == 0
    v = cc.gate_verdict(cc.gate(metrics.where("db = 'kegg'"), cc.limits(required=[]))).first()
    assert v.ok and v.warnings == 1


def test_diagnosis_reasons(spark):
    a = result(spark, [("s", 0.01, 0.01, 0.01, 1.0), ("only_a", 0.01, 0.01, 0.01, 1.0)])
    b = result(spark, [(i, 0.01, 0.01, 0.01, 1.0) for i in ("s", "small", "cut", "sorted", "gone", "big")])
    loose = result(spark, [("cut", 0.5, 0.6, 0.6, 1.0), ("sorted", 0.01, 0.01, 0.01, 1.0)])
    sizes = [("s", 20), ("small", 3), ("cut", 20), ("sorted", 20), ("gone", 20), ("only_a", 20), ("big", 900)]
    counts = spark.createDataFrame([("gsea", "kegg", i, 1000, n) for i, n in sizes], "analysis string, db string, id string, set_size long, overlap_size long")
    details = cc.diagnose_gsea(a, b, counts, loose)
    assert {r.id: r.reason for r in details.collect()} == {
        "s": "shared", "small": "filtered_by_minGSSize", "big": "filtered_by_maxGSSize", "cut": "filtered_by_go_padj_cutoff",
        "sorted": "go_unfiltered_present_but_filtered_or_sorted_out", "gone": "missing_in_go_unfiltered",
        "only_a": "r_not_significant_or_ranking_diff",
    }
    assert cc.diagnose_gsea(a, b, counts).where("reason = 'missing_in_go_unfiltered'").count() == 3
    assert cc.reason_counts(details).agg(F.sum("sets")).first()[0] == 7


def test_batch_summary(spark):
    rows = "contrast string, status string"
    smoke = spark.createDataFrame([("a", "pass"), ("b", "fail"), ("c", "warn")], rows)
    formal = spark.createDataFrame([("a", "pass"), ("b", "pass"), ("c", "fail")], rows)
    got = {r.contrast: (r.smoke_ok, r.formal_ok, r.formal_error) for r in cc.batch_summary(smoke, formal).collect()}
    assert got == {"a": (True, True, ""), "b": (False, False, "skipped: smoke gate failed"), "c": (True, False, "1 limits failed")}


def test_standardize(spark):
    df = spark.createDataFrame([("x", "", "d"), ("y", "n", None), ("z", None, "")], "id string, name string, description string")
    got = {r.id: (r.name, r.description, r.pvalue) for r in cc.standardize_results(df, []).collect()}
    assert got == {"x": ("d", "d", None), "y": ("n", "n", None), "z": ("z", "z", None)}


def land(spark, folder, contrast, genes, name=None):
    rows = [(contrast, g, v, "Up" if v > 0 else "Down", abs(v) > 1) for g, v in genes]
    spark.createDataFrame(rows, DE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_contrasts(spark, tmp_path):
    sets = spark.createDataFrame([("k", "s", f"g{i}") for i in range(5)], "collection string, term_id string, gene_id string")
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    genes = [(f"g{i}", float(3 - i)) for i in range(8)]

    def run():
        q = ora_incremental(spark, folder, sets, out, state, min_size=1, q_cutoff=None)
        q.awaitTermination()
        return {r.contrast: r.overlap for r in spark.read.parquet(out).where("direction = 'Up'").select(F.col("contrast").cast("string").alias("contrast"), "overlap").collect()}

    land(spark, folder, "c1", genes)
    assert run() == {"c1": 2}
    land(spark, folder, "c2", genes[:2])
    assert run() == {"c1": 2, "c2": 2}
    assert run() == {"c1": 2, "c2": 2}
    land(spark, folder, "c1", genes)
    with pytest.raises(Exception, match="already tested"):
        run()


def test_incremental_rejects_split_contrast(spark, tmp_path):
    sets = spark.createDataFrame([("k", "s", "g0")], "collection string, term_id string, gene_id string")
    folder = str(tmp_path / "in")
    land(spark, folder, "c1", [("g0", 3.0)])
    land(spark, folder, "c1", [("g1", 3.0)])
    with pytest.raises(Exception, match="several files"):
        ora_incremental(spark, folder, sets, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()


def test_incremental_ledger(spark, tmp_path):
    """A contrast without results is known, and an id like 01 stays text."""
    sets = spark.createDataFrame([("k", "s", "g0")], "collection string, term_id string, gene_id string")
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        ora_incremental(spark, folder, sets, out, state, min_size=1, q_cutoff=None).awaitTermination()

    land(spark, folder, "none", [("x1", 3.0), ("x2", 0.5)])
    land(spark, folder, "01", [("g0", 3.0), ("x1", 0.5)])
    run()
    assert {r.contrast for r in read_incremental(spark, out).collect()} == {"01"}
    for again in ("none", "01"):
        land(spark, folder, again, [("g0", 3.0)])
        with pytest.raises(Exception, match="already tested"):
            run()


def test_contrast_in_parts(spark, tmp_path):
    """A contrast waits for its last file and its manifest row, in either order, and then equals the whole."""
    sets = spark.createDataFrame([("k", "s", f"g{i}") for i in range(5)], "collection string, term_id string, gene_id string")
    folder, stated, out, state = (str(tmp_path / x) for x in ("in", "manifest", "out", "state"))
    genes = [(f"g{i}", float(3 - i)) for i in range(8)]

    def manifest(*rows):
        spark.createDataFrame(rows, "contrast string, n_files long").coalesce(1).write.mode("append").parquet(stated)

    def run():
        ora_incremental_parts(
            spark, folder, stated, sets, out, state, min_size=1, q_cutoff=None
        ).awaitTermination()
        try:
            rows = read_incremental(spark, out).where("direction = 'Up'").collect()
        except Exception:  # noqa: BLE001 - nothing tested yet
            return {}
        return {r.contrast: (r.overlap, r.n_universe) for r in rows}

    land(spark, folder, "c1", genes[:1])
    land(spark, folder, "c2", genes[:4])
    manifest(("c1", 2))
    assert run() == {}
    land(spark, folder, "c2", genes[4:])
    land(spark, folder, "c1", genes[1:])
    assert run() == {"c1": (2, 8)}
    manifest(("c2", 2))
    assert run() == {"c1": (2, 8), "c2": (2, 8)} and run() == {"c1": (2, 8), "c2": (2, 8)}
    land(spark, folder, "c1", genes[:1])
    with pytest.raises(Exception, match="already tested"):
        run()


@pytest.mark.parametrize("sizes, why", [([1], "more files"), ([2, 3], "different manifest")])
def test_parts_refused(spark, tmp_path, sizes, why):
    sets = spark.createDataFrame([("k", "s", "g0")], "collection string, term_id string, gene_id string")
    folder, stated = str(tmp_path / "in"), str(tmp_path / "manifest")
    for gene in ("g0", "g1"):
        land(spark, folder, "c1", [(gene, 3.0)])
    spark.createDataFrame([("c1", n) for n in sizes], "contrast string, n_files long").write.parquet(stated)
    with pytest.raises(Exception, match=why):
        ora_incremental_parts(
            spark, folder, stated, sets, str(tmp_path / "o"), str(tmp_path / "s")
        ).awaitTermination()
