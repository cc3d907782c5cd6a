import gzip

import pytest

from setspan.operators.gene_sets import (
    filter_ontology,
    fill_names,
    invert_annotations,
    merge_collections,
    select_collections,
)
from setspan.operators.quality import ingest_stats
from setspan.sources import idmaps, sets, tables


def put(folder, name, text):
    path = folder / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_gmt(spark, tmp_path):
    text = "S1\tNA\tA\tB\tA\t\nshort\tx\nS2\tabout two\t C \n"
    for name in ("c1.gmt", "c1.gmt.gz"):
        term, genes = sets.read_gmt(spark, put(tmp_path, name, text))
        assert rows(term, "collection", "term_id", "name", "description") == [("c1", "S1", "S1", ""), ("c1", "S2", "S2", "about two")]
        assert rows(genes, "term_id", "gene_id") == [("S1", "A"), ("S1", "B"), ("S2", " C ")]
    shown = sets.with_display_names(term)
    assert rows(shown, "term_id", "name") == [("S1", "S1"), ("S2", "about two")]


def test_gmt_names_and_placeholder(spark, tmp_path):
    kegg = "hsa00010\tGlycolysis / Gluconeogenesis\t1\t2\npath:hsa04390\t\t7481\n"
    term, _ = sets.read_gmt(spark, put(tmp_path, "hsa.gmt", kegg), "kegg")
    shown = sets.with_display_names(term)
    assert rows(shown, "term_id", "name") == [("hsa00010", "Glycolysis / Gluconeogenesis"), ("path:hsa04390", "path:hsa04390")]
    names = spark.createDataFrame([("hsa04390", "Hippo signaling"), ("hsa00010", "other")], "set_id string, set_name string")
    filled = fill_names(shown, names)
    assert ("path:hsa04390", "Hippo signaling", "Hippo signaling") in rows(filled, "term_id", "name", "description")
    assert ("hsa00010", "Glycolysis / Gluconeogenesis") in rows(filled, "term_id", "name")


def test_merge_two_collections(spark, tmp_path):
    put(tmp_path, "c1.gmt", "SET_X\tNA\tA\n")
    put(tmp_path, "c2.gmt", "SET_X\tNA\tB\nSET_Y\tNA\tC\n")
    _, genes = sets.read_gmt(spark, str(tmp_path))
    merged = merge_collections(genes, ["c1", "c2"])
    assert rows(merged, "collection", "term_id", "gene_id") == [("c1", "SET_X", "A"), ("c2", "SET_Y", "C")]


def test_collection_requests():
    assert select_collections("") == select_collections("c1-c8") == [f"c{i}" for i in range(1, 9)]
    assert select_collections("ALL")[0] == "h" and len(select_collections("all")) == 9
    assert select_collections("c2, h,c2") == ["c2", "h"]
    with pytest.raises(ValueError):
        select_collections("c9")


def test_reactome_gmt(spark, tmp_path):
    text = "Apoptosis\tR-HSA-12345\tTP53\tCASP3\nOther\tR-MMU-1\tX\n"
    path = put(tmp_path, "r.gmt", text)
    term, genes = sets.read_reactome_gmt(spark, path, "hsa")
    assert rows(term, "term_id", "name") == [("R-HSA-12345", "Apoptosis")]
    assert rows(genes, "gene_id") == [("CASP3",), ("TP53",)]
    assert sets.read_reactome_gmt(spark, path, "zzz")[0].count() == 2


def test_link_pairs(spark, tmp_path):
    df = sets.read_link_pairs(spark, put(tmp_path, "l.txt", "pathway:hsa00010 hsa:10327\npath:hsa1\thsa:2\nbad\n"))
    assert rows(df, "term_id", "gene_id") == [("hsa00010", "10327"), ("hsa1", "2")]


def test_gaf(spark, tmp_path):
    text = "!note\nUniProtKB\tP04637\tTP53\t\tGO:0003677\nUniProtKB\tP1\t\tenables\tGO:1\nU\tP2\tX\tNOT|enables\tGO:2\nshort\tx\n"
    df = sets.read_gaf(spark, put(tmp_path, "a.gaf.gz", text))
    assert rows(df, "gene_id", "term_id") == [("P1", "GO:1"), ("TP53", "GO:0003677")]
    terms = spark.createDataFrame([("GO:1", "biological_process"), ("GO:0003677", "molecular_function")], "term_id string, namespace string")
    assert rows(filter_ontology(df, terms, "MF"), "gene_id") == [("TP53",)]
    assert rows(invert_annotations(df, "go"), "collection", "term_id") == [("go", "GO:0003677"), ("go", "GO:1")]


def test_obo(spark, tmp_path):
    text = (
        "format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: biological_process\n"
        'def: "text" [x]\nis_a: GO:2 ! two\nis_a: GO:3 ! three\n\n[Term]\nid: GO:2\nname: two\n'
        "namespace: molecular_function\n\n[Typedef]\nid: part_of\nname: part of\nis_a: GO:9 ! nine\n"
    )
    got = {r.term_id: r for r in sets.read_obo(spark, put(tmp_path, "g.obo", text)).collect()}
    assert set(got) == {"GO:1", "GO:2"}
    assert got["GO:1"].parents == ["GO:2", "GO:3"] and got["GO:1"].namespace == "biological_process"
    assert got["GO:2"].parents == [] and got["GO:2"].name == "two"


GENE_INFO = (
    "#tax\tid\n10090\t100009614\tKrtap12-22\t-\tA1|b2\t-\t-\t-\t-\t-\t-\tKrtauth\n"
    "10090\t2\t-\t-\t-\tx\n9606\t3\tTP53\t-\t-\tx\n10090\tshort\n"
)


def test_gene_info(spark, tmp_path):
    to_symbol, to_entrez = idmaps.read_gene_info(spark, put(tmp_path, "gi.gz", GENE_INFO), "mmu")
    assert rows(to_symbol, "from_id", "to_id") == [("100009614", "Krtap12-22")]
    assert rows(to_entrez, "from_id") == [("A1",), ("B2",), ("KRTAP12-22",), ("KRTAUTH",)]
    with pytest.raises(ValueError):
        idmaps.read_gene_info(spark, str(tmp_path), "xxx")


def test_reactome_from_entrez(spark, tmp_path):
    def line(gene, pid, name, species):
        return "\t".join([gene, "a", "b", pid, "u", name, "e", species])

    mapping = "\n".join(
        [line("100009614", "R-MMU-6805567", "Keratinization", "mus musculus"), line("x1", "R-MMU-1", "n", "Mus musculus"),
         line("100009614", "R-HSA-1", "n", "Homo sapiens"), line("77", "R-MMU-2", "n", "Mus musculus")]
    ) + "\n"
    term, genes = sets.reactome_from_entrez(
        spark, put(tmp_path, "m.txt", mapping), put(tmp_path, "gi.txt", GENE_INFO), "mmu"
    )
    assert rows(term, "term_id", "name") == [("R-MMU-6805567", "Keratinization")]
    assert rows(genes, "gene_id") == [("Krtap12-22",)]


def test_gene2ensembl_refseq_uniprot(spark, tmp_path):
    ens, back = idmaps.read_gene2ensembl(spark, put(tmp_path, "e", "9606\t7157\tENSG1\t-\tensp2\n10090\t1\tENSMUSG\n"), "hsa")
    assert rows(ens, "from_id", "to_id") == [("ENSG1", "7157"), ("ENSP2", "7157")]
    assert rows(back, "from_id", "to_id") == [("7157", "ENSG1"), ("7157", "ENSP2")]
    ref, _ = idmaps.read_gene2refseq(spark, put(tmp_path, "r", "9606\t7157\ts\tnm_1.2\tg\tNP_3.4\tg\t-\n9606\t8\ts\n"), "hsa")
    assert rows(ref, "from_id", "to_id") == [("NM_1", "7157"), ("NP_3", "7157")]
    tail = "\t".join(["x"] * 9)
    uni, _ = idmaps.read_uniprot_idmapping(
        spark, put(tmp_path, "u", f"P1\tA\t1; 2\nP2\tA\t3\t{tail}\t9606\nP3\tA\t4\t{tail}\t10090\nP4\tA\t\n"), "hsa"
    )
    assert rows(uni, "from_id", "to_id") == [("P1", "1"), ("P1", "2"), ("P2", "3")]


def test_alias_list_and_xref(spark, tmp_path):
    text = "hsa:1\tCDS\t1:2\tA1BG, A1B; alpha\nhsa:2\tCDS\t1:3\tA2M, A1B; other\nhsa:3\tCDS\tx\t; none\n"
    primary, alias = idmaps.read_gene_alias_list(spark, put(tmp_path, "k.txt", text), "hsa")
    assert rows(primary, "from_id", "to_id") == [("1", "A1BG"), ("2", "A2M")]
    assert rows(alias, "from_id", "to_id") == [("A1B", "1"), ("A1BG", "1"), ("A2M", "2")]
    x = idmaps.read_xref_pairs(spark, put(tmp_path, "x.txt", "hsa:1\tup:P1\nhsa:2\tP2\nhsa:3\t\nhsa:\tup:P4\n"), "hsa")
    assert rows(x, "entrez_id", "external_id") == [("1", "P1"), ("2", "P2")]


def test_idmap_tsv(spark, tmp_path):
    text = "# c\nhsa:1\tTP53\nncbi-geneid:2\tEgfr\n3\t \ninvalid\nhsa:1\tTP53_DUP\n"
    path = put(tmp_path, "id.tsv", text)
    forward, back = idmaps.read_idmap_tsv(spark, path, "hsa")
    assert rows(forward, "from_id", "to_id") == [("EGFR", "2"), ("TP53", "1"), ("TP53_DUP", "1")]
    assert rows(back, "from_id", "to_id") == [("1", "TP53"), ("2", "Egfr")]
    stats = ingest_stats(idmaps.idmap_tsv_rows(spark, path, "hsa"), "file_name", "dropped").first()
    assert (stats.seen, stats.dropped, stats.kept) == (5, 2, 3)
    both = idmaps.union_directions(forward, back)
    assert rows(both, "from_id", "to_id") == [("Egfr", "2"), ("TP53", "1"), ("TP53_DUP", "1")]


DE = ",logFC,FDR,significant,direction\nTHBS1, 2.5 ,0.01,TRUE,Up\nB,NA,0.2,FALSE,Down\n ,1,1,TRUE,Up\nC,-1.5,x,TRUE,Down\n"


def test_de_table(spark, tmp_path):
    path = put(tmp_path, "one.csv", DE)
    df = tables.read_de_table(spark, path, filter_col="significant", filter_value="TRUE", direction_col="direction")
    got = [(r.contrast, r.gene_id, r.value, r.direction, r.is_sig) for r in df.orderBy("row_no").collect()]
    assert got == [("one", "THBS1", 2.5, "Up", True), ("one", "B", 1.0, "Down", False), ("one", "C", -1.5, "Down", True)]
    fdr = tables.read_de_table(spark, path, value_col="logFC", filter_col="FDR", filter_mode="numeric_lte", filter_value=0.05)
    assert rows(fdr, "gene_id", "is_sig") == [("B", False), ("C", False), ("THBS1", True)]
    assert tables.read_de_table(spark, path, direction_col="nope").where("direction is not null").count() == 0
    for bad in ({"gene_col": "x"}, {"value_col": "x"}, {"filter_col": "x"}):
        with pytest.raises(ValueError):
            tables.read_de_table(spark, path, **bad)


def test_de_directory(spark, tmp_path):
    put(tmp_path, "a.csv", DE)
    put(tmp_path, "b.csv", DE)
    put(tmp_path, "c.txt", DE)
    df = tables.read_de_directory(spark, str(tmp_path))
    assert rows(df.groupBy("contrast").count(), "contrast", "count") == [("a", 3), ("b", 3)]


def test_simple_ranked_list(spark, tmp_path):
    df = tables.read_de_table_simple(spark, put(tmp_path, "s.csv", "Gene,log2FC\nA,2\nB,x\nonly\n"))
    assert rows(df, "gene_id", "value") == [("A", 2.0), ("B", 1.0)]
    kept = tables.read_de_table_simple(spark, put(tmp_path, "t.csv", "A,2\nGene,3\n"))
    assert rows(kept, "gene_id", "value") == [("A", 2.0), ("Gene", 3.0)]
    ranked = tables.read_ranked(spark, put(tmp_path, "r.tsv", "GENE1\t2.5\n1.5\tGENE2\n# c\nGENE3\n\nG4\tx\n"))
    got = [(r.gene_id, r.value) for r in ranked.orderBy("row_no").collect()]
    assert got == [("GENE1", 2.5), ("GENE2", 1.5), ("GENE3", 1.0), ("G4", 1.0)]
    listed = tables.read_gene_list(spark, put(tmp_path, "l.txt", "# comment\nGENE1\n\n GENE2 \n"))
    assert [(r.gene_id, r.value) for r in listed.orderBy("row_no").collect()] == [("GENE1", 1.0), ("GENE2", 1.0)]


def test_results_spellings(spark, tmp_path):
    df = tables.read_results(spark, put(tmp_path, "r.tsv", "ID\tpvalue\tp.adjust\tqvalue\tNES\nx\t0.1\tNA\t\t-1.5\n"))
    r = df.first()
    assert (r.id, r.pvalue, r.padj, r.qvalue, r.nes) == ("x", 0.1, None, None, -1.5)


def test_first_wins_over_many_splits(spark, tmp_path):
    text = "".join(f"hsa:{i}\tSYM{i % 50}\n" for i in range(4000))
    path = put(tmp_path, "big.tsv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        forward, _ = idmaps.read_idmap_tsv(spark, path, "hsa")
        assert rows(forward, "from_id", "to_id") == sorted((f"SYM{i}", str(i)) for i in range(50))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_each_file_has_its_own_header(spark, tmp_path):
    put(tmp_path, "a.csv", "gene,logFC,FDR\nA,2.5,0.01\n\"B, b\",-1,0.5\n")
    put(tmp_path, "b.csv", "FDR,logFC,gene\n0.01,9.5,C\n0.2,-7.0,D\n")
    df = tables.read_de_directory(
        spark, str(tmp_path), gene_col="gene", value_col="logFC", filter_col="FDR", filter_mode="numeric_lte", filter_value=0.05
    )
    got = {(r.contrast, r.gene_id, r.value, r.is_sig) for r in df.collect()}
    assert got == {("a", "A", 2.5, True), ("a", "B, b", -1.0, False), ("b", "C", 9.5, True), ("b", "D", -7.0, False)}
    put(tmp_path, "c.csv", "id,logFC,FDR\nA,1,1\n")
    with pytest.raises(ValueError, match="gene"):
        tables.read_de_directory(spark, str(tmp_path), gene_col="gene")


def test_simple_table_quotes(spark, tmp_path):
    df = tables.read_de_table_simple(spark, put(tmp_path, "q.csv", 'Gene,log2FC\n"A,B",2\nC,"3"\n'))
    assert {(r.gene_id, r.value) for r in df.collect()} == {("A,B", 2.0), ("C", 3.0)}


def test_results_of_mixed_files(spark, tmp_path):
    """Each file by its own header: other spellings, other orders, missing and repeated columns."""
    put(tmp_path, "a.tsv", "ID\tName\tPValue\tPAdjust\tQValue\nx\tn\t0.01\t0.02\t0.03\n")
    put(tmp_path, "b.tsv", "ID\tDescription\tp.adjust\tqvalue\tpvalue\ny\t\"d \\\"q\\\"\ttab\"\t0.2\t0.3\t0.1\n")
    put(tmp_path, "c.tsv", "pvalue\tmore\tPValue\tContrast\tID\n0.5\t?\t0.6\tnamed\tz\nNA\t\t1\t\tw\nshort\n")
    put(tmp_path, "d.tsv", "ID\tPValue\n")
    put(tmp_path, "e.tsv", "")
    got = {r.id: r for r in tables.read_results(spark, str(tmp_path)).collect()}
    assert (got["x"].contrast, got["x"].name, got["x"].pvalue, got["x"].padj, got["x"].qvalue) == ("a", "n", 0.01, 0.02, 0.03)
    assert (got["y"].contrast, got["y"].description, got["y"].pvalue, got["y"].padj, got["y"].qvalue) == ("b", 'd "q"\ttab', 0.1, 0.2, 0.3)
    assert (got["z"].contrast, got["z"].pvalue, got["z"].padj) == ("named", 0.5, None)
    assert (got["w"].contrast, got["w"].pvalue) == (None, None) and got[None].pvalue is None
    assert len(got) == 5


def test_own_ranked_header_is_no_gene(spark, tmp_path):
    put(tmp_path, "a.tsv", "# made by us\n\ngene\trank\ngene\t3\nB\t2\n")
    put(tmp_path, "b.tsv", "gene\t1\ngene\trank\n")
    got = tables.read_ranked(spark, str(tmp_path)).collect()
    assert {(r.contrast, r.gene_id, r.value) for r in got} == {("a", "gene", 3.0), ("a", "B", 2.0), ("b", "gene", 1.0)}
    assert len(got) == 4
