from setspan.llm import lines, quality


def test_line_cases(spark, odd_docs, no_docs):
    got = lines.line_report(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped))
    # The shared line stays in the largest id (8), in both of its lines there.
    assert by[1] == [(1, 1)] and by[2] == [(1, 1), (1, 1)] and by[8] == [(2, 0)]
    assert sorted(by[None]) == [(1, 0), (2, 1)]
    assert by[3] == [(1, 0)]
    assert lines.line_report(no_docs).count() == 0


def test_line_blocks_agree(spark, odd_docs):
    """However the rows are cut into blocks, the same lines go."""
    want = sorted(map(str, lines.dropped_lines(odd_docs, blocks=1).collect()))
    for blocks in (2, 5, 40):
        assert sorted(map(str, lines.dropped_lines(odd_docs, blocks=blocks).collect())) == want
    assert want


def test_hot_line_over_many_blocks(spark):
    docs = spark.createDataFrame(
        [(k, f"a line that everybody has in the text\nown line number {k} of this text") for k in range(300)],
        "doc_id long, text string",
    )
    gone = lines.dropped_lines(docs, blocks=16).collect()
    assert sorted(r.doc for r in gone) == list(range(299))
    assert {r.line for r in gone} == {0}


def test_dedup_text(spark, odd_docs):
    out = lines.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == "" and by[1][0].n_chars == 0
    assert by[3][0].text is None and by[3][0].n_chars is None
    assert sorted(str(r.text) for r in by[None]) == ["Another line that is long enough to count.", "None"]


def test_long_document_bitmap(spark):
    many = "\n".join(f"line number {k} with some more words" for k in range(500))
    docs = spark.createDataFrame([(k, many) for k in range(3)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.line_report(docs).collect()}
    assert got == {0: 500, 1: 500, 2: 0}


def verdict(spark, text):
    return quality.line_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_quality_rules(spark):
    clean = "\n".join(" ".join(f"word{k}x{j}" for j in range(14)) + "." for k in range(5))
    assert verdict(spark, clean).kept
    assert not verdict(spark, "Too short.").kept
    shout = " ".join(f"WORD{k}!!" for k in range(60))
    assert not verdict(spark, shout).base_failed and not verdict(spark, shout).kept
    menu = " | ".join(f"item{k}" for k in range(60)) + " |"
    assert not verdict(spark, menu).base_failed and not verdict(spark, menu).kept
    marks = " ".join(f"word{k}%%%" for k in range(60))
    assert not verdict(spark, marks).base_failed and not verdict(spark, marks).kept
    repeated = verdict(spark, "one two three four five six seven eight nine " * 10)
    assert repeated.n_repeat_words == repeated.n_words == 90 and repeated.base_failed
    part = quality.keep_quality(
        spark.createDataFrame([(1, clean + "\nAll rights reserved.\nHome", 3)], "doc_id long, text string, n_chars long")
    ).first()
    assert part.text == clean and part.n_chars == len(clean)


def test_quality_cases(spark, odd_docs, no_docs):
    got = quality.line_quality(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert (r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False)
    assert quality.line_quality(no_docs).count() == 0
    assert quality.keep_quality(odd_docs).columns == odd_docs.columns
