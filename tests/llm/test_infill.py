import hashlib
import re

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from setspan.llm import infill, queries

MARKS = [np.frombuffer(m.encode(), np.uint8) for m in infill.MARKS]


def brute(doc_id, text, seed=7):
    """(n, form, prefix_chars, middle_chars, output), text by text."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in infill.MARKS):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, docs):
    out = infill.restore(infill.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string")))
    got = sorted((str(tuple(r)) for r in out.collect()))
    assert got == sorted(str((d, *brute(d, t), t or "")) for d, t in docs)


def test_forms(spark):
    pieces = ["", "a", "\n", "\n\n", "é\n\U0001f600x\r\ny", "<P", "<", "P>\n<S", "x<M>y", "<S>", "a\nb\nc\n", "<P>\n"]
    docs = [(40 * k + j, a + b) for k, a in enumerate(pieces) for j, b in enumerate(pieces)]
    docs += [(k, None) for k in range(3)] + [(None, "a\nb"), (None, None), (5, "same\nrow"), (5, "same\nrow")]
    check(spark, docs)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.text("ab\né<PSM>\U0001f600", max_size=12), min_size=1, max_size=6),
    st.lists(st.integers(0, 2**32 - 1), min_size=24, max_size=24),
)
def test_round_trip(texts, numbers):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([0, *map(len, raw)])
    draws = np.array(numbers, np.int64).reshape(6, 4)[: len(raw)]
    out, out_ends, _, forms, _ = infill.rearrange(data, ends, draws, MARKS, 80, 50)
    back, back_ends = infill.put_back(out, out_ends, forms, MARKS)
    assert back.tobytes() == data.tobytes() and (back_ends == ends).all()


def test_blocks_of_a_batch(spark, monkeypatch):
    """However a batch is cut into blocks, and in slices of a batch, the same rows come out."""
    import pyarrow as pa

    texts = [f"line {k}\n" * (k % 7) + "é" * k for k in range(50)]
    column = pa.array(["before", *texts])[1:]
    for size in (1, 100, 10**6):
        monkeypatch.setattr(infill, "BLOCK_BYTES", size)
        got = []
        for row, stop, data, ends in infill._blocks(column):
            got += [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])]
        assert got == texts


def test_very_long_texts(spark):
    long = "".join(f"line {k} of a long text é\n" for k in range(400_000))
    docs = [(1, long), (2, "x" * 10_000_000), (3, "\n" * 1_000_000), (4, "short\ntext")]
    check(spark, docs)


def test_cases(spark, odd_docs, no_docs):
    out = infill.restore(infill.fill_in_middle(odd_docs))
    assert out.count() == odd_docs.count()
    assert infill.restore(infill.fill_in_middle(no_docs)).count() == 0
    assert {r.form for r in out.where("n = 0").collect()} == {"plain"}
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(odd_docs, marks=marks)


def test_other_marks_and_rates(spark):
    docs = spark.createDataFrame([(k, f"a{k}\nb\nc<P>\n") for k in range(200)], "doc_id long, text string")
    out = infill.restore(
        infill.fill_in_middle(docs, fim_percent=50, spm_percent=0, marks=("<pre>", "<suf>", "<mid>")),
        marks=("<pre>", "<suf>", "<mid>"),
    ).collect()
    forms = [r.form for r in out]
    assert 60 < forms.count("psm") < 140 and "spm" not in forms
    assert all(r.restored == f"a{r.doc_id}\nb\nc<P>\n" for r in out)


def test_query_is_brute_force(spark):
    sf = f"{oracle.TESTDATA}/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {r.doc_id: tuple(r)[1:] for r in queries.op12_fill_in_middle(spark, sf).collect()}
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        *cuts, output = brute(doc.doc_id, doc.text)
        assert rows.pop(doc.doc_id) == (*cuts, sha(output), sha(doc.text or ""))
    assert not rows
