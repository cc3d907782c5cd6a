import hashlib
import re
import zlib

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setspan.llm import queries, runs

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_runs(x, min_words=24, min_periods=3):
    """Every maximal stretch of every period, tried out."""
    out = set()
    x = np.unique(np.array(x, object).astype(str), return_inverse=True)[1] if len(x) else np.zeros(0, int)
    for q in range(1, len(x) // min_periods + 1):
        same = np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0]))
        turn = np.diff(same)
        for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)):
            n = int(e - s + q)
            smaller = any((x[s : s + n - d] == x[s + d : s + n]).all() for d in range(1, q))
            if n >= max(min_words, min_periods * q) and not smaller:
                out.add((int(s), n, q))
    return out


def brute_report(words):
    """The tuple of the contract for a list of words."""
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone, best = set(), None
    for r in found:
        gone.update(range(r[0] + r[2], r[0] + r[1]))
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 2), max_size=40), st.integers(0, 39), st.integers(1, 6),
    st.sampled_from([1, 2, 5, 9, 24]), st.sampled_from([2, 3, 4]),
)
def test_all_runs(x, a, p, min_words, min_periods):
    a = min(a, len(x))
    x = [x[i] if i < a else x[min(a + (i - a) % p, len(x) - 1)] for i in range(len(x))]
    found = runs.find_runs(np.array(x, np.int64), min_words, min_periods) if x else []
    assert len(found) == len(set(found))
    assert set(found) == brute_runs(x, min_words, min_periods)


def test_classes_of_many_positions():
    """Blocks of a class split and positions come in from both sides."""
    rng = np.random.default_rng(3)
    x = []
    for _ in range(3000):
        x += [*range(20), *([99] * rng.integers(1, 4))]
    x += [*range(20)] * 4
    x = np.array(x, np.int64)
    found = set(runs.find_runs(x, 24, 3))
    assert found == brute_runs_of_period(x, range(1, 120))


def brute_runs_of_period(x, periods):
    out = set()
    for q in periods:
        turn = np.diff(np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)):
            n = int(e - s + q)
            if n >= max(24, 3 * q) and not any((x[s : s + n - d] == x[s + d : s + n]).all() for d in range(1, q)):
                out.add((int(s), n, q))
    return out


def test_very_long_texts(spark):
    """A million equal words, a million words of one long period, and ten million characters."""
    n = 1_000_000
    docs = [
        (1, "a " * n),
        (2, " ".join(f"w{i % 250_000}" for i in range(n))),
        (3, " ".join(f"word{i}" for i in range(n))),
    ]
    got = {r.doc_id: r for r in runs.collapse_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, n, 1)] and got[1].collapsed == "a"
    assert [tuple(r) for r in got[2].runs] == [(0, n, 250_000)]
    assert got[2].collapsed == " ".join(f"w{i}" for i in range(250_000))
    assert got[3].runs == [] and got[3].n_words == n


def test_cases(spark, odd_docs, no_docs):
    rows = runs.collapse_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[6].collapsed == "word" and [tuple(r) for r in by[6].runs] == [(0, 3000, 1)]
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[5].collapsed == ""
    report = {r.doc_id: r for r in runs.run_report(runs.collapse_runs(odd_docs)).collect()}
    assert report[3].start is None and report[3].exponent_milli is None and report[3].n_runs == 0
    assert report[6].exponent_milli == 3_000_000
    assert runs.run_report(runs.collapse_runs(runs.with_planted_runs(no_docs))).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(odd_docs, min_periods=1)


def test_ties_take_the_first(spark):
    text = " ".join(["a b"] * 20 + ["x"] + ["c d"] * 20 + ["y"] + ["e f g"] * 20)
    row = runs.run_report(runs.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period) == (3, 0, 40, 2)


def test_query_is_brute_force(spark):
    sf = f"{oracle.TESTDATA}/sf0.001"
    rows = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = WORD.findall(doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert rows.pop(doc.doc_id) == brute_report(words)
    assert not rows
