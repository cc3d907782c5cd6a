import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from setspan.functions import stats
from setspan.operators import scan
from setspan.operators.scan import bh_adjust, collapse_repeats, with_rank


def exact_tail(k, n, m, u):
    n = min(n, u)
    k = min(k, m, n)
    if min(u, m, n) <= 0 or m > u:
        return 1.0
    total = math.comb(u, n)
    hits = sum(math.comb(m, i) * math.comb(u - m, n - i) for i in range(max(k, n + m - u, 0), min(n, m) + 1))
    return float(Fraction(hits, total))


def tails(spark, cases):
    df = spark.createDataFrame(cases, "k int, n int, m int, u int")
    return df.withColumn("p", stats.hypergeom_upper_tail("k", "n", "m", "u")).collect()


def test_tail_named_cases(spark):
    cases = [(10, 50, 100, 1000), (0, 50, 100, 1000), (50, 50, 100, 1000), (10, 200, 50, 100)]
    p = {(r.k, r.n, r.m, r.u): r.p for r in tails(spark, cases)}
    assert 0 < p[cases[0]] <= 0.5
    assert 0.9 <= p[cases[1]] <= 1
    assert 0 <= p[cases[2]] <= 0.1
    assert 0.99 <= p[cases[3]] <= 1


def test_tail_is_exact(spark):
    rng = random.Random(3)
    cases = [(3, 50, 40, 40000), (0, 0, 5, 10), (1, 5, 0, 10), (1, 1, 1, 0), (3, 4, 20, 10), (5, 10, 5, 10), (2, 9, 3, 10)]
    for _ in range(200):
        u = rng.choice([7, 30, 250, 1500])
        m, n = rng.randint(0, min(u, 400)), rng.randint(0, u)
        cases.append((rng.randint(0, max(1, min(m, n))), n, m, u))
    for r in tails(spark, cases):
        want = exact_tail(r.k, r.n, r.m, r.u)
        assert r.p == pytest.approx(want, rel=1e-10, abs=1e-300), r


def test_mass_sums_to_one_and_ln_factorial(spark):
    df = spark.range(0, 61).select(F.col("id").alias("k"))
    df = df.selectExpr("k", "60L AS n", "100L AS m", "1000000000L AS u")
    assert df.agg(F.sum(stats.hypergeom_pmf("k", "n", "m", "u"))).first()[0] == pytest.approx(1.0, rel=1e-9)
    got = spark.range(0, 400).select("id", stats.ln_factorial("id").alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.id + 1), rel=1e-11, abs=1e-12) for r in got)
    outside = spark.sql("SELECT 3 AS n, 5 AS k").select(stats.ln_choose("n", "k")).first()[0]
    assert outside is None


def plain_bh(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, low, m = [0.0] * len(ps), 1.0, len(ps)
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        low = min(low, ps[i] * m / rank)
        out[i] = low
    return out


@pytest.mark.parametrize("split", [False, True, None])
def test_bh_against_loop(spark, split):
    rng = random.Random(5)
    rows, want = [], {}
    for group, ps in {
        "five": [0.01, 0.02, 0.03, 0.04, 0.05],
        "one": [0.3],
        "ties": [rng.choice([0.001, 0.2, 0.2, 0.7, 1.0]) for _ in range(60)],
        "many": [rng.random() for _ in range(500)],
    }.items():
        for i, (p, q) in enumerate(zip(ps, plain_bh(ps))):
            rows.append((group, i, p))
            want[group, i] = q
    df = spark.createDataFrame(rows, "g string, i int, pvalue double")
    got = {(r.g, r.i): r.padj for r in bh_adjust(df, ["g"], split=split).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert all(got["five", i] == pytest.approx(0.05) for i in range(5))


def test_bh_keeps_null(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", None)], "g string, pvalue double")
    got = {r.pvalue: r.padj for r in bh_adjust(df, ["g"], split=False).collect()}
    assert got == {0.5: 0.5, None: None}


def test_split_rank_equals_window(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"c{i % 7}", f"g{i}", float(rng.randint(-5, 5))) for i in range(3000)]
    df = spark.createDataFrame(rows, "contrast string, gene_id string, value double").repartition(5)
    order = [F.col("value").desc(), F.col("gene_id")]
    plain = with_rank(df, ["contrast"], order, split=False)
    cut = with_rank(df, ["contrast"], order, split=True)
    assert sorted(plain.collect()) == sorted(cut.select(plain.columns).collect())
    monkeypatch.setattr(scan, "GROUP_ROWS", 100)
    assert scan.must_split(df, ["contrast"])
    assert sorted(with_rank(df, ["contrast"], order).select(plain.columns).collect()) == sorted(plain.collect())


def test_collapse_rules(spark):
    rows = [("g", 2, 1.0), ("g", 1, -3.0), ("g", 3, 3.0), ("h", 1, 0.0)]
    df = spark.createDataFrame(rows, "gene_id string, row_no int, value double")
    got = {rule: {r.gene_id: r.value for r in collapse_repeats(df, ["gene_id"], ["value"], rule).collect()}
           for rule in ("first", "last", "max_abs")}
    assert got == {"first": {"g": -3.0, "h": 0.0}, "last": {"g": 3.0, "h": 0.0}, "max_abs": {"g": 3.0, "h": 0.0}}
    with pytest.raises(ValueError):
        collapse_repeats(df, ["gene_id"], ["value"], "any")


def test_hub_join_equals_join(spark, monkeypatch):
    rng = random.Random(2)
    left = [(f"c{i % 9}", f"g{rng.randint(0, 8)}") for i in range(60)]
    right = [(f"s{i}", "g1" if i % 3 == 0 else f"g{rng.randint(0, 8)}") for i in range(300)]
    a = spark.createDataFrame(left, "contrast string, gene_id string")
    b = spark.createDataFrame(right, "term_id string, gene_id string")
    plain = sorted(tuple(r) for r in a.join(b, "gene_id").collect())
    monkeypatch.setattr(scan, "HUB_ROWS", 20)
    cut = scan.join_hubs(a, b, "gene_id")
    assert sorted(tuple(r) for r in cut.select("gene_id", "contrast", "term_id").collect()) == plain
