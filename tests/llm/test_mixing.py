from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setspan.llm import mixing

SIZES = "source string, unnamed boolean, size long"


def brute_targets(sizes, weights=(5, 2, 1), budget=Fraction(3, 2), most=2):
    """Share again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = budget * sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target.update(share)
            break
        target.update({s: Fraction(most * sizes[s]) for s in over})
        open_ -= over
    return target


def targets_of(spark, sizes, **rules):
    rows = [("" if s is None else s, s is None, n) for s, n in sizes.items()]
    out = mixing.source_targets(spark.createDataFrame(rows, SIZES), **rules).collect()
    return {None if r.unnamed else r.source: r.target for r in out}


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("aé\U0001f600 ", max_size=3)), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    got, want = targets_of(spark, sizes), brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(float(want[s]))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_many_sources_over_blocks(spark):
    sizes = {f"s{k:04d}": k * k % 977 for k in range(300)}
    want = {s: float(t) for s, t in brute_targets(sizes).items()}
    for blocks in (1, 30):
        assert targets_of(spark, sizes, blocks=blocks) == pytest.approx(want)


def test_all_sources_stop(spark):
    assert targets_of(spark, {"a": 10, "b": 3}, budget=Fraction(2)) == {"a": 20.0, "b": 6.0}
    assert targets_of(spark, {"a": 0, None: 0}) == {"a": 0.0, None: 0.0}


@pytest.fixture(scope="module")
def docs(spark):
    """A hot source, a source of marks and prose, one without a name, one without words."""
    rows = [(k, "word " * (k % 40), "hot") for k in range(3000)]
    rows += [(10_000 + k, "good plain words " * 5 if k % 2 else "## $$ {} || " * 4, "mixed") for k in range(2000)]
    rows += [(20_000 + k, "x y z", None) for k in range(50)] + [(30_000, " ", "void"), (30_001, None, "void")]
    rows += [(None, "no id here", "hot")] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_budgets_are_met(docs):
    rows = mixing.mix_report(mixing.mix(docs)).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target].append(r)
    for (size, target), mine in by.items():
        assert sum(r.size for r in mine) == size
        assert sum(r.taken for r in mine) == int(target)
        # Complete epochs first: taken differs by less than one epoch, and one document is cut.
        epochs = int(target // size) if size else 0
        assert all(epochs * r.size <= r.taken <= (epochs + 1) * r.size for r in mine)
        assert sum(r.taken % r.size != 0 for r in mine if r.size) <= 1


def test_blocks_agree(docs):
    want = Counter(mixing.mix(docs, blocks=1).collect())
    for blocks in (64,):
        assert Counter(mixing.mix(docs.repartition(5), blocks=blocks).collect()) == want
    assert Counter(mixing.mix(docs, seed="other").collect()) != want


def test_smallest_keys_are_taken(docs):
    """The part of an epoch is what a sort of the whole source by key takes."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id", "source", mixing.word_count(text).alias("size"),
        mixing.exponential_key(F.col("doc_id"), text, mixing.mark_quality(text), "mix").alias("key"),
    ).where("source = 'mixed'").collect()
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    target = next(r.target for r in got.values() if r.doc_id == 10_000)
    left = int(target) % sum(r.size for r in keyed)
    for r in sorted(keyed, key=lambda r: r.key):
        assert got[r.doc_id].part == min(left, r.size)
        left -= got[r.doc_id].part


def test_quality_is_preferred(spark):
    """Documents of weight 4 are the first choice four times as often as those of weight 1."""
    rows = [(k, f"w{k}", "s") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = lambda text: F.when(F.pmod(F.crc32(text.cast("binary")), F.lit(2)) == 0, 4.0).otherwise(1.0)
    mixed = mixing.mix(docs, budget=Fraction(1, 10), quality=weight)
    taken = mixed.where("part > 0").join(docs, "doc_id").withColumn("w", weight(F.col("text")))
    by = {r.w: r["count"] for r in taken.groupBy("w").count().collect()}
    assert sum(by.values()) == 400
    assert 2.8 < by[4.0] / by[1.0] < 5.2


def test_texts_of_the_mix(docs):
    mixed = mixing.mix(docs)
    texts = mixing.mixed_texts(docs, mixed)
    words = texts.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    got = {r.source: r.n for r in words.collect()}
    want = {r.source: int(r.target) for r in mixed.select("source", "target").distinct().collect()}
    assert {s: got.get(s) or 0 for s in want} == want
    copies = {r.doc_id: r["count"] for r in texts.groupBy("doc_id").count().collect()}
    assert copies[None] == mixed.where("doc_id is null").selectExpr("sum(epochs + int(part > 0))").first()[0]


def test_cases(spark, odd_docs, no_docs):
    rows = mixing.mix_report(mixing.mix(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert mixing.mix_report(mixing.mix(no_docs)).count() == 0
    long = spark.createDataFrame([(1, "word " * 2_000_000, "a"), (2, "w", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix_report(mixing.mix(long)).collect()}
    assert got == {1: 2_999_999, 2: 2}
