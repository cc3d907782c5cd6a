"""Languages and toxicity: gradients, held-out accuracy on the given tables, odd rows."""

import os

import numpy as np
import oracle
import pytest

from setspan.llm import langid, toxicity

SF = f"{oracle.TESTDATA}/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def test_gradients():
    rng = np.random.default_rng(1)
    net = langid.ByteGRU(["a", "b", "c"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = rng.integers(97, 103, (4, 6)).astype(np.uint8)
    mask = np.ones(x.shape)
    mask[1, 4:] = 0
    y = np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, mask, y)
    for name in net.weights:
        w = net.weights[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name == "table":
                at = (at[0], int(x[rng.integers(4), rng.integers(4)]), at[2])
            old, step = w[at], 1e-2
            w[at] = old + step
            up = net.gradients(x, mask, y)[0]
            w[at] = old - step
            down = net.gradients(x, mask, y)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


def test_fast_and_plain_states_agree():
    net = langid.ByteGRU(["a", "b"], hidden=5)
    x = np.random.default_rng(2).integers(97, 123, (7, langid.SEGMENT)).astype(np.uint8)
    sizes = np.array([64, 1, 10, 64, 33, 2, 5])
    got = net.positions(x, sizes)
    assert np.allclose(got.sum(1), sizes, atol=1e-3)


@given
def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 150 and right / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark, odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.identify(no_docs).count() == 0


def test_grams_stay_in_words():
    data = toxicity.normal("Ab, cde!")
    assert data == b" ab cde "
    codes = [int(c).to_bytes(8, "big").lstrip(b"\0") for c in toxicity.grams(data)]
    assert codes == [b" ", b" a", b" ab", b" ab ", b" c", b" cd", b" cde", b" cde "]


def test_blocks_hold_every_word_once(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    texts = ["one two three " * 20, None, "x" * 170, "end"]
    model = [(np.zeros(n, np.uint64), np.zeros(n, np.float32)) for n in (11, 7)]
    sums = toxicity.evidence(texts, model)
    whole = [max(0, len(toxicity.normal(t)) - 1) for t in texts]
    assert abs(sums[0, 0] - whole[0]) == 0 and sums[1, 0] == 0 and sums[3, 0] == whole[3]


def test_shared_backoff_sums_to_one(spark):
    """The smoothed probabilities of the letters after a context are those of a distribution."""
    text = "aa ab ba bb aab abb baba " * 3
    rows = spark.createDataFrame([(text, 0), ("aa bb cc abc", 1)], "text string, label int")
    counted = toxicity.count_grams(rows)
    out = toxicity.with_shared(counted).toPandas()
    assert (out["shared"] > 0).all() and (out["shared"] <= 1).all()
    assert len(out) == counted.count()


def test_every_gram_counts(spark, monkeypatch):
    """Grams that share a slot keep their own ratio, and joins give the evidence of the broadcast."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(60)] + [None, "", "zwuxa zwuxa"]
    rows = spark.createDataFrame([(t, int(k % 4 == 0)) for k, t in enumerate(texts)], "text string, label int")
    counted = toxicity.stage(toxicity.count_grams(rows))
    whole = toxicity.Model(counted)
    table = whole.held.value[0]
    ratios = whole.ratios[0].toPandas()
    value, found = toxicity.look_up(ratios.gram.to_numpy().astype(np.uint64), table)
    assert len(table[2]) > 0 and found.all() and np.array_equal(value, ratios.ratio.to_numpy())
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0]])], "doc long, text string")
    measured = lambda m: m.measure(docs).toPandas().sort_values("doc").to_numpy(float)
    monkeypatch.setattr(toxicity, "HELD", 200)
    joined = toxicity.Model(counted)
    assert whole.whole and not joined.whole
    assert np.allclose(measured(whole), measured(joined), atol=1e-4)


def test_held_out_toxicity(spark):
    """Made-up insults in made-up prose: rare endings of known stems are found."""
    rng = np.random.default_rng(4)
    syllables = ["an", "re", "th", "on", "ing", "es", "ou", "le", "tion", "ea", "st", "ha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [word() for _ in range(rng.integers(30, 200))]
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[rng.integers(len(words))] = "zwux" + word()
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, known).where("held_out").collect()
    right = [(r.predicted == 1) == (r.doc_id % 6 == 0) for r in got]
    assert len(right) > 150 and np.mean(right) > 0.97


def test_toxicity_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (1, None), (8, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, labels).count() == 0
    none = toxicity.score(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_rare_toxic_rows_are_fitted(spark, monkeypatch):
    """A class is sampled by itself, and where it is short the folds are fitted on in turn."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    rows = []
    for k in range(1200):
        words = [word() for _ in range(40)]
        if k % 12 == 0:
            words[5:8] = ["zwuxo", "zwuxin", "zwuxoz"]
        rows.append((k, " ".join(words), int(k % 12 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fits = []
    fit = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y, w: fits.append((y, w)) or fit(x, y, w))

    def held_out():
        got = toxicity.score(docs.drop("toxic"), docs.drop("text")).where("held_out").collect()
        return [(r.predicted == 1) == (r.doc_id % 12 == 0) for r in got]

    assert np.mean(held_out()) > 0.97  # 100 toxic rows, fewer than FIT_LEAST in a fold
    y, weight = fits[-1]
    assert y.sum() > toxicity.FIT_LEAST and np.all(weight == 1)
    monkeypatch.setattr(toxicity, "FIT_LEAST", 5)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 10)
    assert np.mean(held_out()) > 0.9
    y, weight = fits[-1]
    assert (y == 1).sum() == (y == 0).sum() == 10 and weight[y == 0][0] > 5 * weight[y == 1][0] >= 5


def test_many_languages(spark):
    """Forty made-up languages, each with its own words: every one is learned and told apart."""
    rng = np.random.default_rng(9)
    rows = []
    for lang in range(40):
        words = ["".join(rng.choice(list("aeioubdfgklmnprst"), rng.integers(3, 7))) for _ in range(25)]
        rows += [(40 * k + lang, " ".join(rng.choice(words, 40)), f"l{lang:02d}") for k in range(40)]
    rows += [(1, rows[0][1], "l00")] * 500  # repeats count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).where("held_out").collect()
    right = [r.lang_pred == f"l{r.doc_id % 40:02d}" for r in got]
    assert {r.lang_pred for r in got} == {f"l{k:02d}" for k in range(40)}
    assert len(right) > 200 and np.mean(right) > 0.9
