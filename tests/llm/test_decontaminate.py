import hashlib
import re

from setspan.llm import decontaminate

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def brute(docs, items):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                ids = grams.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((
            str(doc), len(w), len(hit), len([i for i in found if i is not None]),
            hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w),
        ))
    return sorted(out)


def test_brute_force(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [
        (20, f"Before it. {ITEM.upper()}! After it."),
        (21, f"{ITEM} {ITEM} " + "filler words " * 400),
        (22, f"{ITEM}, short item. " + "filler words " * 20),
        (23, "café noir " * 3),
    ]
    items = [
        (10, ITEM), (9, ITEM + " pi rho"), (9, ITEM), (None, "lazy dog"), (11, "short item"),
        (12, ""), (13, None), (14, "café"), (15, "never seen anywhere at all in those texts"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(docs, bench).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, items)
    # The other join gives the same.
    decontaminate.BROADCAST_GRAMS, old = 0, decontaminate.BROADCAST_GRAMS
    try:
        again = decontaminate.contamination_report(docs, bench).collect()
    finally:
        decontaminate.BROADCAST_GRAMS = old
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert decontaminate.contamination_report(no_docs, bench).count() == 0
    none = bench.limit(0)
    assert not any(r.contaminated for r in decontaminate.contamination_report(docs, none).collect())


def test_drop(spark, odd_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    left = decontaminate.drop_contaminated(odd_docs, bench)
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "6", "7", "None"]


def test_items_of_all_lengths_and_shared_prompts(spark, monkeypatch):
    """A prompt that all items begin with, items of one to fourteen words, and a text of ten megabytes."""
    prompt = " ".join(f"prompt{k}" for k in range(14))
    items = [(k, f"{prompt} question{k}") for k in range(60)]
    items += [(100 + n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 15)]
    long = "plain words of a long text " * 400_000
    rows = [(1, prompt), (2, f"a {prompt} question7 b"), (3, prompt), (4, " ".join(t for _, t in items[60:]))]
    small = [*rows, (5, "plain words " * 50), (None, f"{prompt} question3"), (2, rows[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def report(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted((str(r[0]), *r[1:]) for r in decontaminate.contamination_report(docs, bench).collect())

    assert report(small) == brute(small, items)
    assert report([(9, long + prompt)])[0][1:4] == (2_400_014, 14, 60)
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 0)
    assert report(small) == brute(small, items)


def test_windows_are_shuffled_without_words(spark):
    """Beyond the broadcast no exchange of windows carries the words of their documents."""
    docs = spark.createDataFrame([(k, f"{ITEM} {k}") for k in range(5)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "short item")], "item_id long, text string")
    parts = decontaminate.benchmark_windows(bench, "item_id", "text", 13)
    grams = parts.groupBy("hash", "other", "length").agg({"gram": "min"}).withColumnRenamed("min(gram)", "gram")
    hits = decontaminate.window_hits(docs, grams, "doc_id", "text", [2, 13], 13, False)
    plan = hits._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert shuffled and not any("words" in names for names in shuffled)
