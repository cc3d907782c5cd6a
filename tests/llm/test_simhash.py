import random
import re

import xxhash
from pyspark.sql import functions as F

from setspan.llm import simhash


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(points):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    points = sorted(points)
    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {p: find(p) for p in points}


def test_fingerprints(spark, odd_docs):
    got = simhash.duplicate_report(odd_docs).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert len(got) == len(texts)
    want = sorted((str(d), f"{brute_print(t):016x}") for d, t in texts)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.component_id)
    assert by[1] == by[2] == 1
    assert by[3] == by[4] == by[5] == 3  # no words: linked like any other fingerprint


def test_cover_has_every_pair_within_the_radius():
    rnd = random.Random(5)
    for level in simhash.mask_levels(levels=2)[1][:30]:
        assert level[2] < 1 << 64
    masks = [m for _, _, m in simhash.mask_levels(levels=1)[0]]
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
        assert any(diff & m == 0 for m in masks)


def test_pairs_and_components_with_full_buckets(spark):
    """A ball of near fingerprints, far more than a bucket compares directly."""
    rnd = random.Random(3)
    center = rnd.getrandbits(63)
    points = {center}
    while len(points) < 260:
        points.add(center ^ sum(1 << b for b in rnd.sample(range(40), rnd.randint(1, 4))))
    points |= {rnd.getrandbits(63) for _ in range(60)}
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    links = simhash.near_pairs(df, bucket=8)
    got = {(r.a, r.b) for r in links.collect()}
    listed = sorted(points)
    want = {
        (a, b)
        for i, a in enumerate(listed)
        for b in listed[i + 1 :]
        if bin(a ^ b).count("1") <= 3
    }
    assert got == want
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    want_roots = brute_roots(points)
    assert roots == {p: want_roots[p] for pair in want for p in pair}


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    got = {(r.node, r.root) for r in simhash.components(links.orderBy(F.rand(1))).collect()}
    assert got == {(k, 0) for k in range(201)}


def test_keep_representatives(spark, odd_docs):
    kept = simhash.keep_representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("1") == 1 and ids.count("2") == 0
    assert "3" in ids and "4" not in ids and "5" not in ids
    report = {r.component_id for r in simhash.duplicate_report(odd_docs).collect()}
    assert len(ids) == len(report)


def test_empty(spark, no_docs):
    assert simhash.duplicate_report(no_docs).count() == 0
    assert simhash.keep_representatives(no_docs).count() == 0
