import os
import re

import oracle
import pytest

import corpus_pipeline
from setspan.llm.common import stage

SF = f"{oracle.TESTDATA}/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def test_stages_one_by_one(spark):
    """Each stage against plain rules on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, work in corpus_pipeline.STAGES[:-1]:
        after = stage(work(spark, docs, SF))
        assert after.columns == columns
        seen[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()})
        docs = after
    assert list(seen) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate"]

    before, after = seen["line_dedup"]
    assert set(before) == set(after)
    holders = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\f\r"))
    for d, r in before.items():
        for line in {key(x) for x in r.text.split("\n")}:
            if len(line) >= 20:
                holders.setdefault(line, set()).add(d)
    for d, r in before.items():
        stays = [x for x in r.text.split("\n") if not (len(holders.get(key(x), ())) >= 3 and d != max(holders[key(x)]))]
        assert after[d].text == "\n".join(stays)

    from test_simhash import brute_print, brute_roots

    before, after = seen["near_dedup"]
    prints = {d: brute_print(r.text) for d, r in before.items()}
    roots = brute_roots(set(prints.values()))
    first = {}
    for d, p in prints.items():
        first[roots[p]] = min(d, first.get(roots[p], d))
    assert set(after) == set(first.values())

    from test_decontaminate import brute

    before, after = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {int(row[0]) for row in brute([(d, r.text) for d, r in before.items()], items) if not row[-1]}
    assert set(after) == clean and all(after[d].text == before[d].text for d in clean)

    # What is left, packed: every token of every document, gapless, in sequences of at most 2,048.
    import public_tokenizers
    from test_packing import check
    from tokenizers import Tokenizer

    from setspan.llm import packing

    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    check(rows, [(d, r.text) for d, r in after.items()], tokenizer, packing.LENGTH)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    assert rows and max(r.length for r in rows) <= 2048
