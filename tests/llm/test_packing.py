import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from setspan.llm import packing

HARD = [
    "Hello, WORLD!! it's 2024 now <|endoftext|> and naïve café́ ẞ İ ΣΣ don't.",
    "\t tabs\r\nand\x0blines 　wide  ", "", None, "\U0001f600\U0001f600 x%%% y&&& 12.5",
    "ÉTÉ!! ×÷ þÞ a|b ### can't've",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_ids_are_the_tokenizers(tokenizer):
    for text, ids in zip(HARD, packing.encode(HARD, None)):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_small_cache_is_right(tokenizer):
    known = packing.WordIds(None, limit=3)
    words = ("a b c d e f g a b c Hello, World! " * 5).split(" ")
    got = b"".join(map(known.__getitem__, words))
    assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids


def check(rows, docs, tokenizer, length):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    for doc, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), length))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    return by_seq


def test_pack(spark, tokenizer):
    docs = [(k, t) for k, t in enumerate(HARD)] + [(100 + k, "word " * (k * 7 % 150)) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack(df, length=64, task_pieces=100).collect()
    seqs = check(rows, docs, tokenizer, 64)
    total = sum(r.length for r in rows)
    assert len(seqs) <= 1.1 * total / 64 + 8
    again = packing.pack(df, length=64, task_pieces=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_bounded_bins():
    bins = packing.OpenBins(100, 4)
    sizes = [60, 61, 62, 63, 64, 40, 39, 38, 100, 1]
    places = [bins.place(s) for s in sizes]
    # The fifth closes the fullest (63 used): 38 goes with 62, 40 with 60, 39 with 61.
    assert places[5][0] == 0 and places[6][0] == 1 and places[7][0] == 2
    assert places[8] == (5, 0) and bins.count <= 4


def test_cases(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs)
    assert rows.where("piece = 0").count() == odd_docs.count()
    assert {r.length for r in rows.where("doc_id in (3, 4, 5)").collect()} == {1}
    assert packing.pack(no_docs).count() == 0
