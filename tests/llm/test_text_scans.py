import re

import oracle
import pytest

from setspan.llm import chat, licenses, pii

KEY = b"key of the tests"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):
    assert sorted(pii.permute(k, size, KEY, "t") for k in range(size)) == list(range(size))


def test_formats_stay_and_values_link():
    text = (
        "+1 (663) 555-6869 or 663.555.6869; 4111 1111 1111 1111, 4111111111111111; 10.0.0.255; "
        "Bob.smith67@mail3.example.com; 2024-02-29 and 29.02.2024; GB82 WEST 1234 5698 7654 32; 123-45-6789"
    )
    new, counts = pii.replace_private(text, KEY)
    assert counts == {"phone": 2, "card": 2, "ip": 1, "email": 1, "date": 2, "iban": 1, "ssn": 1}
    shape = lambda t: re.sub(r"\d+", lambda m: "9" * len(m.group()), t)
    assert shape(new)[:60] == shape(text)[:60]
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})\.(\d{3})\.(\d{4})", new)[0]
    assert phones[:3] == phones[3:]
    spaced, tight = re.findall(r"(\d{4} \d{4} \d{4} \d{4}), (\d{16})", new)[0]
    assert spaced.replace(" ", "") == tight != "4111111111111111" and pii.luhn(tight)
    iso, dotted = re.findall(r"(\d{4}-\d\d-\d\d) and (\d\d\.\d\d\.\d{4})", new)[0]
    assert iso.split("-") == dotted.split(".")[::-1]
    iban = re.findall(r"GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d", new)[0]
    assert pii.iban_rest(iban.replace(" ", "")) == 1
    assert new.count("@mail3.example.com") == 1
    assert pii.replace_private(text, b"another")[0] != new


def test_invalid_values_stay():
    text = "4111111111111112 999.1.1.1 2023-02-30 666-12-3456 GB00 WEST 1234 5698 7654 32 (123) 555-1234"
    assert pii.replace_private(text, KEY) == (text, {})


def test_one_to_one():
    found = {pii.pseudonym("ip", f"10.1.{a}.{b}", KEY) for a in range(20) for b in range(50)}
    assert len(found) == 1000
    days = {pii.pseudonym("date", f"2001-{m:02d}-{d:02d}", KEY) for m in range(1, 13) for d in range(1, 29)}
    assert len(days) == 12 * 28


def test_phones_by_their_form():
    numbers = [f"+1 ({a}) {b}-{c}" for a in ("017", "132", "974") for b in ("055", "555") for c in range(7700, 7750)]
    new = []
    for number in numbers:
        text, counts = pii.replace_private(f"call {number}.", KEY)
        assert counts == {"phone": 1} and number not in text
        assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", text)
        new.append(text)
    assert len(set(new)) == len(numbers)
    assert pii.replace_private("+1 (017) 555-7713 +1.017.555.7713", KEY)[1] == {"phone": 2}


def test_long_mail_addresses():
    for n in (45, 50, 64):
        local = ("bounce" * 11)[:n]
        new, counts = pii.replace_private(f"to {local}@example.org", KEY)
        assert counts == {"email": 1} and local not in new and len(new) == n + 15


def test_pii_cases(spark, odd_docs, no_docs):
    got = pii.pseudonymize(odd_docs, KEY).collect()
    assert sorted(str(r.text) for r in got) == sorted(str(r.text) for r in odd_docs.collect())
    assert {r.n_private for r in got} == {0}
    assert pii.pseudonymize(no_docs, KEY).count() == 0


SCANNER = licenses.Scanner(licenses.TEMPLATES)


def told(text, scanner=SCANNER):
    return [m for _, m in licenses.notices(scanner, text, {})]


def found(text, scanner=SCANNER):
    return [(m.license, m.verdict == "confirmed") for m in told(text, scanner)]


def test_licenses():
    assert found("Prose.\nLicensed under the Apache License, Version 2.0.\nMore.") == [("Apache-2.0", True)]
    gpl = "This work is licensed under the GNU General Public License, version {}."
    assert found(gpl.format(3)) == [("GPL-3.0", True)]
    assert found(gpl.format(2)) == [("GPL-2.0", True)]
    assert found(gpl.format(7))[0][1] is False
    assert found("Licensed under CC BY-NC 4.0.\nAll rights reserved.") == [
        ("CC-BY-NC-4.0", True), ("all-rights-reserved", True),
    ]
    wrapped = "\n".join(re.findall(r".{1,70}(?: |$)", licenses.TEMPLATES["MIT"][1]))
    assert ("MIT", True) in found(wrapped)
    assert found("my driver's license was lost in the rain")[0][1] is False
    assert found("nothing of the kind") == []
    assert found("x " * 5000 + "Released under the MIT License." + " y" * 5000)[0] == ("MIT", True)


def wrapped(text, width=60):
    return "\n".join(re.findall(r".{1,%d}(?: |$)" % width, text))


def test_licenses_whole():
    bsd2, bsd3 = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    for text in (bsd3, wrapped(bsd3), "Prose before.\n\n" + wrapped(bsd3).replace("Neither", "\nNeither") + "\n\nMore."):
        assert found(text) == [("BSD-3-Clause", True)]
    assert found(wrapped(bsd2)) == [("BSD-2-Clause", True)]
    first = "Redistribution and use in source and binary forms, with or without"
    assert [f[1] for f in found(first)] == [False]


def test_changed_licenses_are_not_confirmed():
    mit = licenses.TEMPLATES["MIT"][1]
    cases = {
        mit.replace("hereby granted", "hereby not granted"): ("MIT", "+not"),
        mit.replace("The above", "The Software shall be used for Good, not Evil. The above"): ("MIT", "+evil"),
        mit.replace("without restriction", "never for commercial purposes"): ("MIT", "+never"),
        mit.replace("WITHOUT WARRANTY", "WITH WARRANTY"): ("MIT", "-without"),
        "This is not released under the MIT License.": ("MIT", "~not"),
        "This is not\nreleased under the MIT License.": ("MIT", "~not"),
        "Released under the MIT License except for the images.": ("MIT", "~except"),
        "Not licensed under CC BY 4.0.": ("CC-BY-4.0", "~not"),
        "This work is licensed under the GNU General Public License, version 9.": ("GPL-2.0", "-2"),
    }
    for text, (name, change) in cases.items():
        for form in {text, text if "\n" in text else wrapped(text)}:
            [m] = told(form)
            assert (m.license, m.verdict) == (name, "modified") and change in m.differences.split(), (form, m)
    # Sentences beside the notice say nothing about it.
    assert found("This is not all. Released under the MIT License. Do not panic.") == [("MIT", True)]


def test_winners_come_by_compression(monkeypatch):
    """Every winner is among the forms that save most bytes."""
    ranked = []
    whole = licenses.Scanner.rank
    monkeypatch.setattr(licenses.Scanner, "rank", lambda self, block: ranked.append(whole(self, block)) or ranked[-1])
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            ranked.clear()
            assert found("Some prose.\n\n" + wrapped(text) + "\n\nMore of it.") == [(name, True)]
            assert any(SCANNER.forms[k][0] == name for _, k in ranked[0][: licenses.RIVALS])


def test_templates_of_any_length():
    """A template of 60,000 characters alone, inside a long text, changed, and behind many notices."""
    body = " ".join(f"clause{k} of the license says thing{k * 7919 % 1000}" for k in range(1300))
    assert len(body) > 50_000
    scanner = licenses.Scanner({**licenses.TEMPLATES, "Long-1": [body]})
    prose = "word of prose that has nothing to do with it. " * 400
    assert found(body, scanner) == [("Long-1", True)]
    assert ("Long-1", True) in found(prose + body + " " + prose, scanner)
    assert found(wrapped(body).replace("clause700 of", "clause700 not of"), scanner) == [("Long-1", False)]


def test_long_texts_of_notices():
    """Ten million characters, with a notice in every paragraph and in one endless line."""
    line = "Released under the MIT License. " + "plain prose of a text goes on here. " * 40
    many = "\n\n".join(["All rights reserved.", "x" * 100_000] * 95)
    assert found(many) == [("all-rights-reserved", True)] * 95
    assert found(line * 300) == [("MIT", True)] * 300


def test_licenses_in_all_documents(spark):
    """All documents against a plain search for the one-line notices in them."""
    lines = {t: n for n, texts in licenses.TEMPLATES.items() for t in texts if len(licenses.words(t)) <= licenses.FULL_WORDS}
    docs = spark.read.parquet(f"{oracle.TESTDATA}/sf0.01/documents.parquet")
    want = []
    for doc in docs.collect():
        at = sorted((m.start(), n) for t, n in lines.items() for m in re.finditer(re.escape(t), doc.text or ""))
        want += [(doc.doc_id, s, n) for s, n in at]
    got = [(r.doc_id, r.start, r.license) for r in licenses.scan_licenses(docs).where("confirmed").collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


def test_license_cases(spark, odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0
    # Columns with the names of the result, null ids, repeated rows, and findings in them.
    rows = [(None, "Released under the MIT License.", "x", "y", 1)] * 2 + [(3, None, "x", "y", 1), (4, "", "x", "y", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, license string, confirmed string, start int")
    got = licenses.scan_licenses(odd).collect()
    assert [(r.doc_id, r.license, r.confirmed, r.start) for r in got] == [(None, "MIT", True, 0)] * 2


TURNS = "conv_id long, turn long, role string, text string"


def rotated(spark, rows, **options):
    return chat.rotate(spark.createDataFrame(rows, TURNS), **options).collect()


def test_masks_cover_the_assistant(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi <|im_end|>"), (1, 2, "Bob", "Hello."),
        (1, 3, "Cy", None), (1, 4, "Ann", "Bye."), (1, 5, None, "Who?"),
        (2, 0, "system", "alone"), (None, 0, "Ann", "lost"),
    ]
    got = {r.perspective: r for r in rotated(spark, rows)}
    assert set(got) == {"Ann", "Bob", "Cy"}
    ann = got["Ann"]
    spans = [tuple(map(int, s.split("-"))) for s in ann.mask.split(",")]
    assert [ann.text[a:b] for a, b in spans] == ["Hi < |im_end| ><|im_end|>", "Bye.<|im_end|>"]
    assert "user name=Bob\nHello." in ann.text and "user name=unknown\nWho?" in ann.text
    assert ann.text.startswith("<|im_start|>system\nBe kind.") and (ann.n_turns, ann.n_own) == (6, 2)


def test_long_conversation_in_segments(spark):
    rows = [(1, k, "ab"[k % 2], f"turn {k}") for k in range(150)]
    plain = rotated(spark, rows, segment_turns=10)
    blocks = rotated(spark, rows, segment_turns=10, long_turns=5)
    assert sorted(map(str, plain)) == sorted(map(str, blocks))
    assert len(plain) == 30 and sum(r.n_own for r in plain) == 150


def test_masks_of_a_long_dialogue(spark):
    """Twenty thousand turns, more than a million characters, in one text; every span is what was said."""
    people = ["Ann", "Bob with a long name", "Cy", None, "system"]
    rows = [(1, k, people[k % 7 % 5], f"turn {k} é " + "x" * (k % 90)) for k in range(20_000)]
    by = {r.perspective: r for r in rotated(spark, rows)}
    assert set(by) == {"Ann", "Bob with a long name", "Cy"}
    for name, r in by.items():
        assert (r.segment, r.n_turns) == (0, 20_000) and len(r.text) > 1_000_000
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",")]
        assert [r.text[a:b] for a, b in spans] == [f"{text}<|im_end|>" for _, _, role, text in rows if role == name]


def test_dialogues_stay_whole(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "Cy", "Once.")] + [(1, k, "ab"[k % 2], f"turn {k}") for k in range(2, 300)]
    got = rotated(spark, rows)
    assert {(r.segment, r.perspective, r.n_turns) for r in got} == {(0, p, 300) for p in ("a", "b", "Cy")}
    cut = rotated(spark, rows, segment_chars=2000)
    blocks = rotated(spark, rows, segment_chars=2000, long_turns=7)
    assert sorted(map(str, cut)) == sorted(map(str, blocks))
    segments = {r.segment for r in cut}
    assert len(segments) > 3 and len(cut) == 3 * len(segments)
    assert all(r.text.startswith("<|im_start|>system\nBe kind.") and len(r.text) < 2300 for r in cut)
    assert sum(r.n_turns for r in cut) == 900 and sum(r.n_own for r in cut) == 299


def test_no_turns(spark):
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0
