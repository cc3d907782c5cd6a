"""License scans by conditional compression.

A candidate block, the paragraphs around licensing words, is compressed alone and with each
template as a raw zstandard dictionary; the bytes a template saves rank the templates. The best few
are aligned with the block word by word. The one that most of the block's words belong to wins, its
span is taken out, and what is left before and behind it is ranked again; where a whole block shows
nothing, its lines with licensing words are ranked one by one. Compression tells likely templates
apart in any layout, the words tell GPL 2 from GPL 3.

A winner is ``confirmed`` if it loses none of its words (of a template of over 25 words one in
fifty, and none that matters) and nothing that negates, limits or renumbers it was lost, added
inside its span or stands in the sentence around it. Otherwise it is ``modified``, with the
differences; what has too few words of any template is ``unknown``.

Each text is worked on by itself, whole: no shuffle, no state; only texts with a licensing word
leave the JVM. A null or empty text has no blocks; ids may be null; repeated rows are reported
alike; an empty table gives an empty result. Long paragraphs and lines are looked at in blocks that
overlap by more than the longest template, so a template of any length lies whole in one of them
and every licensing word of the text is looked at.
"""

from __future__ import annotations

import difflib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setspan.llm.common import ship_package

LONG_LINE = 400
AROUND = 200
RIVALS = 4
MIN_SHARED = 0.8  # share of a template's words that makes it a candidate
FULL_WORDS = 25  # templates of more words are whole texts
LOSE_ONE_OF = 50  # words of a whole text
GROW = 3000  # least characters of a paragraph or long line before and after a licensing word
BLOCK_ROOMS = 8  # a block's length in rooms of the longest template
LEVEL = 12

# Words that change what a notice says when they come or go.
MATTERS = frozenset(
    "not no non never nor neither none cannot without except excluding excluded exception unless only "
    "solely prohibited forbidden disallowed refused denied revoked must may provided however but instead "
    "formerly previously longer unlike if until commercial noncommercial subject limited isn aren wasn "
    "weren don doesn didn won wouldn shouldn can".split()
)
_SENTENCE_END = re.compile(r"[.!?;](?=\s|$)|\n\s*\n")

TRIGGER = (
    r"licen[sc]e|copyright|all rights reserved|permission is hereby|permission to use, copy"
    r"|redistribution and use|without warranty|creative commons|\bcc[ -]by\b|\bcc0\b|public domain|spdx"
)
_TRIGGER = re.compile(TRIGGER, re.I)
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. Redistributions "
    "in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)


def _cc(name: str, version: str) -> list[str]:
    return [
        f"Licensed under CC {name} {version}.",
        f"This work is licensed under a Creative Commons CC {name} {version} International License.",
    ]


def _gnu(kind: str, version: str) -> list[str]:
    return [
        f"This work is licensed under the GNU {kind} General Public License, version {version}.".replace("  ", " "),
        f"This program is free software: you can redistribute it and/or modify it under the terms of the "
        f"GNU {kind} General Public License as published by the Free Software Foundation, either version "
        f"{version} of the License, or (at your option) any later version.".replace("  ", " "),
    ]


# Names of the public license list and the usual words of their notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. "
        + _NO_WARRANTY,
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "LGPL-2.1": _gnu("Lesser", "2.1"),
    "LGPL-3.0": _gnu("Lesser", "3"),
    "AGPL-3.0": _gnu("Affero", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "CC-BY-4.0": _cc("BY", "4.0"),
    "CC-BY-SA-4.0": _cc("BY-SA", "4.0"),
    "CC-BY-NC-4.0": _cc("BY-NC", "4.0"),
    "CC-BY-ND-4.0": _cc("BY-ND", "4.0"),
    "CC0-1.0": [
        "CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and "
        "related or neighboring rights to this work."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved."],
}


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Match(NamedTuple):
    """A template in a stretch of text: where, which, bytes and words, and what follows from them."""

    start: int
    length: int
    license: str
    saved: float
    shared: float
    differences: str
    verdict: str


class Scanner:
    """The templates with their compressors, made once a worker."""

    def __init__(self, templates: dict[str, list[str]]):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.forms = []
        for name in sorted(templates):
            for text in templates[name]:
                data = zstandard.ZstdCompressionDict(
                    self._plain(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                )
                data.precompute_compress(level=LEVEL)
                with_form = zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False
                )
                self.forms.append((name, words(text), with_form))
        longest = max((len(t) for texts in templates.values() for t in texts), default=0)
        # Room for a template with some more words and other line breaks in it.
        self.room = max(GROW, longest + longest // 4 + AROUND)

    @staticmethod
    def _plain(text: str) -> bytes:
        return " ".join(text.lower().split()).encode("utf-8", "replace")

    def rank(self, block: str) -> list[tuple[int, int]]:
        """(saved bytes, form) of the forms, best first."""
        data = self._plain(block)
        self.size = len(self.alone.compress(data))
        saved = [(self.size - len(f.compress(data)), -k) for k, (_, _, f) in enumerate(self.forms)]
        return [(s, -k) for s, k in sorted(saved, reverse=True)]

    def match(self, block: str) -> Match:
        """The winner in a stretch of text."""
        spans = [(m.start(), m.end()) for m in _WORD.finditer(block)]
        said = [block[a:b].lower() for a, b in spans]
        best = None
        for saved, k in self.rank(block)[:RIVALS]:
            name, form, _ = self.forms[k]
            found = self.aligned(form, said, spans, block)
            if found is None:
                continue
            order, start, end, shared, told, verdict = found
            share = saved / max(1, self.size)
            order = (verdict != "unknown", *order, saved, -k)
            if best is None or order > best[0]:
                best = (order, Match(start, end - start, name, share, shared, told, verdict))
        if best is None:
            saved, k = self.rank(block)[0]
            return Match(0, len(block), self.forms[k][0], saved / max(1, self.size), 0.0, "", "unknown")
        return best[1]

    @staticmethod
    def aligned(form: list[str], said: list[str], spans: list[tuple[int, int]], block: str) -> tuple | None:
        """(order, start, end, shared, differences, verdict) of a template in a block."""
        compare = difflib.SequenceMatcher(None, form, said, autojunk=False)
        same = [m for m in compare.get_matching_blocks() if m.size]
        if not same:
            return None
        # Words met far away are not part of the notice: neighbours join the longest stretch as
        # long as they are large for their distance.
        low = high = max(range(len(same)), key=lambda i: same[i].size)
        while low and same[low].b - same[low - 1].b - same[low - 1].size <= 8 + 2 * same[low - 1].size:
            low -= 1
        while high + 1 < len(same) and same[high + 1].b - same[high].b - same[high].size <= 8 + 2 * same[high + 1].size:
            high += 1
        same = same[low : high + 1]
        first, last = same[0].b, same[-1].b + same[-1].size
        matched = sum(m.size for m in same)
        kept = {i for m in same for i in range(m.a, m.a + m.size)}
        theirs = {i for m in same for i in range(m.b, m.b + m.size)}
        lost = [w for i, w in enumerate(form) if i not in kept]
        added = [said[i] for i in range(first, last) if i not in theirs]
        shared = matched / len(form)
        start, end = spans[first][0], spans[last - 1][1]
        # The rest of the sentences that the span begins and ends in.
        before = 0
        for m in _SENTENCE_END.finditer(block, 0, start):
            before = m.end()
        after = _SENTENCE_END.search(block, end)
        around = words(block[before:start]) + words(block[end : after.start() if after else len(block)])
        heavy = [w for w in lost + added if w in MATTERS or w[0].isdigit()]
        limits = [w for w in around if w in MATTERS]
        few = len(lost) <= (len(form) // LOSE_ONE_OF if len(form) > FULL_WORDS else 0)
        if shared < MIN_SHARED:
            verdict = "unknown"
        elif few and not heavy and not limits:
            verdict = "confirmed"
        else:
            verdict = "modified"
        told = " ".join([f"-{w}" for w in lost] + [f"+{w}" for w in added] + [f"~{w}" for w in limits])
        # More of a longer text is worth more than fewer words added to a shorter one.
        return (matched - 2 * len(lost), -len(added), verdict == "confirmed"), start, end, shared, told, verdict


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines with a licensing word; of a long line what is around the words."""
    out, at = [], 0
    for line in text.split("\n"):
        if len(line) <= LONG_LINE:
            if _TRIGGER.search(line):
                out.append((at, at + len(line)))
        else:
            new = True
            for m in _TRIGGER.finditer(line):
                low, high = at + max(0, m.start() - AROUND), at + min(len(line), m.end() + AROUND)
                if not new and low <= out[-1][1]:
                    out[-1] = (out[-1][0], high)
                else:
                    out.append((low, high))
                new = False
        at += len(line) + 1
    return out


def findings(scanner: Scanner, block: str) -> list[Match]:
    """The notices in a block, and if there is none, what the lines with licensing words are like."""
    found, rest = [], [(0, len(block))]
    while rest:
        low, high = rest.pop()
        part = block[low:high]
        if not _TRIGGER.search(part):
            continue
        match = scanner.match(part)
        # A short notice with other words may be another one, which its line alone tells better.
        short = len(words(part[match.start : match.start + match.length])) <= FULL_WORDS
        lines = []
        if match.verdict == "unknown" or short and match.shared < 1:
            for a, b in pieces(part):
                line = scanner.match(part[a:b])
                if line.verdict != "unknown":
                    lines.append(line._replace(start=low + a + line.start))
        if lines:
            found += lines
        elif match.verdict != "unknown":
            found.append(match._replace(start=low + match.start))
            rest += [(low, low + match.start), (low + match.start + match.length, high)]
    if found:
        return sorted(set(found))
    at = pieces(block)
    low, high = (at[0][0], at[-1][1]) if at else (0, len(block))
    return [scanner.match(block[low:high])._replace(start=low, length=high - low, verdict="unknown")]


def blocks(text: str, room: int = GROW) -> list[tuple[int, str]]:
    """(start, block): the paragraphs around licensing words, one line between them allowed.

    ``room`` is more than the longest template; a block that would be too long begins anew that
    much before the end of the last one.
    """
    out: list[list[int]] = []
    for low, high in pieces(text):
        if out and high <= out[-1][1]:
            continue
        before = max(0, low - room)
        blank = text.rfind("\n\n", before, low + 1)
        start = max(before, blank + 2 if blank >= 0 else before)
        after = min(len(text), high + room)
        blank = text.find("\n\n", max(0, high - 1), after)
        end = blank if blank >= high else after
        near = out and start <= out[-1][1] + LONG_LINE and text.count("\n", out[-1][1], max(start, out[-1][1])) <= 2
        if near and end - out[-1][0] <= BLOCK_ROOMS * room:
            out[-1][1] = max(end, out[-1][1])
        else:
            if out:
                start = min(low, max(start, out[-1][1] - room))
            out.append([start, end])
    return [(low, text[low:high]) for low, high in out]


def notices(scanner: Scanner, text: str, seen: dict[str, list[Match]]) -> list[tuple[int, Match]]:
    """(block, match) of a whole text. ``seen`` keeps what blocks gave: notices repeat.

    Where blocks overlap a notice is found twice, or in part by one of them: it is told once, and
    what lies in a better one is left out.
    """
    told: list[tuple[int, Match]] = []
    for no, (start, block) in enumerate(blocks(text, scanner.room)):
        if block not in seen:
            if len(seen) > 4096:
                seen.clear()
            seen[block] = findings(scanner, block)
        for m in seen[block]:
            m = m._replace(start=start + m.start)
            meets = [o for o in told if o[1].start < m.start + m.length and m.start < o[1].start + o[1].length]
            if all(_worth(m) > _worth(o[1]) for o in meets):
                told = [o for o in told if o not in meets] + [(no, m)]
    return sorted(told, key=lambda o: (o[1].start, o[0]))


def _worth(m: Match) -> tuple:
    return ("unknown", "modified", "confirmed").index(m.verdict), m.shared, m.length


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per notice or unknown block: doc_id, block, start, length, license, saved (share of
    bytes), shared (share of the template's words), differences (-lost, +added, ~around), confirmed
    and verdict."""
    ship_package(docs.sparkSession)
    wanted = templates or TEMPLATES

    def work(batches):
        import pyarrow as pa

        scanner = Scanner(wanted)
        seen: dict[str, list[Match]] = {}  # the last few thousand blocks
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for no, m in notices(scanner, text, seen):
                    rows.append(k)
                    out.append((no, *m[:6], m.verdict == "confirmed", m.verdict))
            kinds = (
                pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string(),
                pa.bool_(), pa.string(),
            )
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=[f.name for f in schema.fields],
            )

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("block", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("license", T.StringType()),
            T.StructField("saved", T.DoubleType()),
            T.StructField("shared", T.DoubleType()),
            T.StructField("differences", T.StringType()),
            T.StructField("confirmed", T.BooleanType()),
            T.StructField("verdict", T.StringType()),
        ]
    )
    text = F.col(f"`{text_col}`").cast("string")
    candidates = docs.where(text.rlike(f"(?i){TRIGGER}"))
    return candidates.select(F.col(f"`{id_col}`"), text.alias("text")).mapInArrow(work, schema)
