"""Fill-in-the-middle: texts cut at two line ends and written in another order.

Displacement scatter. The texts of a batch are one array of bytes. Cuts are found among the line
ends of all texts at once; each piece between cuts moves by one distance, so a difference array
with an entry where a piece begins, summed up, gives every byte its shift; one scatter writes all
outputs. Restoring is the inverse: the marks found in the outputs tell the pieces' lengths, the
same sums give every byte of the text its place in the output, and one gather reads it back.

Cuts, form and order depend on (seed, id) alone, so a repeated task gives the same rows.

Batches are worked on in blocks of some megabytes of text, a longer text alone; nothing is
shuffled.

Cases: null text counts as empty and an empty text stays plain, as does one that holds a mark; a
null id is read as an empty one; repeated rows are each handled alike; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setspan.llm.common import ship_package, text_of

MARKS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SEED = 7
FIM_PERCENT = 100  # of texts that are rearranged
SPM_PERCENT = 50  # of those, with the suffix first
BLOCK_BYTES = 4_000_000
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
# Pieces (0 prefix, 1 middle, 2 suffix) in the order of the output.
ORDERS = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
# Marks in the order of the output: of the pieces above.
MARK_OF = {0: 0, 1: 2, 2: 1}


def check_marks(marks: tuple[str, str, str]) -> list[np.ndarray]:
    """The marks as bytes. No mark may begin inside another, or a cut could make one up."""
    for mark in marks:
        inner = mark[1:-1]
        if len(mark) < 3 or mark[0] != "<" or mark[-1] != ">" or "<" in inner or ">" in inner:
            raise ValueError(f"a mark is <...> without further brackets, not {mark!r}")
    if len(set(marks)) < 3:
        raise ValueError("the marks must differ")
    return [np.frombuffer(m.encode(), np.uint8) for m in marks]


def find_mark(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where the mark begins. Neither mark nor line end can lie over the end of a text unseen:
    callers compare with the texts' own ends."""
    at = np.flatnonzero(data[: max(len(data) - len(mark) + 1, 0)] == mark[0])
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    return at


def first_inside(at: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For each span the first of ``at`` that lies in it with ``width`` bytes, or -1."""
    if not len(at):
        return np.full(len(begins), -1, np.int64)
    k = np.minimum(np.searchsorted(at, begins), len(at) - 1)
    fits = (at[k] >= begins) & (at[k] + width <= ends)
    return np.where(fits, at[k], -1)


def spread(begins: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """Every byte's shift, from the pieces' first bytes and their shifts.

    Pieces cover the bytes in order. Empty ones share their first byte with the next: what they
    add to the difference array there is taken back by it.
    """
    differences = np.zeros(n + 1, np.int64)
    np.add.at(differences, begins, np.diff(shifts, prepend=0))
    return np.cumsum(differences[:n])


def layout(pieces: np.ndarray, forms: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each piece in its output, offset of each mark), by rows; pieces are lengths."""
    offsets, marks = np.zeros((len(pieces), 3), np.int64), np.zeros((len(pieces), 3), np.int64)
    plain = forms == PLAIN
    offsets[plain] = np.cumsum(pieces[plain], axis=1) - pieces[plain]
    for form, order in ORDERS.items():
        rows = forms == form
        at = np.zeros(int(rows.sum()), np.int64)
        for piece in order:
            marks[rows, MARK_OF[piece]] = at
            at = at + widths[MARK_OF[piece]]
            offsets[rows, piece] = at
            at = at + pieces[rows, piece]
    return offsets, marks


def rearrange(
    data: np.ndarray, ends: np.ndarray, draws: np.ndarray, marks, fim_percent: int, spm_percent: int
):
    """(outputs, their ends, lines, forms, prefix and middle code points) of a block of texts.

    ``ends`` has a leading 0; ``draws`` are four integers a text.
    """
    begins, stops = ends[:-1], ends[1:]
    newlines = np.flatnonzero(data == 10)
    first = np.searchsorted(newlines, begins)
    count = np.searchsorted(newlines, stops) - first
    last = np.zeros(len(begins), np.uint8)
    filled = stops > begins
    last[filled] = data[stops[filled] - 1]
    lines = count + (filled & (last != 10))

    held = np.zeros(len(begins), bool)
    for mark in marks:
        held |= first_inside(find_mark(data, mark), begins, stops, len(mark)) >= 0
    forms = np.where(draws[:, 3] % 100 < spm_percent, SPM, PSM)
    forms[~filled | held | (draws[:, 2] % 100 >= fim_percent)] = PLAIN

    def cut(after: np.ndarray) -> np.ndarray:
        """Byte behind the first ``after`` lines of each text."""
        inner = np.clip(first + after - 1, 0, max(len(newlines) - 1, 0))
        behind = newlines[inner] + 1 if len(newlines) else stops
        return np.where(after == 0, begins, np.where(after > count, stops, behind))

    a, b = draws[:, 0] % (lines + 1), draws[:, 1] % (lines + 1)
    one, two = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before a byte
    chars = np.stack([points[one] - points[begins], points[two] - points[one]], axis=1)

    edges = np.stack([begins, one, two], axis=1)
    pieces = np.diff(np.concatenate((edges, stops[:, None]), axis=1), axis=1)
    widths = [len(m) for m in marks]
    offsets, places = layout(pieces, forms, widths)
    sizes = (stops - begins) + np.where(forms == PLAIN, 0, sum(widths))
    out_ends = np.concatenate(([0], np.cumsum(sizes)))
    goes = out_ends[:-1, None] + offsets
    out = np.empty(int(out_ends[-1]), np.uint8)
    out[np.arange(len(data)) + spread(edges.ravel(), (goes - edges).ravel(), len(data))] = data
    moved = forms != PLAIN
    for k, mark in enumerate(marks):
        at = (out_ends[:-1] + places[:, k])[moved]
        out[at[:, None] + np.arange(len(mark))] = mark
    return out, out_ends, lines, forms, chars


def put_back(out: np.ndarray, ends: np.ndarray, forms: np.ndarray, marks):
    """(texts, their ends) from outputs and forms alone."""
    begins, stops = ends[:-1], ends[1:]
    moved = forms != PLAIN
    widths = [len(m) for m in marks]
    at = np.stack(
        [first_inside(find_mark(out, m), begins, stops, len(m)) for m in marks], axis=1
    )
    if (at[moved] < 0).any():
        raise ValueError("an output that is not plain lacks a mark")
    pieces = np.zeros((len(begins), 3), np.int64)
    pieces[~moved, 0] = (stops - begins)[~moved]
    for form, order in ORDERS.items():
        rows = forms == form
        bounds = [at[rows, MARK_OF[p]] for p in order] + [stops[rows]]
        for k, piece in enumerate(order):
            pieces[rows, piece] = bounds[k + 1] - bounds[k] - widths[MARK_OF[piece]]
    offsets, _ = layout(pieces, forms, widths)
    text_ends = np.concatenate(([0], np.cumsum(pieces.sum(axis=1))))
    edges = text_ends[:-1, None] + np.cumsum(pieces, axis=1) - pieces
    comes = begins[:, None] + offsets
    n = int(text_ends[-1])
    return out[np.arange(n) + spread(edges.ravel(), (comes - edges).ravel(), n)], text_ends


def _blocks(column):
    """(first row, bytes, ends with a leading 0) of parts of a string column."""
    import pyarrow as pa

    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(ends, ends[row] + BLOCK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def _strings(data: np.ndarray, ends: np.ndarray):
    import pyarrow as pa

    wide = pa.LargeStringArray.from_buffers(
        len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)
    )
    return wide.cast(pa.string())


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit groups of the sha256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): n lines, and the text in its form."""
    found = check_marks(marks)
    ship_package(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(2 + k).to_numpy() for k in range(4)]
            for row, stop, data, ends in _blocks(batch.column(1)):
                draws = np.stack([c[row:stop] for c in columns], axis=1)
                out, out_ends, lines, forms, chars = rearrange(
                    data, ends, draws, found, fim_percent, spm_percent
                )
                none = forms == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, stop - row),
                        pa.array(lines.astype(np.int64)),
                        pa.array(FORMS).take(pa.array(forms.astype(np.int32))),
                        pa.array(chars[:, 0], mask=none),
                        pa.array(chars[:, 1], mask=none),
                        _strings(out, out_ends),
                    ],
                    names=["doc", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = T.StructType(
        [
            T.StructField("doc", docs.schema[id_col].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )
    doc = F.col(f"`{id_col}`")
    rows = docs.select(
        doc.alias("doc"),
        text_of(F.col(f"`{text_col}`")).alias("text"),
        *[c.alias(f"h{k}") for k, c in enumerate(_draws(doc, seed))],
    )
    return rows.mapInArrow(work, schema).withColumnRenamed("doc", id_col)


def restore(outputs: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``outputs`` (with ``form`` and ``output``) and the ``restored`` texts."""
    found = check_marks(marks)
    ship_package(outputs.sparkSession)
    form_at, output_at = outputs.columns.index("form"), outputs.columns.index("output")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            forms = np.array([FORMS.index(f) for f in batch.column(form_at).to_pylist()], np.int64)
            for row, stop, data, ends in _blocks(batch.column(output_at)):
                text, text_ends = put_back(data, ends, forms[row:stop], found)
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _strings(text, text_ends)], names=[*batch.schema.names, "restored"]
                )

    schema = T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())])
    return outputs.mapInArrow(work, schema)


def infill_report(restored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the cuts, and digests of the output and of the text rebuilt from it."""
    return restored.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
