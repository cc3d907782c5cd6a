"""Best-fit packing of tokenized documents into sequences of a fixed length.

Tokens: the tokenizer drops white space and never joins across it, so a text's ids are those of
its words in a row. Each Python worker keeps the ids of words it has met, up to ``CACHE_WORDS``
twice, and asks the tokenizer for the others alone. Texts go through in Arrow batches
and leave as (length, crc) of their pieces; ids are never stored.

Packing: bounded-space online best-fit. At most ``open_bins`` sequences are open; a bitset has
bit f set while some open one has f tokens free. A piece goes where the least space fits; if none
fits, a new sequence opens, and beyond the bound the fullest closes first. The pieces are dealt at
random to as many tasks as their count asks for, in an order fixed by their numbers, so a repeated
task packs alike.

Null text counts as empty: the end token alone. Ids may be null or repeat; each row is packed by
itself. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setspan.llm.common import ship_package, stage

LENGTH = 2048
OPEN_BINS = 256
TASK_PIECES = 50_000  # pieces of one packing task
CACHE_WORDS = 300_000  # words of each generation a worker keeps the ids of, some 50 MB
TOKENIZER = "word_bpe_49k.json"
END = b"\0\0\0\0"  # id 0 after each document

# Words of Latin-1 letters and marks after them: no combining characters, no contractions, and
# lower-casing letter by letter. The tokenizer cuts such a word before the marks.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*$%&#|]*)")

_workers: dict[str | None, WordIds] = {}


class WordIds(dict):
    """The ids of the words a worker has met, as little-endian 32-bit bytes.

    Two generations bound the memory: when the new one is full it becomes the old one, and words
    found there move over again. Plain words go to the tokenizer's model directly, in the form its
    normalizer and byte-level step give them; all others through the whole tokenizer.
    """

    def __init__(self, path: str | None, limit: int = CACHE_WORDS):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100)]
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        self.limit, self.old, self.parts = limit, {}, {}

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= self.limit:
                self.parts = {}
            found = self.model.tokenize(text.translate(self.level))
            ids = self.parts[text] = array("I", [t.id for t in found]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            plain = PLAIN.fullmatch(word)
            if plain:
                letters, marks = plain.groups()
                ids = self.part(letters.lower()) + (self.part(marks) if marks else b"")
            else:
                found = self.tokenizer.encode(word, add_special_tokens=False).ids
                ids = array("I", found).tobytes()
        self[word] = ids
        return ids


def encode(texts: list[str | None], path: str | None) -> Iterator[bytes]:
    """The ids of each text and the end token, four bytes each."""
    known = _workers.get(path)
    if known is None:
        known = _workers[path] = WordIds(path)
    for text in texts:
        words = text.replace("\n", " ").split(" ") if text else []
        yield b"".join(map(known.__getitem__, words)) + END


def token_pieces(docs: DataFrame, id_col: str, text_col: str, length: int, path: str | None) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, number): the documents cut at ``length`` tokens."""

    def cut(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            row, piece, size, crc = [], [], [], []
            for k, ids in enumerate(encode(batch.column(1).to_pylist(), path)):
                for p, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    row.append(k)
                    piece.append(p)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            n = len(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array([p * length for p in piece], pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(range(number, number + n), pa.int64()),
                ],
                names=["doc", "piece", "start", "length", "ids_crc32", "number"],
            )
            number += n

    schema = T.StructType(
        [
            T.StructField("doc", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "number")],
        ]
    )
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    return texts.mapInArrow(cut, schema)


class OpenBins:
    """The open sequences: a bitset over free space, and per free space the sequences that have it."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.bits, self.count, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(length + 1)]

    def _put(self, free: int, bin_no: int) -> None:
        if free:
            self.at[free].append(bin_no)
            self.bits |= 1 << free
            self.count += 1

    def _take(self, free: int) -> int:
        stack = self.at[free]
        bin_no = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_no

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_no = self._take(free)
        else:
            free, bin_no = self.length, self.made
            self.made += 1
            if self.count >= self.limit and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        self._put(free - size, bin_no)
        return bin_no, self.length - free


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    task_pieces: int = TASK_PIECES,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    ship_package(docs.sparkSession)
    pieces = stage(token_pieces(docs, id_col, text_col, length, tokenizer_path))
    tasks = max(1, -(-pieces.count() // task_pieces))

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bins = OpenBins(length, open_bins)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            places = [bins.place(size) for size in batch.column("length").to_pylist()]
            arrays = [batch.column(k) for k in range(5)]
            arrays.append(pa.array([base + b for b, _ in places], pa.int64()))
            arrays.append(pa.array([o for _, o in places], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                arrays, names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    fields = [*pieces.schema.fields[:5]]
    fields += [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    dealt = pieces.repartition(tasks, "number").sortWithinPartitions(F.xxhash64("number"), "number")
    return dealt.mapInArrow(place, T.StructType(fields)).withColumnRenamed("doc", id_col)
