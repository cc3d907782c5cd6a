"""Periodic runs of words inside documents, and texts with all but the first period taken out.

Descending-LCP Kruskal. The suffixes of a text are sorted by doubling, as far as they share enough
words to matter, and neighbours are united in the order of decreasing common prefix. A class keeps
its positions in order; when two classes meet at common prefix l, the positions that become
neighbours there are looked at: two at distance d <= l with the same words before them neither
start nor extend anything, two with different words before them start a run of period d and
length d + l. The smallest period is always found this way: were there a smaller one, positions
between the two would have been in the class before. Nothing else is enumerated, so a text of n
words costs O(n log^2 n) at most whatever it repeats.

A run of ``min_periods`` periods and ``min_words`` words has two positions a period apart that
share at least ``least_shared`` words, so shorter common prefixes are never sorted.

Texts are taken in groups of some ten thousand words, a longer text alone; nothing is shuffled.
Words of different texts get different codes, so texts never mix.

Cases: null and blank texts have no words and no runs, and collapse to the empty text; repeated
rows are each handled alike; ids are not looked at and may be null; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setspan.llm.common import ship_package, split_words, text_of

MIN_WORDS = 24
MIN_PERIODS = 3
GROUP_WORDS = 50_000  # words worked on at a time, or one text if it is longer
BLOCK = 512  # positions of a class kept in one list


def least_shared(min_words: int, min_periods: int) -> int:
    """The fewest words that two positions one period apart share in any run looked for."""
    return min(
        max((min_periods - 1) * q, min_words - q, 1) for q in range(1, max(min_words, 2))
    )


def repeated_places(codes: np.ndarray, levels: int) -> np.ndarray:
    """Positions whose next 2**levels words occur again; the sets shrink from level to level."""
    n = len(codes)
    ranks = codes
    at = np.flatnonzero(np.bincount(codes)[codes] > 1)
    for level in range(levels):
        step = 1 << level
        alive = np.zeros(n, bool)
        alive[at] = True
        at = at[at + step < n]
        at = at[alive[at + step]]
        if not len(at):
            return at
        key = ranks[at] * n + ranks[at + step]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        twice = (np.bincount(group) > 1)[group]
        at, group = at[order[twice]], group[twice]
        ranks = np.zeros(n, np.int64)
        ranks[at] = group
        at = np.sort(at)
    return at


def first_order(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For each position the number of positions that are smaller by their next ``width`` words."""
    per = max(1, 62 // int(codes.max() + 2).bit_length())
    base = int(codes.max() + 2)
    padded = np.concatenate((codes + 1, np.zeros(width + per, np.int64)))
    keys = []
    for k in range(0, width, per):
        key = np.zeros(len(at), np.int64)
        for j in range(k, min(k + per, width)):
            key = key * base + padded[at + j]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    differs = np.zeros(len(at), bool)
    differs[0] = True
    for key in keys:
        key = key[order]
        differs[1:] |= key[1:] != key[:-1]
    slots = np.arange(len(at))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.maximum.accumulate(np.where(differs, slots, 0))
    return rank


def suffix_order(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that share ``least`` words with another in suffix order, and the words each shares
    with the next one (0 where it is fewer than ``least``)."""
    n, level = len(codes), least.bit_length() - 1
    width = 1 << level
    places = repeated_places(codes, level)
    if not len(places):
        return places, places
    # What follows a repeated stretch is compared too, where doubling looks behind the stretch.
    ends = places[~np.isin(places + 1, places)]
    around = (ends[:, None] + np.arange(1, width + 1)).ravel()
    beyond = np.setdiff1d(around[around < n], places)
    known = np.concatenate((places, beyond))
    order = np.full(n + 1, -1, np.int64)  # the last one stands for all behind the end
    order[known] = first_order(codes, known, width)
    inside = np.zeros(n + 1, bool)
    inside[places] = True
    levels, step, tied = [], width, places
    while len(tied):
        levels.append(order.astype(np.int32))
        after = order[np.minimum(tied + step, n)]
        rank = order[tied]
        by = np.lexsort((after, rank))
        tied, rank, after = tied[by], rank[by], after[by]
        slots = np.arange(len(tied))
        group = np.concatenate(([True], rank[1:] != rank[:-1]))
        new = group.copy()
        new[1:] |= after[1:] != after[:-1]
        start = np.maximum.accumulate(np.where(group, slots, 0))
        mine = np.maximum.accumulate(np.where(new, slots, 0))
        order[tied] = rank + mine - start
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2

    ranked = places[np.argsort(order[places])]
    left, right = ranked[:-1], ranked[1:]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        a, b = rank[np.minimum(left + shared, n)], rank[np.minimum(right + shared, n)]
        shared += np.where((a == b) & (a >= 0), width << k, 0)
    padded = np.append(codes, -1)
    going = np.ones(len(left), bool)
    for _ in range(width - 1):
        i, j = np.minimum(left + shared, n), np.minimum(right + shared, n)
        going &= (padded[i] == padded[j]) & (padded[i] >= 0)
        if not going.any():
            break
        shared += going
    return ranked, np.where(shared >= least, shared, 0)


class Places:
    """Positions in order, in lists of bounded length, so that adding one stays cheap."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int, int]:
        """Take it in; its neighbours, -1 where there is none."""
        b = max(bisect_right(self.lows, place) - 1, 0)
        block = self.blocks[b]
        k = bisect_left(block, place)
        before = block[k - 1] if k else (self.blocks[b - 1][-1] if b else -1)
        if k < len(block):
            after = block[k]
        else:
            after = self.lows[b + 1] if b + 1 < len(self.lows) else -1
        block.insert(k, place)
        self.size += 1
        if not k:
            self.lows[b] = place
        if len(block) > 2 * BLOCK:
            self.blocks.insert(b + 1, block[BLOCK:])
            self.lows.insert(b + 1, block[BLOCK])
            del block[BLOCK:]
        return before, after


def unite(large: Places, small) -> list[tuple[int, int]]:
    """Take the positions of ``small`` into ``large``; the pairs that are neighbours from now on."""
    pairs, last, waits = [], -1, -1  # ``waits``: what stands behind the last one taken in
    for place in small:
        if waits >= 0 and waits < place:
            pairs.append((last, waits))
        before, waits = large.add(place)
        if before >= 0 and before != last:
            pairs.append((before, place))
        last = place
    if waits >= 0:
        pairs.append((last, waits))
    return pairs


def find_runs(codes: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run."""
    places, shared = suffix_order(codes, least_shared(min_words, min_periods))
    slots = np.flatnonzero(shared)
    if not len(slots):
        return []
    slots = slots[np.argsort(-shared[slots], kind="stable")]
    place, word = places.tolist(), codes.tolist()
    root = list(range(len(place)))
    classes: dict[int, Places] = {}

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    found = []
    for slot, common in zip(slots.tolist(), shared[slots].tolist()):
        a, b = top(slot), top(slot + 1)
        large, small = classes.pop(a, None), classes.pop(b, None)
        if small is not None and (large is None or large.size < small.size):
            a, b, large, small = b, a, small, large
        root[b] = a
        if large is None:
            large = Places(place[a])
        classes[a] = large
        for p, r in unite(large, small or (place[b],)):
            d = r - p
            if (
                d * (min_periods - 1) <= common
                and d + common >= min_words
                and (p == 0 or word[p - 1] != word[r - 1])
            ):
                found.append((p, d + common, d))
    return found


def collapse_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """(id, n_words, runs, collapsed): every run of each text, and its words without repeats.

    ``runs`` are (start, length, period) by start and period. A word goes if some run has it after
    its first period; ``collapsed`` joins the others by one space. ``min_periods`` is 2 or more.
    """
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    ship_package(docs.sparkSession)

    def grouped(texts: list[str]):
        """Groups of texts' words."""
        group, size = [], 0
        for text in texts:
            words = text.encode().split()  # bytes: the six white spaces alone
            if group and size + len(words) > GROUP_WORDS:
                yield group
                group, size = [], 0
            group.append(words)
            size += len(words)
        yield group

    def handled(group: list[list[bytes]]):
        codes, starts, base = [], [0], 0
        for words in group:
            known: dict[bytes, int] = {}
            codes.extend([known.setdefault(w, base + len(known)) for w in words])
            base += len(known)
            starts.append(len(codes))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in group]
        if codes:
            for start, length, period in find_runs(np.array(codes, np.int64), min_words, min_periods):
                k = bisect_right(starts, start) - 1
                runs[k].append((start - starts[k], length, period))
        for words, mine in zip(group, runs):
            mine.sort(key=lambda r: (r[0], r[2]))
            kept = words
            if mine:
                goes = np.zeros(len(words) + 1, np.int64)
                for start, length, period in mine:
                    goes[start + period] += 1
                    goes[start + length] -= 1
                kept = [words[i] for i in np.flatnonzero(np.cumsum(goes[:-1]) == 0).tolist()]
            yield len(words), mine, b" ".join(kept).decode()

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, lists, texts = [], [], []
            for group in grouped(batch.column(1).to_pylist()):
                for n, mine, text in handled(group):
                    sizes.append(n)
                    lists.append(mine)
                    texts.append(text)
            flat = np.array([r for mine in lists for r in mine], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, lists)])
            rows = pa.StructArray.from_arrays(
                [pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows),
                    pa.array(texts, pa.string()),
                ],
                names=["doc", "n_words", "runs", "collapsed"],
            )

    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType(
        [
            T.StructField("doc", docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc"), text_of(F.col(f"`{text_col}`")).alias("text")
    )
    return texts.mapInArrow(work, schema).withColumnRenamed("doc", id_col)


def strongest(runs: Column) -> Column:
    """The run of most periods, compared exactly; of equals the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best, run):
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, none, better)


def run_report(collapsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: how many runs, the strongest, and digests of the runs and of the text left."""
    lines = F.transform(
        "runs",
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    best = collapsed.withColumn("best", strongest(F.col("runs")))
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text): a tenth of the texts, told by the checksum of their ids, end in a periodic tail.

    From word a on they repeat p of their words, with a and p from the same checksum.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")).alias("h"),
    ).withColumn("words", F.when(F.col("h") % 10 == 0, split_words(text_of(F.col("text")))))
    placed = (
        rows.withColumn("n", F.size("words"))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.expr("if(n > 0, int(g % n), 0)"))
        .withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    )
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)")
    planted = F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")
    return placed.select(id_col, F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
