"""Benchmark decontamination: broadcast n-gram hashes, scan token windows, verify, decide.

The n-grams of the benchmark are a table of (hash, length, words). Each document's windows of all
lengths are hashed inside one generated stage, looked up, and compared word by word at a hit, so a
hash collision never counts. Only hits are shuffled. The table is broadcast if a count shows at most
``BROADCAST_GRAMS`` rows; beyond that windows are shuffled as (document, place, hash), without
words, and those that meet a hash are verified against the text, read again.

The items of an n-gram, which may be any number, are looked up after the hits, once for all documents
with the same set of found n-grams, so a prompt that all items share is never sent along with it.

Rows equal in id and text are judged alike and all returned. Null text has no words and no hits;
items without words are never found; item ids may repeat (they count once) and null ones are left
out of the list of items though their windows count. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.llm.common import (
    as_documents,
    ascii_lower,
    hash_pair,
    identified,
    row_identity,
    split_words,
    stage,
    text_of,
)

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # on lower-cased text: all of ASCII but digits and a-z
GRAM = 13
HIT_SHARE = 20  # contaminated if at least one word in so many is hit
BROADCAST_GRAMS = 500_000


def token_words(text: Column) -> Column:
    return split_words(ascii_lower(text_of(text)), GAPS)


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """(hash, other, length, gram, item): the windows of each item, with two hashes."""
    last = F.greatest(F.size("words") - F.lit(gram), F.lit(0))
    windows = (
        items.select(
            F.col(f"`{id_col}`").cast("string").alias("item"), token_words(F.col(f"`{text_col}`")).alias("words")
        )
        .where(F.size("words") > 0)
        .select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item", F.slice("words", F.col("at") + 1, F.lit(gram)).alias("gram"))
    )
    own, other = hash_pair(F.col("gram"))
    return windows.select(own.alias("hash"), other.alias("other"), F.size("gram").alias("length"), "gram", "item")


def window_hashes(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], gram: int) -> DataFrame:
    """(d1, d2, words, at, length, hash): every window of the given lengths, in one scan."""
    d1, d2 = row_identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    words = docs.select(
        d1.alias("d1"), d2.alias("d2"), token_words(F.col(f"`{text_col}`")).alias("words")
    ).where(F.size("words") >= lengths[0])
    places = words.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.lit(lengths[0]))).alias("at"))
    # Word by word, without making an array of each window, for the length that nearly all have.
    whole = F.xxhash64(*[F.get("words", F.col("at") + F.lit(k)) for k in range(gram)])
    if lengths == [gram]:
        return places.select("*", F.lit(gram).alias("length"), whole.alias("hash"))
    sized = places.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    return sized.where(F.col("at") + F.col("length") <= F.size("words")).select(
        "*", F.when(F.col("length") == gram, whole).otherwise(F.xxhash64(_window())).alias("hash")
    )


def _window() -> Column:
    return F.slice("words", F.col("at") + 1, F.col("length"))


def _same_words() -> Column:
    """Whether the window is the n-gram; as an equation it would become a join key of all windows."""
    return (_window() <= F.col("gram")) & (_window() >= F.col("gram"))


def window_hits(
    docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, lengths: list[int], gram: int, small: bool
) -> DataFrame:
    """(d1, d2, at, length, hash, other): verified windows, over whole texts."""
    windows = window_hashes(docs, id_col, text_col, lengths, gram)
    wanted = grams.select(F.col("hash").alias("gram_hash"), "other", "gram")
    if small:
        wanted = F.broadcast(wanted)
    else:
        met = windows.select("d1", "d2", "at", "length", "hash").join(grams.select("hash"), "hash", "left_semi")
        places = met.groupBy("d1", "d2").agg(F.collect_set(F.struct("at", "length", "hash")).alias("places"))
        d1, d2 = row_identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
        texts = docs.select(d1.alias("d1"), d2.alias("d2"), F.col(f"`{text_col}`").alias("text"))
        windows = texts.join(places, ["d1", "d2"]).select(
            "d1", "d2", token_words(F.col("text")).alias("words"), "places"
        ).select("d1", "d2", F.inline("places"), "words").select(
            "d1", "d2", "at", "length", "hash", _window().alias("said")
        )
    same = _same_words() if small else (F.col("said") <= F.col("gram")) & (F.col("said") >= F.col("gram"))
    found = windows.join(wanted, (F.col("hash") == F.col("gram_hash")) & same)
    return found.select("d1", "d2", "at", "length", "hash", "other")


def _covered(spans: Column) -> Column:
    """Words covered by the spans (at, length), which are sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("end"))

    def add(acc, span):
        end = (span["at"] + span["length"]).cast("long")
        fresh = F.greatest(end - F.greatest(span["at"].cast("long"), acc["end"]), F.lit(0).cast("long"))
        return F.struct(
            (acc["sum"] + fresh).alias("sum"), F.greatest(end, acc["end"]).alias("end")
        )

    return F.aggregate(spans, zero, add, lambda acc: acc["sum"])


def with_items(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """(d1, d2, spans, items): the hits of each document, and the items found, sorted as text."""
    found = F.sort_array(F.collect_set(F.struct("hash", "other")))
    by_doc = hits.groupBy("d1", "d2").agg(
        F.sort_array(F.collect_set(F.struct("at", "length"))).alias("spans"), found.alias("found")
    )
    p1, p2 = hash_pair(F.col("found"))
    by_doc = stage(by_doc.withColumns({"p1": p1, "p2": p2}))
    sets = by_doc.dropDuplicates(["p1", "p2"]).select("p1", "p2", F.inline("found"))
    owners = parts.where(F.col("item").isNotNull()).select("hash", "other", "item").distinct()
    items = (
        sets.join(owners, ["hash", "other"])
        .groupBy("p1", "p2")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return by_doc.join(items, ["p1", "p2"], "left").select("d1", "d2", "spans", "items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    gram: int = GRAM,
    share: int = HIT_SHARE,
) -> DataFrame:
    """One row per document: d1, d2, words, hit words, items found, spans, verdict."""
    parts = stage(benchmark_windows(benchmark, item_col, item_text_col, gram))
    grams = stage(parts.groupBy("hash", "other", "length").agg(F.min("gram").alias("gram")))
    # At most ``gram`` numbers.
    counts = {r["length"]: r["count"] for r in grams.groupBy("length").count().collect()}
    d1, d2 = row_identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        d1.alias("d1"),
        d2.alias("d2"),
        F.size(token_words(F.col(f"`{text_col}`"))).cast("long").alias("n_words"),
    )
    if not counts:
        empty = "array<struct<at:int,length:int>>"
        spans, items = F.expr(f"cast(array() as {empty})"), F.expr("cast(array() as array<string>)")
        judged = rows.withColumns({"spans": spans, "items": items})
    else:
        small = sum(counts.values()) <= BROADCAST_GRAMS
        hits = window_hits(docs, grams, id_col, text_col, sorted(counts), gram, small)
        judged = rows.join(with_items(hits, parts), ["d1", "d2"], "left")
    zero = F.lit(0).cast("long")
    counted = judged.select(
        "doc",
        "d1",
        "d2",
        "n_words",
        F.coalesce(_covered(F.col("spans")), zero).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_list"),
        "spans",
    ).withColumn("n_items", F.greatest("n_items", zero))
    return counted.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The counts, the digest of the found item ids and the verdict of every document."""
    return contamination(docs, benchmark, id_col, **names).select(
        F.col("doc").alias(id_col),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.col("item_list").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without contaminated documents; what stays, stays as it is."""
    bad = (
        contamination(docs, benchmark, id_col, text_col, **names)
        .where("contaminated")
        .select("d1", "d2")
        .distinct()
    )
    rows = identified(docs, id_col, text_col)
    return as_documents(docs, rows.join(bad, ["d1", "d2"], "left_anti"))
