"""Mixing sources to target weights by weighted sampling without replacement.

Targets: the sources share a budget of words by their weights; a source that would come above
``most`` times its own size stops there and the rest is shared anew. Sources sorted by limit over
weight stop in that order, so running sums of limits and weights give the final level at once.

Epochs: a source's target holds so many complete epochs, each of all its documents. What is left
is filled by Efraimidis-Spirakis sampling: a document's key is an exponential draw divided by its
quality weight, documents are sorted by it within their source, and running sums of their words
are compared with the words that are left. The document at the border is taken in part, its
first words, so that the words taken from a source are its target, rounded down.

Only (source, key, identity, size) of the documents are written and sorted, never texts. They are
range-partitioned by (source, key) and summed inside blocks, with what the blocks before hold
added, so a source of any size is spread over many tasks. Draws are digests of (seed, id, text):
a repeated task or run gives the same rows.

Cases: null text has no words and is taken with 0 words; a source without words has target 0; a
null source is one source of its own, the last one; rows equal in source, id and text are taken
one after the other, each by itself; equal keys are ordered by id, null first, and by the text's
digest; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setspan.llm.common import SPACES, split_words, stage, text_of

WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)  # words of the mix for each word there is
MOST = 2  # times that a document may be taken
BLOCK_ROWS = 1_000_000  # documents of a block
SEED = "mix"
DIGITS = 13  # hexadecimal digits of a draw: 52 bits

NAMED = ["source", "unnamed"]  # null sources are told by the second


def word_count(text: Column) -> Column:
    """Number of words, without making an array of them where none has several spaces."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), SPACES)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(words)).otherwise(0).cast("long")


def mark_quality(text: Column) -> Column:
    """A weight of documents: 1 for plain prose, down to 1/21 for marks alone."""
    bare = F.translate(text, "#*$%&|<>{}[]=_~^\\", "")
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    return 1.0 / (1.0 + 20.0 * (F.length(text) - F.length(bare)) / length)


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """An exponential draw of rate ``weight``: the smallest keys are a weighted sample."""
    spelled = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text.cast("binary")))
    drawn = F.conv(F.substring(F.sha2(spelled.cast("binary"), 256), 1, DIGITS), 16, 10).cast("double")
    return -F.ln((drawn + 0.5) / float(16**DIGITS)) / weight


def ranged_sums(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    measures: Sequence[str],
    blocks: int,
    groups: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with ``before_<measure>``: sums over the rows before in their group of ``keys``.

    Rows are range-partitioned by group and order and numbered once; a block holds any part of
    any groups, so no group is too large for a task. The columns of ``groups`` (one row a group)
    come with the blocks' sums, so they are not joined by a group that may hold most rows either.
    """
    first = [F.col(k).asc_nulls_first() for k in keys]
    ranged = stage(
        rows.repartitionByRange(blocks, *first, *order).withColumn("block", F.spark_partition_id())
    )
    inside = (
        Window.partitionBy("block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row for each block and group in it.
    totals = ranged.groupBy("block", *keys).agg(*[F.sum(m).alias(f"sum_{m}") for m in measures])
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "block", *keys, *[F.coalesce(F.sum(f"sum_{m}").over(earlier), F.lit(0)).alias(f"off_{m}") for m in measures]
    )
    if groups is not None:
        offsets = offsets.join(groups, list(keys))
    more = [c for c in (groups.columns if groups is not None else []) if c not in keys]
    summed = ranged.withColumns(
        {f"in_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}
    ).join(offsets, ["block", *keys])
    return summed.select(
        *rows.columns, *more,
        *[(F.col(f"in_{m}") + F.col(f"off_{m}")).alias(f"before_{m}") for m in measures],
    )


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: Fraction = BUDGET,
    most: int = MOST,
    blocks: int | None = None,
) -> DataFrame:
    """(source, unnamed, source_size, target) of rows (source, unnamed, size).

    ``weights`` go round the sources in the order of their names' code points, null last.
    ``blocks`` is for tests; sources are counted otherwise.
    """
    sources = stage(sizes.groupBy(*NAMED).agg(F.sum("size").alias("source_size")))
    if blocks is None:
        blocks = max(1, -(-sources.count() // BLOCK_ROWS))
    one = F.lit(1).cast("long")
    numbered = ranged_sums(
        sources.withColumns({"one": one, "all": one}), ["all"], ["unnamed", "source"], ["one"], blocks
    )
    round_weights = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = stage(
        numbered.select(
            *NAMED, "source_size", "all",
            F.element_at(round_weights, (F.col("before_one") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * most).alias("limit"),
        )
    )
    # Those that stop first come first.
    ratio = F.col("limit") / F.col("weight")
    summed = ranged_sums(weighed, ["all"], [ratio.asc(), "unnamed", "source"], ["limit", "weight"], blocks)
    totals = weighed.agg(
        F.sum("source_size").alias("words"), F.sum("weight").alias("weights")
    )  # one row
    # Words a unit of weight gets if all sources before stopped and none from here on. The first
    # source below its limit at its level is the first that never stops.
    level = (F.lit(float(budget)) * F.col("words") - F.col("before_limit")) / (
        F.col("weights") - F.col("before_weight")
    )
    final = (
        summed.crossJoin(F.broadcast(totals))
        .withColumn("level", level)
        .where(F.col("level") * F.col("weight") < F.col("limit"))
        .agg(F.min_by("level", F.struct(ratio, F.col("unnamed"), F.col("source"))).alias("level"))
    )  # one row; null if all stop
    even = F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))
    return weighed.crossJoin(F.broadcast(final)).select(
        *NAMED, "source_size", F.least(even, F.col("limit").cast("double")).alias("target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    budget: Fraction = BUDGET,
    most: int = MOST,
    quality=mark_quality,
    seed: str = SEED,
    blocks: int | None = None,
) -> DataFrame:
    """Per document (id, source, digest, size, source_size, target, epochs, part): ``epochs`` times
    whole, and once more the first ``part`` words. ``digest`` is the text's MD5."""
    text = text_of(F.col(f"`{text_col}`"))
    doc = F.col(f"`{id_col}`")
    source = F.col(f"`{source_col}`").cast("string")
    rows = stage(
        docs.select(
            doc.alias("doc"),
            F.coalesce(source, F.lit("")).alias("source"),
            source.isNull().alias("unnamed"),
            word_count(text).alias("size"),
            exponential_key(doc, text, quality(text), seed).alias("key"),
            F.md5(text.cast("binary")).alias("digest"),
        )
    )
    targets = source_targets(rows, weights, budget, most)
    if blocks is None:
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(least, -(-rows.count() // BLOCK_ROWS))
    order = ["key", F.col("doc").asc_nulls_first(), "digest"]
    summed = ranged_sums(rows, NAMED, order, ["size"], blocks, targets)
    whole = F.col("target") >= F.col("source_size")
    epochs = F.when(whole & (F.col("source_size") > 0), F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size") - F.col("before_size")
    named = F.when(~F.col("unnamed"), F.col("source"))
    return summed.withColumn("epochs", epochs.cast("long")).select(
        F.col("doc").alias(id_col), named.alias("source"), "digest", "size", "source_size", "target", "epochs",
        F.least(F.greatest(left, F.lit(0)), F.col("size")).cast("long").alias("part"),
    )


def mixed_texts(
    docs: DataFrame,
    mixed: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, text): the mix itself, a row for each time that a document is taken.

    A document taken in part gives its first words, joined by one space. Rows equal in source, id
    and text are put together before their texts are met, so each copy comes out once.
    """
    keys = ["doc", "origin", "digest"]
    plan = (
        mixed.select(
            F.col(f"`{id_col}`").alias("doc"), F.col("source").alias("origin"), "digest", "epochs", "part"
        )
        .groupBy(*keys)
        .agg(F.sum("epochs").alias("whole"), F.collect_list(F.when(F.col("part") > 0, F.col("part"))).alias("parts"))
        .where((F.col("whole") > 0) | (F.size("parts") > 0))
    )
    text = text_of(F.col(f"`{text_col}`"))
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        F.col(f"`{source_col}`").cast("string").alias("origin"),
        F.md5(text.cast("binary")).alias("digest"),
        text.alias("said"),
    )
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    one_each = texts.groupBy(*keys).agg(F.any_value("said").alias("said"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")), F.col("parts"))
    return (
        one_each.alias("t")
        .join(plan.alias("p"), same[0] & same[1] & same[2])
        .select("t.doc", "t.origin", "said", F.explode(copies).alias("words"))
        .select(
            F.col("doc").alias(id_col),
            F.col("origin").alias(source_col),
            F.when(F.col("words") < 0, F.col("said"))
            .otherwise(F.array_join(F.slice(split_words(F.col("said")), F.lit(1), F.col("words").cast("int")), " "))
            .alias(text_col),
        )
    )


def mix_report(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return mixed.select(id_col, "size", "source_size", "target", taken.alias("taken"))
