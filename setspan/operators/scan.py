"""Ordered work within groups: ranks, false-discovery correction, collapsing of repeats.

A window puts a whole group into one task. That is right for groups of a known size and wrong
for a contrast that holds a third of all rows, so every function here measures the largest
group (or takes the caller's proof of a bound) and otherwise works in blocks: range-partition
by (group, order), number the blocks, scan inside each block, and add what the earlier blocks
of the same group contribute. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setspan.session import cut_lineage

# Most rows of one group that a single window task may hold.
GROUP_ROWS = 2_000_000
# Most short rows (a key and a count) that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 500_000
# Most rows of one join key on the reference side before the key is split.
HUB_ROWS = 1_000_000

BLOCK = "_block"


def in_bounds(size: str, least: int, most: int | None) -> Column:
    """Whether a size is at least and, unless there is no upper bound, at most so large."""
    return F.col(size) >= least if most is None else F.col(size).between(least, most)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group: one map-side combined count, one number to the driver."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def must_split(df: DataFrame, keys: Sequence[str], bound: int | None = None) -> bool:
    return largest_group(df, keys) > (GROUP_ROWS if bound is None else bound)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of one short row per group for broadcast if it was counted to be small.

    Otherwise the planner shuffles the large side by its group before it learns the size.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def has_hubs(df: DataFrame, key: str) -> bool:
    """Whether some join key has more rows than one task should take for it."""
    return largest_group(df, [key]) > HUB_ROWS


def join_hubs(left: DataFrame, right: DataFrame, key: str, split: bool | None = None) -> DataFrame:
    """Inner join on ``key`` where single keys may fill much of ``right``.

    Keys with more than ``HUB_ROWS`` rows on the right are split: their right rows spread over
    numbered parts by a hash of the row, and their left rows are repeated once per part. Every
    pair meets exactly once. Without such keys it is a plain join; ``split`` passes on what
    ``has_hubs`` said of ``right`` or of rows that contain it.
    """
    if not (has_hubs(right, key) if split is None else split):
        return left.join(right, key)
    others = [F.col(c) for c in right.columns if c != key]
    hubs = (
        right.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > HUB_ROWS)
        .select(key, F.ceil(F.col("_rows") / HUB_ROWS).cast("int").alias("_parts"))
    )
    # At most (right rows / HUB_ROWS) keys qualify.
    hubs = broadcast_if_small(cut_lineage(hubs))
    parts = F.coalesce("_parts", F.lit(1))
    spread = right.join(hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64(*others), parts))
    numbers = F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint"))
    repeated = left.join(hubs, key, "left").withColumn("_part", F.explode(numbers))
    return repeated.drop("_parts").join(spread.drop("_parts"), [key, "_part"]).drop("_part")


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add a block number that rises with ``order`` inside each group.

    Written to the checkpoint folder, because a recomputed range partitioning could cut
    elsewhere and every later step must see the same blocks. Equal order keys share a block.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(2, least, -(-df.count() // GROUP_ROWS))
    spread = df.repartitionByRange(blocks, *[F.col(k).asc() for k in keys], *order)
    return cut_lineage(spread.withColumn(BLOCK, F.spark_partition_id()))


def block_offsets(blocked: DataFrame, keys: Sequence[str], measure: Column, combine, out: str):
    """Per (group, block): the combined measure of the earlier blocks; null for the first."""
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, BLOCK).agg(measure.alias(out))
    return totals.withColumn(out, combine(out).over(before))


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "rank",
    split: bool | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``."""
    keys = list(keys)
    if split is None:
        split = must_split(df, keys)
    if not split:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    blocked = in_blocks(df, keys, order)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    offsets = block_offsets(blocked, keys, F.count(F.lit(1)), F.sum, "_before")
    return (
        blocked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, BLOCK])
        .withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0)))
        .drop(BLOCK, "_inside", "_before")
    )


def bh_scan(
    df: DataFrame,
    keys: Sequence[str],
    p: str,
    weight: str,
    out: str = "padj",
    split: bool | None = None,
) -> DataFrame:
    """Benjamini-Hochberg over rows that each stand for ``weight`` tests with the same p.

    Descending order turns "minimum over all larger ranks" into a running minimum; tied rows
    get the same value in any order.
    """
    keys = list(keys)
    if split is None:
        split = must_split(df, keys)
    down, w = F.col(p).desc(), F.col(weight)
    raw = F.col(p) * F.col("_m") / (F.col("_m") - F.col("_run") + w)
    if not split:
        ordered = Window.partitionBy(*keys).orderBy(down)  # one sort for both frames
        group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        running = ordered.rowsBetween(Window.unboundedPreceding, 0)
        scored = (
            df.withColumn("_m", F.sum(w).over(group))
            .withColumn("_run", F.sum(w).over(running))
            .withColumn(out, F.min(raw).over(running))
        )
    else:
        blocked = in_blocks(df, keys, [down])
        inside = (
            Window.partitionBy(*keys, BLOCK).orderBy(down).rowsBetween(Window.unboundedPreceding, 0)
        )
        seen = block_offsets(blocked, keys, F.sum(w), F.sum, "_seen")
        tests = blocked.groupBy(*keys).agg(F.sum(w).alias("_m"))
        counted = (
            blocked.withColumn("_run", F.sum(w).over(inside))
            .join(seen, [*keys, BLOCK])
            .join(tests, keys)
            .withColumn("_run", F.col("_run") + F.coalesce("_seen", F.lit(0)))
            .withColumn("_raw", raw)
        )
        least = block_offsets(counted, keys, F.min("_raw"), F.min, "_least")
        scored = (
            counted.withColumn("_low", F.min("_raw").over(inside))
            .join(least, [*keys, BLOCK])
            .withColumn(out, F.least("_low", "_least"))
        )
    return scored.select(
        *df.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(out))).alias(out)
    )


def bh_adjust(
    df: DataFrame,
    keys: Sequence[str],
    p: str = "pvalue",
    out: str = "padj",
    split: bool | None = None,
) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each group; null p stays null and is not counted.

    Rows are first reduced to distinct p-values with counts, which loses nothing and bounds the
    group a window sees: test p-values depend on few small integers, however many sets there
    are. ``split=False`` is the caller's word that the distinct values per group are that few.
    """
    keys = list(keys)
    distinct = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    scored = bh_scan(distinct, keys, p, "_c", out, split).drop("_c")
    return df.join(scored, [*keys, p], "left")


def collapse_repeats(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    rule: str = "first",
    order: str = "row_no",
    value: str = "value",
) -> DataFrame:
    """One row per key by a stated rule; combines map-side and never relies on read order.

    ``first`` / ``last``: the row with the smallest / largest ``order``.
    ``max_abs``: the value furthest from zero, the positive one on a tie.
    """
    row = F.struct(*values)
    if rule == "first":
        chosen = F.min_by(row, F.struct(F.col(order), row))
    elif rule == "last":
        chosen = F.max_by(row, F.struct(F.col(order), row))
    elif rule == "max_abs":
        chosen = F.max_by(row, F.struct(F.abs(F.col(value)), F.col(value), row))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*")
