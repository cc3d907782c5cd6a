"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: a word shingle's hash votes on 64 bits; one map-side combined sum per document.

Links: for radius r the covering family has 2^(r+1) - 1 bit masks. Every bit position i gets a
non-zero vector phi(i) of r + 1 bits, and the mask of a vector v keeps the positions with
<phi(i), v> = 1. Up to r differing positions leave some v orthogonal to all their vectors, so
every pair within the radius agrees under some mask. Tables hold distinct fingerprints, not
documents, so copies of any number cost nothing.

Buckets: those of up to ``PAIR_BUCKET`` fingerprints are compared directly. A larger one is
covered anew on the bits its mask left free, which halves them; after three levels at most eight
bits are free, so a bucket holds at most 256 fingerprints. Nothing is capped or dropped.

Components come from rounds of hooking and pointer jumping over the links, each written out.

Rows equal in id and text are one document, returned once. Null text has no words and the zero
fingerprint, as the empty text has. A null id belongs to its component but never names it unless
all ids there are null. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.llm.common import (
    as_documents,
    ascii_lower,
    identified,
    row_identity,
    split_words,
    stage,
    text_of,
)

SHINGLE = 3
RADIUS = 3
BITS = 64
PAIR_BUCKET = 64
LEVELS = 3


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc, d1, d2, copies, fp): majority bits of the shingle hashes of whole texts."""
    d1, d2 = row_identity(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    words = split_words(ascii_lower(text_of(F.col(f"`{text_col}`"))))
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc"), d1.alias("d1"), d2.alias("d2"), words.alias("words")
    )
    # A text of fewer words is one shingle: concat_ws leaves out what lies past the end.
    last = F.greatest(F.size("words") - F.lit(shingle), F.lit(0))
    at = texts.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    gram = F.concat_ws(" ", *[F.get("words", F.col("at") + F.lit(k)) for k in range(shingle)])
    hashed = at.select("doc", "d1", "d2", "at", F.when(F.size("words") > 0, F.xxhash64(gram)).alias("h"))
    # Two 32-bit counters a sum: bit i below, bit i + 32 above.
    half = BITS // 2
    pair = 0x0000000100000001
    counters = [
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(pair))).alias(f"s{i}")
        for i in range(half)
    ]
    copies = F.count_if(F.col("at") == 0).alias("copies")
    summed = hashed.groupBy("doc", "d1", "d2").agg(F.count("h").alias("n"), copies, *counters)
    bits = []
    for i in range(half):
        low = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{i}", half)
        for count, place in ((low, i), (high, i + half)):
            set_bit = (1 << place) - (1 << 64 if place == 63 else 0)
            bits.append(F.when(2 * count > F.col("n"), F.lit(set_bit)).otherwise(F.lit(0)))
    fp = reduce(Column.bitwiseOR, [b.cast("long") for b in bits])
    return summed.select("doc", "d1", "d2", "copies", fp.alias("fp"))


def cover(free: int, radius: int = RADIUS) -> list[int]:
    """The masks over the set bits of ``free``: pairs within the radius agree under one of them."""
    places = [i for i in range(BITS) if free >> i & 1]
    vectors = (1 << radius + 1) - 1
    phi = {place: 1 + k % vectors for k, place in enumerate(places)}
    odd = lambda x: bin(x).count("1") % 2
    return [
        sum(1 << place for place, p in phi.items() if odd(p & v)) for v in range(1, vectors + 1)
    ]


def mask_levels(radius: int = RADIUS, levels: int = LEVELS) -> list[list[tuple[int, int, int]]]:
    """Per level the rows (parent table, table, mask); a mask keeps its parent's bits."""
    whole = (1 << BITS) - 1
    parents, out = [(0, 0)], []
    for _ in range(levels):
        rows = []
        for table, kept in parents:
            for mask in cover(whole & ~kept, radius):
                rows.append((table, len(rows), kept | mask))
        out.append(rows)
        parents = [(table, mask) for _, table, mask in rows]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(points: DataFrame, radius: int = RADIUS, bucket: int = PAIR_BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``fp`` that differ in at most ``radius`` bits."""
    spark = points.sparkSession
    level_members = points.select("fp", F.lit(0).alias("parent"))
    found = []
    levels = mask_levels(radius)
    for depth, masks in enumerate(levels):
        rows = [(p, t, _signed(m)) for p, t, m in masks]
        # 15, 225 and 3,375 rows.
        tables = F.broadcast(spark.createDataFrame(rows, "parent int, table int, mask long"))
        members = level_members.join(tables, "parent").select(
            "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
        )
        sizes = stage(
            members.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        )
        last = depth == len(levels) - 1
        met = members.join(sizes, ["table", "key"])
        direct = met if last else met.where(F.col("size") <= bucket)
        direct = stage(direct.select("table", "key", "fp"))
        other = direct.withColumnRenamed("fp", "other")
        near = (F.col("fp") < F.col("other")) & (
            F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
        )
        pairs = direct.join(other, ["table", "key"]).where(near)
        found.append(pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")))
        if last or sizes.where(F.col("size") > bucket).limit(1).count() == 0:
            break
        level_members = stage(
            met.where(F.col("size") > bucket).select("fp", F.col("table").alias("parent"))
        )
    return reduce(DataFrame.unionByName, found).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b).

    Each round hooks every node and its present root to the smallest root among its neighbours,
    then halves the paths; the number of rounds grows with the logarithm of the path lengths.
    """
    both = stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = roots.join(least, "node").select("node", "root", F.least("root", "seen").alias("low"))
        offers = hooked.select("node", "low").union(
            hooked.select(F.col("root").alias("node"), "low")
        )
        lower = stage(offers.groupBy("node").agg(F.min("low").alias("low")))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("further"))
        after = stage(
            lower.join(jump, "low")
            .join(roots, "node")
            .select("node", F.col("further").alias("root"), F.col("root").alias("before"))
        )
        roots = after.select("node", "root")
        if after.where("root <> before").limit(1).count() == 0:
            return roots


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc, d1, d2, copies, fp, root, component): every document with the smallest id it reaches."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle))
    points = stage(prints.groupBy("fp").agg(F.min("doc").alias("least")))
    links = stage(near_pairs(points.select("fp"), radius))
    groups = components(links).withColumnRenamed("node", "fp")
    classed = points.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classed.groupBy("root").agg(F.min("least").alias("component"))
    labels = classed.select("fp", "root").join(named, "root").select("fp", "root", "component")
    return prints.join(labels, "fp")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs, id_col, text_col).select(
        F.col("doc").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of several with that id (or only null ids) the one with the smallest identity stays, and of
    repeated rows one.
    """
    order = F.struct(F.col("doc").isNull(), "doc", "d1", "d2")
    chosen = stage(
        near_duplicates(docs, id_col, text_col)
        .groupBy("root")
        .agg(F.min_by(F.struct("d1", "d2", "copies"), order).alias("best"))
        .select("best.*")
    )
    rows = identified(docs, id_col, text_col).join(chosen.select("d1", "d2"), ["d1", "d2"])
    if chosen.where("copies > 1").limit(1).count():
        rows = rows.dropDuplicates(["d1", "d2"])
    return as_documents(docs, rows)
