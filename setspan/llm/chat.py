"""Chat formatting by perspective rotation: each participant of a dialogue in turn is the assistant.

A dialogue is gathered in one row and rendered once for every participant: that speaker as
assistant, all others as users with their names, system turns as they are. The mask is the list of
character spans to learn: the assistant's words with the mark that ends them. Dialogues stay whole;
only one of more than ``SEGMENT_CHARS`` characters, which no row can hold, is cut into segments of
about so many, each rendered for all participants of the dialogue, silent ones too, and starting
with the system turns of the segments before. ``n_turns`` counts a segment's own turns.

Where a message begins is summed up once a dialogue, not once a perspective: a perspective changes
the head of its own turns alone, each by the same number of characters.

All of it are DataFrame functions. Numbering and sums go by blocks when one conversation is too
long for a window (``long_turns``), with the same result.

Cases: rows without a conversation id are in no dialogue and are left out. A null role speaks as
user ``unknown`` and is never the assistant; ``system`` never is either, so a dialogue of such turns
alone has no rows. Null text is empty. Equal turn numbers are ordered by role and text, null first;
repeated rows are repeated turns. Marks inside a text are broken up, so no text ends its own turn.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setspan.operators.scan import must_split, with_rank

SEGMENT_CHARS = 500_000_000  # two gigabytes, a row, if all are characters of four bytes
LONG_TURNS = 50_000

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _safe(text: Column) -> Column:
    """Text in which the marks are no marks any more."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")


def _name(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\s<>|]", "_")


def _with_offsets(placed: DataFrame, long_turns: int, split: bool) -> DataFrame:
    """Add ``before``: the characters of the messages before a turn, own turns spelled as users'."""
    named = F.when(F.col("role") == SYSTEM, len(SYSTEM)).otherwise(F.length("name") + len("user name="))
    size = (F.length("said") + named + len(f"{START}\n{END}\n")).cast("long")
    measured = placed.withColumns(
        {"_size": size, "_chunk": F.floor((F.col("place") - 1) / long_turns) if split else F.lit(0)}
    )
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    keys = ["conv", "_chunk"] if split else ["conv"]
    measured = measured.withColumn("before", F.coalesce(F.sum("_size").over(before(*keys).orderBy("place")), F.lit(0)))
    if split:
        totals = measured.groupBy(*keys).agg(F.sum("_size").alias("_earlier"))
        totals = totals.withColumn("_earlier", F.coalesce(F.sum("_earlier").over(before("conv").orderBy("_chunk")), F.lit(0)))
        measured = measured.join(totals, keys).withColumn("before", F.col("before") + F.col("_earlier")).drop("_earlier")
    return measured.drop("_size", "_chunk")


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_turns: int | None = None,
    long_turns: int = LONG_TURNS,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """(conv, segment, perspective, n_turns, n_own, text, mask) with mask ``start-end,...``."""
    rows = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"),
        F.col(f"`{text_col}`").cast("string").alias("said"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "said")]
    split = must_split(rows.select("conv"), ["conv"], long_turns)
    placed = with_rank(rows, ["conv"], order, "place", split)
    placed = placed.withColumns({"name": _name(F.col("role")), "said": _safe(F.col("said"))})
    placed = _with_offsets(placed, long_turns, split)
    cut = F.floor((F.col("place") - 1) / segment_turns) if segment_turns else F.floor(F.col("before") / segment_chars)
    placed = placed.withColumn("segment", cut.cast("int"))
    turn = F.struct("place", "role", "name", "said", "before")
    dialogues = placed.groupBy("conv", "segment").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    speaks = F.col("role").isNotNull() & (F.col("role") != SYSTEM)
    kept = F.struct("place", "role", "name", "said", "segment")
    whole = placed.groupBy("conv").agg(
        F.collect_set(F.when(speaks, F.col("role"))).alias("people"),
        F.sort_array(F.collect_list(F.when(F.col("role") == SYSTEM, kept))).alias("systems"),
    )
    earlier = F.transform(
        F.filter("systems", lambda t: t["segment"] < F.col("segment")),
        lambda t: F.struct(t["place"].alias("place"), t["role"].alias("role"), t["name"].alias("name"), t["said"].alias("said")),
    )
    views = dialogues.join(whole, "conv").select(
        "conv", "segment", "turns", earlier.alias("earlier"), F.explode("people").alias("perspective")
    )
    own = lambda t: F.coalesce(t["role"] == F.col("perspective"), F.lit(False))

    def head(t: Column) -> Column:
        who = (
            F.when(own(t), F.lit("assistant"))
            .when(t["role"] == SYSTEM, F.lit(SYSTEM))
            .otherwise(F.concat(F.lit("user name="), t["name"]))
        )
        return F.concat(F.lit(START), who, F.lit("\n"))

    def message(t: Column) -> Column:
        return F.concat(head(t), t["said"], F.lit(f"{END}\n"))

    preface = F.array_join(F.transform("earlier", message), "")
    # Where the segment's first message begins, and what a turn of one's own adds to the next ones.
    shift = F.length(preface) - F.get("turns", F.lit(0))["before"]
    mine = F.filter("turns", own)
    gain = len("assistant") - len("user name=") - F.length(F.get("mine", F.lit(0))["name"])

    def span(t: Column, k: Column) -> Column:
        start = F.col("shift") + t["before"] + k * F.col("gain") + len(f"{START}assistant\n")
        return F.concat_ws("-", start.cast("string"), (start + F.length(t["said"]) + len(END)).cast("string"))

    return (
        views.withColumns({"mine": mine, "shift": shift, "preface": preface})
        .withColumn("gain", gain)
        .select(
            "conv",
            "segment",
            "perspective",
            F.size("turns").cast("long").alias("n_turns"),
            F.size("mine").cast("long").alias("n_own"),
            F.concat("preface", F.array_join(F.transform("turns", message), "")).alias("text"),
            F.array_join(F.transform("mine", span), ",").alias("mask"),
        )
    )
