"""Line-first quality rules: drop failing lines, then documents that lose too much text.

Everything is a column expression over one row, so there is no shuffle and no join: a text of any
source, and copies of any number, are judged where they are read.

Cases: a null or blank text has no words and fails; repeated rows are judged alike; ids are not
looked at and may be null; an empty table gives an empty result. Window repeats inside a text are
told by 128-bit hashes of the eight words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setspan.llm.common import (
    SPACE,
    SPACES,
    as_documents,
    as_rows,
    field,
    hash_pair,
    split_words,
    text_of,
)

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# A document is rejected if its failing lines hold more than this share of its characters.
MAX_LOST_PERCENT = 50

SYMBOL = r"[#*$%&|<>]"
MARK = r"[#*$%&|<>~^=_{}\[\]\\]"  # marks that prose uses rarely
SHOUT = r"[!?]{2,}"
SEPARATOR = r"\s[|>»•·/]\s|\s\|$"
SENTENCE_END = r"[.!?…。！？:;]['\"”’»)\]]*\s*$"
BOILERPLATE = (
    r"(?i)all rights reserved|cookie (policy|settings)|privacy policy|terms of (use|service)"
    r"|click here|read more|subscribe (now|to our)|sign (in|up)\b|log ?in\b|enable javascript"
    r"|skip to (main )?content|share (this|on)|back to top|lorem ipsum|powered by"
)


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks one of the rules.

    punctuation: marks are a tenth of the characters, or three or more runs of ! and ? come as
    often as every fifth word, or fewer than six words end without a sentence mark;
    navigation: three or more separators, one for every fourth word;
    boilerplate: a known phrase in a line of at most 15 words.
    """
    words = F.size(F.split(F.btrim(line, F.lit(SPACE)), SPACES))
    marks = count_of(line, MARK) * 10 >= F.length(line)
    shouts = F.size(F.split(line, SHOUT)) - 1
    separators = F.size(F.split(line, SEPARATOR)) - 1
    return (
        marks
        | ((shouts >= 3) & (shouts * 5 >= words))
        | ((words < 6) & ~line.rlike(SENTENCE_END))
        | ((separators >= 3) & (separators * 4 >= words))
        | ((words <= 15) & line.rlike(BOILERPLATE))
    )


def _covered(starts: Column, width: int) -> Column:
    """How many positions the spans [start, start + width) cover; starts rise."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("end"))

    def add(acc, start):
        end = start + F.lit(width)
        fresh = end - F.greatest(start, acc["end"])
        return F.struct((acc["sum"] + fresh).alias("sum"), end.alias("end"))

    return F.aggregate(starts, zero, add, lambda acc: acc["sum"])


def _windows(words: str, size: str, value) -> Column:
    """value(position, the window's words) for each window of the words column."""
    last = F.col(size) - F.lit(WINDOW)
    at = lambda i: [F.get(F.col(words), i + F.lit(k)) for k in range(WINDOW)]
    positions = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    return F.when(last >= 0, F.transform(positions, lambda i: value(i, at(i.cast("int")))))


def judged(docs: DataFrame, text_col: str = "text", line_rule=line_fails) -> DataFrame:
    """``docs`` in one struct column ``row`` with the metrics, the cleaned text and the verdict."""
    text = text_of(field(text_col))
    base = as_rows(docs).select(
        "row",
        split_words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        count_of(text, SYMBOL).cast("long").alias("n_symbols"),
    )
    counted = base.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("lines", lambda x: ~line_rule(x)).alias("kept_lines"),
    )
    hashed = counted.select(
        "*", _windows("words", "n_words", lambda i, w: F.xxhash64(*w)).alias("hashes")
    )
    # Only texts that repeat a window's hash look for its places.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    keyed = lambda i, w: F.struct(*hash_pair(*w), i.alias("at"))
    sorted_windows = F.sort_array(_windows("words", "n_words", keyed))
    # Always true, but not to be moved: a filter on the results stays above this step. Put below it,
    # it would sort the windows again for each of their elements.
    here = F.monotonically_increasing_id() >= 0
    placed = hashed.select("*", F.when(repeats & here, sorted_windows).alias("places")).drop("hashes")
    same = lambda a, b: (a["col1"] == b["col1"]) & (a["col2"] == b["col2"])
    twice = F.filter(
        "places",
        lambda x, i: F.coalesce(same(x, F.get(F.col("places"), i - 1)), F.lit(False))
        | F.coalesce(same(x, F.get(F.col("places"), i + 1)), F.lit(False)),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    chars = lambda c: F.length(F.array_join(c, ""))
    measured = placed.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(_covered(starts, WINDOW), F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_lines_removed"),
        (chars("lines") - chars("kept_lines")).cast("long").alias("chars_removed"),
        chars("lines").cast("long").alias("chars"),
        "kept_lines",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    loses = 100 * F.col("chars_removed") > MAX_LOST_PERCENT * F.col("chars")
    # A text that loses no line stays byte for byte, blank lines included.
    cleaned = F.when(F.col("n_lines_removed") == 0, text).otherwise(F.array_join("kept_lines", "\n"))
    return measured.select(
        "*", failed.alias("base_failed"), (~failed & ~loses).alias("kept"), cleaned.alias("cleaned")
    ).drop("chars", "kept_lines")


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of metrics and verdict for each row of ``docs``."""
    return judged(docs, text_col).select(
        field(id_col).alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines_removed",
        "chars_removed",
    )


def keep_quality(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The kept rows of ``docs`` with their failing lines removed; its columns as they are."""
    rows = judged(docs, text_col).where("kept")
    changed = {text_col: F.col("cleaned")}
    if chars_col in docs.columns:
        changed[chars_col] = F.length("cleaned").cast(docs.schema[chars_col].dataType)
    return as_documents(docs, rows, **changed)
