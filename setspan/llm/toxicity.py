"""Toxicity by class-conditional Kneser-Ney models over letters.

Text is lower-cased, everything but letters becomes a blank, and a position's gram is the letter
with up to five before it, never beyond its word's leading blank. Both classes have discounted
counts of these grams and fall back to one shared Kneser-Ney model of the shorter ones, built from
the grams of both: a rare expression that neither class knows says nothing, one that only toxic
texts know says much, whatever its ending.

Counts cover every labelled row that may be learned from; they are summed and smoothed as Spark
tables. A scoring task holds the log-ratios of the ``HELD`` most frequent grams and contexts, all of
them if there are no more. Grams beyond those are looked up by joins with the whole tables, once a
text and gram; both ways give the same evidence, so every gram counts, whatever the corpus.

A document's evidence is the difference of the two log-likelihoods per position, and the same for
the part of each position beyond ``CLEAR`` nats, since thousands of tiny differences of ordinary
words would drown one clear expression in a long text. A ridge logistic fit turns both into the
score; it uses rows the counts have not seen, at most ``FIT_ROWS`` of each class by hash order, and
weights each class back to all its rows: the first fold is measured by the counts of the others. With
fewer than ``FIT_LEAST`` rows of a class in it, each fold in turn is measured so, and the fit uses them
all. Scores use the counts of all folds either way.

Null and empty texts, and texts without letters, have no evidence and get the score of that.
Repeated rows get the same score; labels with null are not used, of repeated labels the largest.
Null ids are held out. Without labels of both classes every score is the share of toxic labels,
or 0 without labels. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setspan.llm.common import hash_pair, ship_package, stage

ORDER = 6
DISCOUNT = 0.75
COUNTS = "gram long, ordinary long, toxic long"
SYMBOLS = 64  # the uniform model below the shortest grams
CLEAR = 3.0
FIT_ROWS = 10_000  # of each class
FIT_LEAST = 50
HELD = 1 << 21  # grams, and contexts, in a scoring task
BLOCK = 1 << 18  # bytes of text worked on at once

FOLDS, HELD_OUT, FIT_PARTS = 3, 1, 5
THRESHOLD = 0.7

# Letters: a-z and all bytes of longer characters; the rest is blank.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def normal(text: str | None) -> bytes:
    """The words between single blanks, or nothing."""
    words = (text or "").encode("utf-8", "replace").translate(LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def grams(data: bytes):
    """The gram code that ends at each byte: its bytes in order, the last one lowest."""
    import numpy as np

    a = np.frombuffer(data, np.uint8)
    n = len(a)
    wide = a.astype(np.uint64)
    code = wide.copy()
    for k in range(1, ORDER):
        code[k:] |= wide[:-k] << np.uint64(8 * k) if k < n else 0
    at = np.arange(n, dtype=np.int32)
    blank = np.maximum.accumulate(np.where(a == 32, at, 0))
    before = np.empty_like(blank)
    before[0], before[1:] = 0, blank[:-1]
    held = np.minimum(at - before + 1, ORDER)
    masks = np.array([(1 << 8 * k) - 1 for k in range(ORDER + 1)], np.uint64)
    return code & masks[held]


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(rows, starts, data): texts together until a block is full; a long one goes in pieces.

    Pieces end at blanks, so no word is cut unless it is longer than a block.
    """
    rows, starts, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        data = normal(text)
        while data:
            cut = len(data)
            if cut > BLOCK:
                cut = data.rfind(b" ", 1, BLOCK) + 1 or BLOCK
            rows.append(row)
            starts.append(size)
            parts.append(data[:cut])
            size += cut
            data = data[cut - 1 :] if cut < len(data) and data[cut - 1] == 32 else data[cut:]
            if size >= BLOCK:
                yield rows, starts, b"".join(parts)
                rows, starts, parts, size = [], [], [], 0
    if rows:
        yield rows, starts, b"".join(parts)


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic): counts over the rows (text, label)."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            texts = batch.column(0).to_pylist()
            for label in (0, 1):
                chosen = [texts[k] for k in np.flatnonzero(labels == label)]
                for _, starts, data in blocks(chosen):
                    inside = np.ones(len(data), bool)
                    inside[starts] = False  # the blank before the first word ends no gram
                    found, n = np.unique(grams(data)[inside], return_counts=True)
                    zero = np.zeros_like(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.astype(np.int64)) for x in (found, *((n, zero) if label == 0 else (zero, n)))],
                        names=["gram", "ordinary", "toxic"],
                    )

    counts = rows.select("text", "label").mapInArrow(count, COUNTS)
    return counts.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _context(gram: str) -> Column:
    return F.shiftright(gram, 8)


def with_shared(counted: DataFrame) -> DataFrame:
    """Add ``shared``: the Kneser-Ney probability of each gram's last letter after its shorter context.

    A shorter gram counts the different grams it ends; one that starts at a word's blank has no
    letters before it and keeps its plain count.
    """
    out = counted.withColumn("shared", F.lit(1.0 / SYMBOLS))
    for k in range(2, ORDER):
        mask = F.lit((1 << 8 * k) - 1)
        weight = F.when(F.col("gram") <= mask, F.col("ordinary") + F.col("toxic")).otherwise(1)
        coded = out.withColumn("code", F.col("gram").bitwiseAND(mask))
        codes = stage(
            coded.groupBy("code").agg(F.sum(weight).alias("n"), F.max("shared").alias("lower"))
        ).withColumn("context", _context("code"))
        contexts = codes.groupBy("context").agg(
            F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")
        )
        share = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")
        known = codes.join(contexts, "context").select("code", (share / F.col("all")).alias("shared"))
        out = stage(coded.drop("shared").join(known, "code").drop("code"))
    return out


def log_ratios(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio, n) and (context, ratio, n): log of toxic over ordinary probability or backoff."""
    out = with_shared(counted).withColumn("context", _context("gram"))
    sums = []
    for c in ("ordinary", "toxic"):
        sums += [F.sum(c).alias(f"{c}_all"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds")]
    contexts = stage(out.groupBy("context").agg(*sums))

    def backoff(c: str) -> Column:
        return F.when(
            F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_all")
        ).otherwise(1.0)

    def probability(c: str) -> Column:
        seen = F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_all"), F.lit(1))
        return seen + backoff(c) * F.col("shared")

    ratio = F.log(probability("toxic")) - F.log(probability("ordinary"))
    by_gram = out.join(contexts, "context").select(
        "gram", ratio.cast("float").alias("ratio"), (F.col("ordinary") + F.col("toxic")).alias("n")
    )
    by_context = contexts.select(
        F.col("context").alias("gram"),
        (F.log(backoff("toxic")) - F.log(backoff("ordinary"))).cast("float").alias("ratio"),
        (F.col("ordinary_all") + F.col("toxic_all")).alias("n"),
    )
    return by_gram, by_context


def slots(ratios: DataFrame, most: int):
    """(keys, values, other keys, their values) of the ``most`` most frequent grams.

    The first two have a slot per ``gram % len(keys)`` with the most frequent gram of it; the grams
    it meets there are among the others, which are sorted.
    """
    import numpy as np

    top = ratios.orderBy(F.desc("n"), "gram").limit(most)
    held = top.select("gram", "ratio", "n").toArrow()  # at most ``most`` rows
    gram, value = held["gram"].to_numpy().astype(np.uint64), held["ratio"].to_numpy().astype(np.float32)
    order = np.lexsort((gram, -held["n"].to_numpy()))
    gram, value = gram[order], value[order]
    size = 2 * len(gram) + 1
    slot, first = np.unique(gram % np.uint64(size), return_index=True)
    keys, values = np.zeros(size, np.uint64), np.zeros(size, np.float32)
    keys[slot], values[slot] = gram[first], value[first]
    other = np.delete(np.arange(len(gram)), first)
    other = other[np.argsort(gram[other])]
    return keys, values, gram[other], value[other]


def look_up(code, table):
    """(value, found) of each code in a table of ``slots``."""
    import numpy as np

    keys, values, *others = table
    slot = code % np.uint64(len(keys))
    found = keys[slot] == code
    value = np.where(found, values[slot], np.float32(0))
    if others and len(others[0]):
        left = np.flatnonzero(~found)
        at = np.minimum(np.searchsorted(others[0], code[left]), len(others[0]) - 1)
        same = others[0][at] == code[left]
        found[left] = same
        value[left] = np.where(same, others[1][at], 0)
    return value, found


def evidence(texts: list[str | None], model, contexts: bool = True):
    """(positions, sum of differences, sum of their clear parts) of each text.

    Without ``contexts`` grams that are not in the model add nothing.
    """
    import numpy as np

    by_gram, by_context = model
    out = np.zeros((len(texts), 3))
    for rows, starts, data in blocks(texts):
        code = grams(data)
        value, found = look_up(code, by_gram)
        if contexts:
            unseen = np.flatnonzero(~found)
            value[unseen] = look_up(code[unseen] >> np.uint64(8), by_context)[0]
        value[starts] = 0
        clear = np.sign(value) * np.maximum(np.abs(value) - CLEAR, 0)
        sizes = np.diff([*starts, len(data)]) - 1
        sums = [sizes, *(np.add.reduceat(v, starts, dtype=np.float64) for v in (value, clear))]
        np.add.at(out, rows, np.stack(sums, 1))
    return out


class Model:
    """The log-ratios of ``log_ratios``: the most frequent broadcast, all of them as tables."""

    def __init__(self, counted: DataFrame):
        ratios = log_ratios(counted)
        self.whole = counted.count() <= HELD  # there are no more contexts than grams
        self.ratios = ratios if self.whole else [stage(t) for t in ratios]
        self.held = counted.sparkSession.sparkContext.broadcast([slots(t, HELD) for t in self.ratios])

    def measure(self, rows: DataFrame) -> DataFrame:
        """``rows`` with (n, a, b) of ``evidence`` instead of ``text``."""
        others = [c for c in rows.columns if c != "text"]
        if self.whole:
            return self._held(rows, others)
        t1, t2 = hash_pair(F.coalesce("text", F.lit("")))
        rows = rows.withColumns({"t1": t1, "t2": t2})
        known = self._held(rows, [*others, "t1", "t2"])
        both = known.join(self._joined(rows), ["t1", "t2"], "left")
        return both.select(
            *others, "n", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))).alias(c) for c in ("a", "b")]
        )

    def _held(self, rows: DataFrame, others: list[str]) -> DataFrame:
        held, whole = self.held, self.whole

        def work(batches):
            import pyarrow as pa

            for batch in batches:
                sums = evidence(batch.column(0).to_pylist(), held.value, whole)
                columns = [batch.column(1 + k) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(sums[:, k]) for k in range(3))], names=[*others, "n", "a", "b"]
                )

        fields = [rows.schema[c] for c in others] + [T.StructField(c, T.DoubleType()) for c in ("n", "a", "b")]
        return rows.select("text", *others).mapInArrow(work, T.StructType(fields))

    def _joined(self, rows: DataFrame) -> DataFrame:
        """(t1, t2, more_a, more_b): what the grams that are not held add to each different text."""
        held = self.held

        def work(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                ids = [batch.column(k).to_numpy() for k in (1, 2)]
                for row, text in enumerate(batch.column(0).to_pylist()):
                    found, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    for _, starts, data in blocks([text]):
                        code = grams(data)
                        inside = np.ones(len(data), bool)
                        inside[starts] = False
                        code = code[inside]
                        new, n = np.unique(code[~look_up(code, held.value[0])[1]], return_counts=True)
                        found, back = np.unique(np.concatenate([found, new]), return_inverse=True)
                        count = np.bincount(back, np.concatenate([count, n]), len(found)).astype(np.int64)
                    columns = [np.full(len(found), x[row]) for x in ids] + [found.astype(np.int64), count]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t1", "t2", "gram", "n"])

        by_gram, by_context = self.ratios
        spread = rows.select("text", "t1", "t2").mapInArrow(work, "t1 long, t2 long, gram long, n long")
        # Copies of a text say the same of each gram.
        counts = spread.groupBy("t1", "t2", "gram").agg(F.max("n").alias("n"))
        joined = (
            counts.withColumn("context", _context("gram"))
            .join(by_gram.select("gram", F.col("ratio").alias("own")), "gram", "left")
            .join(by_context.select(F.col("gram").alias("context"), F.col("ratio").alias("backed")), "context", "left")
        )
        value = F.coalesce("own", "backed", F.lit(0.0)).cast("double")
        clear = F.signum(value) * F.greatest(F.abs(value) - CLEAR, F.lit(0.0))
        return joined.groupBy("t1", "t2").agg(
            F.sum(F.col("n") * value).alias("more_a"), F.sum(F.col("n") * clear).alias("more_b")
        )


def features(sums):
    """Per length, that times the root of the length (the scale of chance), and the clear sum."""
    import numpy as np

    n = np.maximum(sums[:, :1], 1)
    mean = sums[:, 1:] / n
    return np.concatenate([mean, mean * np.sqrt(n), np.clip(sums[:, 2:], -20, 20)], 1)


def fit_logistic(x, y, weight, ridge: float = 0.01, rounds: int = 50):
    """(center, scale, weights) of a ridge logistic regression of weighted rows by Newton steps."""
    import numpy as np

    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - center) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return center, scale, w


def probability(fit) -> Column:
    """The score by a fit from the columns (n, a, b)."""
    n = F.greatest(F.col("n"), F.lit(1.0))
    mean = [F.col(c) / n for c in ("a", "b")]
    x = [*mean, *(m * F.sqrt(n) for m in mean), F.least(F.greatest(F.col("b"), F.lit(-20.0)), F.lit(20.0))]
    center, scale, weights = ([float(v) for v in part] for part in fit)
    z = F.lit(weights[-1])
    for k, column in enumerate(x):
        z = z + (column - center[k]) / scale[k] * weights[k]
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def _united(spark, parts: list[DataFrame]) -> DataFrame:
    """The sums of several counts."""
    out = spark.createDataFrame([], COUNTS)
    for part in parts:
        out = out.unionByName(part)
    sums = [F.sum(c).alias(c) for c in ("ordinary", "toxic")]
    return stage(out.groupBy("gram").agg(*sums))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: Column):
    """The model and the fit, or the constant score. ``fold`` is 0..FIT_PARTS-1 or null: not learned from."""
    import numpy as np

    spark = docs.sparkSession
    known = (
        labels.where(F.col(label_col).isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("doc"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .where(F.col("label").isin(0, 1))
    )
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), fold.alias("fold")
    )
    # The texts stream past a hash table of labels; they are not sorted.
    labelled = rows.where("fold IS NOT NULL").join(known.hint("shuffle_hash"), "doc")
    names = dict(h1=F.xxhash64("doc"), h2=F.xxhash64("doc", "text"))
    keys = stage(labelled.select("fold", "label", *[v.alias(k) for k, v in names.items()]))
    sizes = {(r.fold, r.label): r.n for r in keys.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [sum(n for (_, label), n in sizes.items() if label == k) for k in (0, 1)]
    short = min(sizes.get((0, k), 0) for k in (0, 1)) < FIT_LEAST
    if not all(totals):
        return None, totals[1] / max(1, sum(totals))
    folds = sorted({f for f, _ in sizes}) if short else [0]

    # A bounded sample of each class: the rows up to the last of the first by hash.
    wanted = F.lit(False)
    for label in (0, 1):
        those = keys.where(F.col("fold").isin(folds) & (F.col("label") == label))
        last = those.orderBy("h1", "h2").limit(FIT_ROWS).agg(F.max(F.struct("h1", "h2")).alias("last")).first().last
        order = F.struct(*[v.alias(k) for k, v in names.items()])
        wanted |= (F.col("label") == label) & (order <= F.struct(F.lit(last.h1).alias("h1"), F.lit(last.h2).alias("h2")))
    sample = labelled.where(wanted).select("text", "fold", "label", *[v.alias(k) for k, v in names.items()])

    # Counts of the folds that are measured in turn, and of the rest at once; each text is counted once.
    part = F.when(F.col("fold").isin(folds), F.col("fold")).otherwise(-1)
    parts = {f: stage(count_grams(labelled.where(part == f))) for f in sorted({*folds, -1} if not short else folds)}
    models = {f: Model(_united(spark, [parts[o] for o in parts if o != f])) for f in folds}
    model = Model(_united(spark, list(parts.values())))
    measured = None
    for f, m in models.items():
        rows = m.measure(sample.where(F.col("fold") == f))
        measured = rows if measured is None else measured.unionByName(rows)
    measured = stage(measured)
    x, y, weight = [], [], []
    for label in (0, 1):
        # Rows alike in both hashes are repeats, so it does not matter which of them are taken.
        first = measured.where(F.col("label") == label).orderBy("h1", "h2").limit(FIT_ROWS)
        x.append(features(np.array(first.select("n", "a", "b").toPandas(), float)))
        y.append(np.full(len(x[-1]), label))
        weight.append(np.full(len(x[-1]), sum(sizes.get((f, label), 0) for f in folds) / max(1, len(x[-1]))))
    return model, fit_logistic(*map(np.concatenate, (x, y, weight)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    ship_package(docs.sparkSession)
    bucket = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    held_out = F.coalesce(bucket % FOLDS == HELD_OUT, F.lit(True))
    fold = F.when(~held_out, F.floor(bucket / FOLDS) % FIT_PARTS)
    model, fit = train(docs, labels, id_col, text_col, label_col, fold)

    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc"), held_out.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    if model is None:
        p = F.lit(fit)
    else:
        rows = model.measure(rows)
        p = probability(fit)
    return rows.select(
        F.col("doc").alias(id_col),
        "held_out",
        p.alias("score"),
        (p >= THRESHOLD).cast("int").alias("predicted"),
    )
