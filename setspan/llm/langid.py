"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 bytes of a whole text in segments of ``SEGMENT`` bytes,
once forwards and once backwards, and gives every byte a distribution over the languages; a
document's distribution is the mean over its bytes, so a text of two languages goes to the larger.

It is trained in numpy by backpropagation through time on the driver, on at most ``LANG_DOCS``
documents of every language, chosen by hash, and ``DOC_SEGMENTS`` segments spread over each of their
texts; steps and width grow with the number of languages. Prediction reads every byte of every text, in
blocks of a fixed number of segments.

Null texts and texts without a letter get ``und`` and score 0. Null languages are not learned from,
null ids are held out. With no language to learn every text is ``und``; with one, all texts with a
letter are that one. Repeated rows are predicted alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setspan.llm.common import ship_package, stage
from setspan.operators.scan import broadcast_if_small

HIDDEN = 12
SEGMENT = 64
BLOCK = 1024  # segments worked on at once

LANG_DOCS = 300
DOC_SEGMENTS = 8
STEPS = 300  # for each FEW languages
FEW = 8
BATCH = 128
RATE = 0.015
SEED = 7

FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def width(langs: int) -> int:
    """Hidden units of a direction: HIDDEN, and as many again for each fourfold of FEW languages."""
    return round(HIDDEN * (1 + max(0.0, math.log(langs / FEW, 4))))


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class ByteGRU:
    """Weights of both directions: input table, recurrent matrix, and the output layer.

    Gates are in the order update, reset, candidate; the reset gate acts on the recurrent part of
    the candidate.
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        h = hidden
        self.langs, self.hidden = list(langs), h
        self.weights = {
            "table": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
            "recur": (rng.normal(0, 1, (2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "out": (rng.normal(0, 1, (2 * h, len(langs))) / np.sqrt(2 * h)).astype(np.float32),
            "bias": np.zeros(len(langs), np.float32),
        }

    def gradients(self, x, mask, y):
        """Loss and gradients of a batch: x (B, T) bytes, mask (B, T), y (B) languages."""
        import numpy as np

        w, h = self.weights, self.hidden
        table, recur = w["table"], w["recur"]
        b, t_len = x.shape
        both = np.stack([x, x[:, ::-1]])  # the second direction reads backwards
        state, kept = np.zeros((2, b, h), np.float32), []
        states = np.empty((2, t_len, b, h), np.float32)
        for t in range(t_len):
            a = np.stack([table[d][both[d, :, t]] for d in (0, 1)])
            u = state @ recur
            zr = 1 / (1 + np.exp(-(a[..., : 2 * h] + u[..., : 2 * h])))
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(a[..., 2 * h :] + r * u[..., 2 * h :])
            kept.append((state, z, r, n, u[..., 2 * h :]))
            state = n + z * (state - n)
            states[0, t], states[1, t_len - 1 - t] = state[0], state[1]
        joined = np.concatenate([states[0], states[1]], -1)  # (T, B, 2h) at text positions
        logits = joined @ w["out"] + w["bias"]
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        m = mask.T / mask.sum()
        picked = p[:, np.arange(b), y]
        loss = float(-(np.log(picked + 1e-9) * m).sum())
        d_logits = p * m[..., None]
        d_logits[:, np.arange(b), y] -= m
        d_logits = d_logits.astype(np.float32)
        grads = {
            "out": np.einsum("tbh,tbl->hl", joined, d_logits),
            "bias": d_logits.sum((0, 1)),
            "recur": np.zeros_like(recur),
        }
        d_joined = d_logits @ w["out"].T
        d_inputs = np.empty((2, t_len, b, 3 * h), np.float32)
        d_state = np.zeros((2, b, h), np.float32)
        for t in reversed(range(t_len)):
            d_state[0] += d_joined[t, :, :h]
            d_state[1] += d_joined[t_len - 1 - t, :, h:]
            before, z, r, n, un = kept[t]
            d_n = d_state * (1 - z) * (1 - n * n)
            d_z = d_state * (before - n) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r], -1)
            d_inputs[:, t] = np.concatenate([d_z, d_r, d_n], -1)
            grads["recur"] += before.transpose(0, 2, 1) @ d_u
            d_state = d_state * z + d_u @ recur.transpose(0, 2, 1)
        d_table = []
        for d in (0, 1):
            read = both[d].T.ravel()
            order = np.argsort(read, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(read[order].astype(int)) != 0])
            rows = np.zeros((256, 3 * h), np.float32)
            rows[read[order][starts]] = np.add.reduceat(d_inputs[d].reshape(-1, 3 * h)[order], starts)
            d_table.append(rows)
        grads["table"] = np.stack(d_table)
        return loss, grads

    def fit(self, x, mask, y, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED):
        """Adam over random batches in which every language comes equally often."""
        import numpy as np

        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            lang = rng.integers(0, len(rows), batch)
            pick = np.array([rows[k][rng.integers(len(rows[k]))] for k in lang])
            loss, grads = self.gradients(x[pick], mask[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = rate * min(1.0, 1.5 * (1 - step / (steps + 1))) / max(1.0, norm)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                fixed = first[k] / (1 - 0.9**step)
                self.weights[k] -= pace * max(1.0, norm) * fixed / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def positions(self, x, sizes):
        """Sums of the position distributions: x (N, T) bytes, sizes (N) -> (N, languages)."""
        import numpy as np

        h, langs = self.hidden, len(self.langs)
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)  # sigmoid by tanh
        table = np.ascontiguousarray((self.weights["table"] * half).transpose(0, 2, 1))
        recur = np.ascontiguousarray((self.weights["recur"] * half).transpose(0, 2, 1))
        out = np.ascontiguousarray(self.weights["out"].T)
        bias = self.weights["bias"][:, None]
        total = np.zeros((len(x), langs))
        for at in range(0, len(x), BLOCK):
            part = np.ascontiguousarray(x[at : at + BLOCK].T).astype(np.intp)
            t_len, b = part.shape
            states = np.empty((t_len, 2 * h, b), np.float32)
            a = np.empty((2, 3 * h, b), np.float32)
            u = np.empty_like(a)
            state = np.zeros((2, h, b), np.float32)
            gates, cand, u_cand = a[:, : 2 * h], a[:, 2 * h :], u[:, 2 * h :]
            for t in range(t_len):
                np.take(table[0], part[t], axis=1, out=a[0], mode="clip")
                np.take(table[1], part[t_len - 1 - t], axis=1, out=a[1], mode="clip")
                np.matmul(recur, state, out=u)
                gates += u[:, : 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                u_cand *= gates[:, h:]
                cand += u_cand
                np.tanh(cand, out=cand)
                state -= cand
                state *= gates[:, :h]
                state += cand
                states[t, :h], states[t_len - 1 - t, h:] = state[0], state[1]
            size = sizes[at : at + BLOCK]
            for t in range(t_len):
                p = out @ states[t]
                p += bias
                p -= p.max(0)
                np.exp(p, out=p)
                p *= (size > t) / p.sum(0)
                total[at : at + b] += p.T
        return total


def segments(datas: list[bytes]):
    """(x, sizes, owner): the texts in rows of SEGMENT bytes, the last one of each padded."""
    import numpy as np

    counts = np.array([-(-len(d) // SEGMENT) for d in datas], np.int64)
    x = np.zeros((int(counts.sum()), SEGMENT), np.uint8)
    sizes = np.full(len(x), SEGMENT, np.int64)
    at = 0
    flat = x.reshape(-1)
    for d, c in zip(datas, counts):
        flat[at * SEGMENT : at * SEGMENT + len(d)] = np.frombuffer(d, np.uint8)
        at += c
        if c:
            sizes[at - 1] = len(d) - (c - 1) * SEGMENT
    return x, sizes, np.repeat(np.arange(len(datas)), counts)


def predict(model: ByteGRU | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its pooled probability of each text."""
    import numpy as np

    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return lang, score
    rows = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
    # Some megabytes of text at a time; a text longer than that by itself, in pieces.
    at, piece = 0, 1 << 21
    while at < len(rows):
        datas, owners, size = [], [], 0
        while at < len(rows) and (not datas or size < piece):
            data = text_bytes(texts[rows[at]])
            datas.append(data)
            owners.append(rows[at])
            size += len(data)
            at += 1
        sums = np.zeros((len(datas), len(model.langs)))
        x, sizes, owner = segments(datas)
        for k in range(0, len(x), piece // SEGMENT):
            part = slice(k, k + piece // SEGMENT)
            np.add.at(sums, owner[part], model.positions(x[part], sizes[part]))
        shares = sums / sums.sum(1, keepdims=True)
        for row, best, share in zip(owners, shares.argmax(1), shares.max(1)):
            lang[row], score[row] = model.langs[best], float(min(1.0, share))
    return lang, score


def training_rows(rows: DataFrame, per_lang: int = LANG_DOCS):
    """[(lang, text pieces)] of a bounded sample: (lang, text, key) with a hash key per row."""
    # The share of each language that gives the wanted number of rows and some more.
    shares = stage(rows.groupBy("lang").agg((F.lit(1.5 * per_lang) / F.count(F.lit(1))).alias("share")))
    likely = rows.join(broadcast_if_small(shares), "lang").where(
        F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )
    size = SEGMENT * 2
    starts = [
        F.substring(
            "text",
            F.lit(1) + F.floor(F.greatest(F.length("text") - size, F.lit(0)) * k / (DOC_SEGMENTS - 1)).cast("int"),
            F.lit(size),
        )
        for k in range(DOC_SEGMENTS)
    ]
    cut = likely.select("lang", "key", F.array_distinct(F.array(*starts)).alias("parts"))
    # Rows of one key are repeats. What is left to sort is about half more than what is taken.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    found = cut.dropDuplicates(["lang", "key"]).withColumn("place", place).where(F.col("place") <= per_lang).collect()
    return [(r["lang"], r["parts"]) for r in sorted(found, key=lambda r: (r["lang"], r["key"]))]


def train(rows: DataFrame, **fit) -> ByteGRU | None:
    """The network for (lang, text, key) rows, or None without any."""
    import numpy as np

    sample = training_rows(rows)
    pieces = [
        (text_bytes(p)[:SEGMENT], lang)
        for lang, parts in sample
        for p in parts
        if LETTER.search(p)
    ]
    langs = sorted({lang for _, lang in pieces})
    if not langs:
        return None
    model = ByteGRU(langs, width(len(langs)))
    fit = {"steps": STEPS * -(-len(langs) // FEW), **fit}
    x = np.zeros((len(pieces), SEGMENT), np.uint8)
    mask = np.zeros(x.shape, np.float32)
    for k, (data, _) in enumerate(pieces):
        x[k, : len(data)] = np.frombuffer(data, np.uint8)
        mask[k, : len(data)] = 1
    number = {lang: k for k, lang in enumerate(langs)}
    y = np.array([number[lang] for _, lang in pieces])
    return model.fit(x, mask, y, **fit) if len(langs) > 1 else model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    fold = F.crc32(doc.cast("string").cast("binary")) % FOLDS
    held_out: Column = F.coalesce(fold == HELD_OUT, F.lit(True))
    lang = F.col(f"`{lang_col}`").cast("string")
    known = docs.where(~held_out & lang.isNotNull() & text.isNotNull()).select(
        lang.alias("lang"), text.alias("text"), F.xxhash64(doc, text, F.lit("sample")).alias("key")
    )
    held = spark.sparkContext.broadcast(train(known))

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            found, score = predict(held.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return docs.select(doc, held_out.alias("held_out"), text.alias("text")).mapInArrow(apply, schema)
