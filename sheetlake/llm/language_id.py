"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows.  The weights are fitted on a bounded sample of
them, ``PER_LANGUAGE`` rows a language, by follow-the-regularised-leader with elastic-net penalties; a
part of the sample is kept apart to fit the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sheetlake.llm.tables import arrow_map

#: Unknown: a text that is null or has no letter.
UNKNOWN = "und"
#: n-gram lengths, and buckets that n-grams are hashed to.
LENGTHS, BUCKETS = (1, 2, 3), 1 << 15
#: Bounds of the sample: rows a language (expected), and languages, the most frequent first.
PER_LANGUAGE, LANGUAGES = 800, 256
#: FTRL: learning rate, its smoothing, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.02, 0.05, 4

U = np.uint64
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket is met; None for a text without letters.

    The text is lowered; each run of other characters counts as one space, so do both ends.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = letter_table()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(U)
    grams, h = [], codes  # h: hash of the n-gram that starts at each place
    for n in range(1, min(max(LENGTHS), len(codes)) + 1):
        if n > 1:
            h = h[:-1] * U(0x100000001B3) + codes[n - 1 :]
        if n in LENGTHS:
            grams.append(((h + U(n)) * U(0x9E3779B97F4A7C15)) >> U(64 - 15))
    return np.bincount(np.concatenate(grams).view(np.int64), minlength=BUCKETS)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of length one."""
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    return at.astype(np.int32), (value / np.sqrt((value * value).sum())).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability; the first by name of equally likely ones."""
        counts = gram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, value = vector(counts, self.idf)
        p = softmax(value @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's text is 0 modulo 5, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int
) -> np.ndarray:
    """Weights from (buckets, values, class) rows by FTRL-proximal steps, one row at a time."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(PASSES):
        for at, value, label in rows:
            own_z, own_n = z[at], n[at]
            w = weights(own_z, own_n)
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            more = own_n + g * g
            z[at] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / ALPHA * w
            n[at] = more
    return weights(z, n).astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    Labels count as right with (n + 1) / (n + 2) for n rows, so a faultless sample gives no certainty.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(labels) + 2)
    target = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - doubt

    def loss(log_t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-30))).sum())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts with letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    met += counts > 0
                    total += 1
        at = np.flatnonzero(met)
        yield pa.record_batch(
            [pa.array(np.append(at, -1)), pa.array(np.append(met[at], total))], names=["bucket", "n"]
        )

    rows = arrow_map(docs.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency, total = np.zeros(BUCKETS, np.int64), 0
    for bucket, n in rows.collect():  # BUCKETS rows at most
        if bucket < 0:
            total = n
        else:
            frequency[bucket] = n
    return frequency, total


def fit(docs: DataFrame) -> LanguageModel:
    """A model from the rows of ``docs`` (doc_id, text, lang) that are not held out and have a lang.

    Without such rows the model knows no language and predicts "und" for every text.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    by_language = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in by_language)
    frequency, total = document_frequencies(rows)
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    share = F.lit(None)
    for r in by_language:
        share = F.when(F.col("lang") == r["lang"], min(1.0, PER_LANGUAGE / r["count"])).otherwise(share)
    dealt = F.xxhash64("text", "doc_id")
    sample = rows.select("text", "lang", dealt.alias("dealt")).where(
        F.pmod(dealt, F.lit(1 << 20)) < share * (1 << 20)
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang, number in zip(*batch.columns, strict=True):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    at, value = vector(counts, idf)
                    out.append((lang.as_py(), number.as_py(), at.tobytes(), value.tobytes()))
            if out:
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["lang", "dealt", "at", "value"],
                )

    # bounded: about PER_LANGUAGE rows for each of at most LANGUAGES languages
    drawn = sorted(
        arrow_map(sample, vectors, "lang string, dealt long, at binary, value binary").collect(),
        key=lambda r: (r["dealt"], r["lang"]),
    )
    data = [
        (np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32), languages.index(r["lang"]))
        for r in drawn
    ]
    apart = [k for k in range(len(data)) if k % 5 == 4]
    weights = train_ftrl([x for k, x in enumerate(data) if k % 5 != 4], max(1, len(languages)))
    logits = np.array([data[k][1] @ weights[data[k][0]] for k in apart]).reshape(len(apart), weights.shape[1])
    temperature = fit_temperature(logits, np.array([data[k][2] for k in apart], int))
    return LanguageModel(languages, weights, idf, temperature)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, with lang_pred and score (0 to 1).

    One row per row, repeated ones included; a null text or one without letters is "und" with score 0;
    only the text is looked at.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x LANGUAGES weights at most
    text_at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shared.value.predict(t.as_py()) for t in part.column(0).field(text_at)]
                yield pa.record_batch(
                    [part.column(0), pa.array([x for x, _ in found], pa.string()),
                     pa.array([p for _, p in found], pa.float64())],
                    names=["row", "lang_pred", "score"],
                )

    found = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return arrow_map(rows, predict, found)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model fitted on ``docs`` itself."""
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that are not "und", and whose language has a probability of ``least`` or more.

    Where no language could be learned, all rows whose text has a letter.
    """
    model = fit(docs)
    if not model.languages:
        model = LanguageModel(["any"], np.zeros((BUCKETS, 1), np.float32), np.ones(BUCKETS, np.float32), 1.0)
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
