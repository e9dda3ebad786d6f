"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's features are the counts of its hashed byte n-grams (``GRAMS``), over the whole text. The model averages the
n-grams' embeddings and applies a linear softmax; folded into one table, a prediction is a product of counts and table.
The classifier is fitted on a bounded sample of labelled rows: at most ``PER_LANGUAGE`` rows a language and ``MOST_ROWS``
altogether, chosen by the hash of doc_id. A fifth of the sample is kept from the fit to calibrate the softmax temperature
and the rejection threshold, which is set so that at most ``REJECTED`` of it, and nothing above ``SURE``, is rejected.

Defined cases: a null text or one without a letter has ``lang_pred = und``, score 0 and is rejected; with nothing to
learn from, all rows are ``und``; repeated rows get equal results; an empty table gives no rows; texts of any length are
read whole; other columns are never read by a prediction and keep their names and values, whatever they are called.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.keys import fresh
from weftline.llm.tokens import blocks, bounded_batches

GRAMS, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 13, 16
PER_LANGUAGE, MOST_ROWS, EPOCHS, RATE = 500, 4000, 30, 0.5
REJECTED, SURE = 0.001, 0.5
UND = "und"

_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of a whole text."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    out, h = np.zeros(BUCKETS, np.int64), np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            out += np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


class Counts:
    """Rows of counts of buckets, from bytes as ``features`` sends them. Only rows that are asked for are held with their zeros."""

    def __init__(self, packed: list[bytes]):
        self.bucket, self.count = [], []
        for p in packed:
            row = np.frombuffer(zlib.decompress(p), "<u4")
            some = np.flatnonzero(row)
            self.bucket.append(some.astype(np.uint16))
            self.count.append(row[some])

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.uint32)
        for row, i in zip(out, rows, strict=True):
            row[self.bucket[i]] = self.count[i]
        return out

    def __iter__(self):
        return (self[[i]][0] for i in range(len(self.count)))

    def max(self) -> int:
        return max((int(c.max(initial=0)) for c in self.count), default=0)


def shares(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    return x


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights, divided by the temperature
    bias: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities for rows of counts."""
        logits = (x / np.maximum(x.sum(1, keepdims=True), 1)) @ self.table + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def gradients(x: np.ndarray, y: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean loss of rows of shares ``x`` by embeddings ``e``, weights ``w`` and bias ``b``."""
    hidden = x @ e
    logits = hidden @ w + b
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(x)), y] -= 1
    p /= len(x)
    return x.T @ (p @ w.T), hidden.T @ p, p.sum(0)


def train(x: Counts | np.ndarray, y: np.ndarray, languages: list[str], held: np.ndarray, seed: int = 11) -> Model:
    """Fit on rows of counts ``x`` with language numbers ``y``; rows where ``held`` calibrate."""
    rng, k = np.random.default_rng(seed), len(languages)
    fit = np.flatnonzero(~held)
    e, w, b = rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    scale = np.float32(50)  # averaged counts are small; rows of e move in proportion
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            of_e, of_w, of_b = gradients(shares(x[rows]), y[rows], e, w, b)
            w -= rate * of_w
            b -= rate * of_b
            e -= rate * scale * of_e
    table = (e @ w).astype(np.float64)
    use = np.flatnonzero(held if held.any() else ~held)
    asked = shares(x[use])
    logits, truth = asked @ table + b, y[use]

    def loss(t):
        z = logits / t
        return (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), truth]).mean()

    temperature = min(np.geomspace(0.05, 20, 60), key=loss) if len(truth) else 1.0
    model = Model(languages, table / temperature, b / temperature, 0.0)
    if len(truth):
        model.threshold = float(min(SURE, np.quantile(model.scores(asked).max(1), REJECTED)))
    return model


def fit(docs: DataFrame) -> Model | None:
    """The model of the labelled rows of ``docs`` outside the held-out fold; None if there are none."""
    bounded_batches(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter((fold != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A language's rows are thinned by hash to about twice what is wanted before they are ranked together.
    often = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_ROWS).select(F.col("lang").alias("o_lang"), F.col("n").alias("often"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    thinned = rows.select("doc_id", "lang").join(F.broadcast(often), F.col("lang") == F.col("o_lang")).filter(draw * F.col("often") < 2 * PER_LANGUAGE)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    chosen = thinned.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PER_LANGUAGE)
    chosen = chosen.orderBy("n", "lang").limit(MOST_ROWS).select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang")).distinct()

    def features(batches):
        for batch in batches:
            out = [counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zlib.compress(x.astype("<u4").tobytes(), 1) for x in out], pa.binary())], names=["doc_id", "lang", "x"])

    met = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("c_id")) & (F.col("lang") == F.col("c_lang"))).select("doc_id", "lang", "text")
    # One row a doc_id and language, so that repeated rows cannot pass the bound.
    got = met.mapInArrow(features, "doc_id long, lang string, x binary").groupBy("doc_id", "lang").agg(F.min("x").alias("x")).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["doc_id"]))
    languages = sorted({r["lang"] for r in got})
    y = np.array([languages.index(r["lang"]) for r in got])
    return train(Counts([r["x"] for r in got]), y, languages, np.arange(len(got)) % 5 == 0)


def predict_texts(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """``(language, score, rejected)`` of each text."""
    out = [(UND, 0.0, True)] * len(texts)
    at = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    if at:
        p = model.scores(np.stack([counts(texts[i]) for i in at]))
        best = p.argmax(1)
        for i, row, k in zip(at, p, best.tolist(), strict=True):
            out[i] = (model.languages[k], float(row[k]), bool(row[k] < model.threshold))
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every column of ``docs`` and, last, three of other names: language, score and whether ``text`` is rejected."""
    bounded_batches(docs.sparkSession)
    names, made = docs.columns, fresh(docs.columns, "lang_pred", "score", "rejected")
    text, held = names.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches):
        for batch in batches:
            texts = batch.column(text)
            got = [x for lo, hi in blocks(texts, 256) for x in predict_texts(held.value, texts[lo:hi].to_pylist())]
            extra = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *made])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, *(StructField(n, t()) for n, t in zip(made, (StringType, DoubleType, BooleanType), strict=True))])
    return docs.mapInArrow(per_batch, schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row."""
    rows = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected or undetermined."""
    rows = identify(docs, fit(docs))
    return rows.filter(~F.col(rows.columns[-1])).drop(*rows.columns[-3:])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
