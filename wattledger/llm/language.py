"""Language identification with a string kernel.

Two texts are as similar as the share of byte n-grams of several lengths that
occur in both (blended spectrum, presence only). A bounded, balanced sample of
labelled texts gives landmarks (Nyström) and one ridge regression per language
against the rest. The value of a text for a language is a weighted sum of its
kernel values with the landmarks; these are products with the landmarks' n-gram
matrix, so the weights are folded into it once and a batch of texts is scored by
one matrix product of its presence matrix.

N-grams are hashed to 2^BITS columns, which bounds the model. Texts are whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import fold_of, table

BITS = 15
LENGTHS = (2, 3, 4)
# Different labelled texts per language, at most, by the smallest hashes; the first of them are landmarks.
TRAIN_PER_LANGUAGE = 500
LANDMARKS_PER_LANGUAGE = 120
# More than four languages share out TRAIN_ROWS, but each keeps LEAST_PER_LANGUAGE rows and one landmark.
TRAIN_ROWS = 2000
LEAST_PER_LANGUAGE = 30
RIDGE = 1e-3
# One in so many learned rows is held out to set the margin, which takes at least LEAST_HELD_OUT such rows.
HOLD_OUT = 4
LEAST_HELD_OUT = 100
_BATCH_ROWS = 128
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages, a weight for each n-gram column and language, a constant for each language, and margins.

    A text whose best value is below that language's margin is in none of them; all are 0 where too few rows are
    learned from.
    """

    languages: tuple[str, ...]
    weights: np.ndarray
    constant: np.ndarray
    margins: tuple[float, ...] = ()


def _gram_columns(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every n-gram of every length within a row; A-Z as a-z."""
    folded = data.astype(np.uint32)
    folded[(data >= 65) & (data <= 90)] += 32
    rows, columns = [], []
    code = folded
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in range(2, max(LENGTHS) + 1):
        code = (code[:-1] << np.uint32(8)) | folded[n - 1:] if len(code) > 1 else code[:0]
        if n not in LENGTHS:
            continue
        own = row_of[:len(code)]
        inside = own == row_of[n - 1:] if len(code) else np.zeros(0, bool)
        h = code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        rows.append(own[inside])
        columns.append((h >> np.uint32(32 - BITS))[inside])
    return np.concatenate(rows), np.concatenate(columns)


def _presence(text: pa.Array):
    """Presence matrices of runs of rows: (first row, matrix of 0 and 1)."""
    for first, data, offsets in tb.slices(text):
        for at in range(0, len(offsets) - 1, _BATCH_ROWS):
            part = offsets[at:at + _BATCH_ROWS + 1]
            x = np.zeros((len(part) - 1, 1 << BITS), np.float32)
            rows, columns = _gram_columns(data[part[0]:part[-1]], part - part[0])
            x[rows, columns] = 1
            yield first + at, x


def _packed_presence(text: pa.Array) -> pa.Array:
    """The columns present in each text, one bit each."""
    return pa.array([row.tobytes() for _, x in _presence(text) for row in np.packbits(x > 0, axis=1)], pa.binary())


def has_letter(column: str = "text"):
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def training_rows(documents: DataFrame) -> DataFrame:
    """(lang, rank, grams): at most TRAIN_PER_LANGUAGE rows of every language.

    A text counts once however often it occurs. Rows without a language, or whose text has no letter, are left out.
    """
    keyed = documents.select("lang", "text", F.xxhash64("text").alias("key")).filter(F.col("lang").isNotNull() & has_letter())
    counts = keyed.groupBy("lang", "key").count()
    n = counts.select("lang").distinct().count()
    each = min(TRAIN_PER_LANGUAGE, max(LEAST_PER_LANGUAGE, TRAIN_ROWS // max(n, 1)))
    # The smallest hashes of a language: first of each hash range, so that no task sees a whole language.
    order = F.xxhash64("key")
    salted = counts.select("lang", "key", order.alias("order"), F.pmod(order, F.lit(64)).alias("salt"))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("order", "key"))).filter(F.col("r") <= each)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "key"))).filter(F.col("rank") <= each)
    picked = F.broadcast(ranked.select("lang", "key", "rank"))
    joined = keyed.join(picked, ["lang", "key"]).dropDuplicates(["lang", "rank"])
    return joined.select("lang", "rank", F.arrow_udf(_packed_presence, "binary")("text").alias("grams"))


def train(documents: DataFrame) -> Model | None:
    """Learn from (doc_id, lang, text); None without any labelled row.

    At most TRAIN_ROWS rows of 2^BITS bits reach the driver, or LEAST_PER_LANGUAGE for each language if that is more.
    """
    rows = sorted(training_rows(documents).collect(), key=lambda r: (r["lang"], r["rank"]))
    if not rows:
        return None
    languages = tuple(dict.fromkeys(r["lang"] for r in rows))
    bits = np.array([np.frombuffer(r["grams"], np.uint8) for r in rows])
    y = np.array([[r["lang"] == k for k in languages] for r in rows], float)
    marks_each = min(LANDMARKS_PER_LANGUAGE, max(1, TRAIN_ROWS // len(languages)))
    is_mark = np.array([r["rank"] <= marks_each for r in rows])
    marks = _normalized(bits[is_mark])
    kernel = np.concatenate([_normalized(bits[i:i + _BATCH_ROWS]) @ marks.T for i in range(0, len(bits), _BATCH_ROWS)]).astype(float)
    own = (marks @ marks.T).astype(float)
    alpha, constant = _solved(kernel, own, y)
    held = np.array([r["rank"] % HOLD_OUT == 0 for r in rows])
    share = _margin(kernel, own, y, held, held[is_mark])
    margins = tuple((constant + share * (1 - constant)).tolist()) if share else (0.0,) * len(languages)
    return Model(languages, marks.T @ alpha.astype(np.float32), constant, margins)


def _solved(kernel: np.ndarray, own: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the landmarks and constants by language, from the kernel values of rows and of landmarks with the landmarks."""
    constant = np.full(y.shape[1], 1 / y.shape[1])
    weight = np.ones(len(y)) / np.maximum(y.sum(0), 1)[y.argmax(1)]  # languages count alike
    left = kernel.T @ (kernel * weight[:, None]) + RIDGE * own + 1e-9 * np.eye(len(own))
    return np.linalg.lstsq(left, kernel.T @ ((y - constant) * weight[:, None]), rcond=None)[0], constant


def _margin(kernel: np.ndarray, own: np.ndarray, y: np.ndarray, held: np.ndarray, held_marks: np.ndarray) -> float:
    """Half the lowest certainty of rows that were held out, or 0 without enough of them.

    Certainty is a text's best value on the way from its language's constant, which texts like nothing get, to 1.
    """
    if held.sum() < LEAST_HELD_OUT or y.shape[1] < 2:
        return 0.0
    marks = np.flatnonzero(~held_marks)
    alpha, constant = _solved(kernel[~held][:, marks], own[np.ix_(marks, marks)], y[~held])
    value = kernel[held][:, marks] @ alpha + constant
    best = value.argmax(1)
    return max(0.0, float(((value.max(1) - constant[best]) / (1 - constant[best])).min()) / 2)


def _normalized(bits: np.ndarray) -> np.ndarray:
    """Presence rows of unit length from packed bits."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def predict_udf(model: Model | None):
    """text -> struct(lang_pred, score) for texts with a letter; the score is the language's value cut to 0..1.

    Ties go to the first language in the order of names. Without a model, everything is unknown with score 0.
    """
    languages = np.array(model.languages if model else [UNKNOWN], object)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        names, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        if model:
            for at, x in _presence(text):
                size = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                value = (x @ model.weights) / size + model.constant
                best = value.argmax(1)
                names[at:at + len(x)] = languages[best]
                scores[at:at + len(x)] = np.clip(value[np.arange(len(x)), best], 0, 1)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return predict


def predicted(model: Model | None, column: str = "text"):
    """The prediction as a struct column: unknown with score 0 where the text is null or has no letter."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(has_letter(column), predict_udf(model)(column)).otherwise(unknown)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text)."""
    return documents.select("doc_id", predicted(model).alias("p")).select("doc_id", "p.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; languages are learned from those whose crc32 modulo 4 is not 2."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents.filter(fold_of("doc_id", 4) != 2))
    return identify(documents, model).withColumn("held_out", fold_of("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")
