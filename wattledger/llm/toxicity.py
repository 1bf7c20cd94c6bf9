"""Toxic passages as maximum-scoring segments of word log-odds.

A word's score is the log-odds of toxic against other labelled texts under a
Dirichlet prior that follows the word's share of the whole corpus, shrunk by its
standard errors, less a small drift, so that ordinary text loses. Rare forms of a
stem share their first bytes: of the log-odds of a word and of its prefixes the
strongest counts. A linear scan finds all maximal scoring segments of a text. The best score of a clean text of
n words follows an extreme-value distribution, P(S > x) = 1 - exp(-K n e^(-lambda x)),
which turns scores into significance whatever the length of a text. All passages of a text
count: the sum of its r best normalised scores has an extreme-value law of its own, and the r with
the strongest evidence stands. The probability of a label is a logistic curve over that. The law's
parameters and the curve come from labelled rows that the log-odds they are seen with were not learned from.

Words and prefixes are hashed to 2^BUCKET_BITS buckets each, which bounds the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import fold_of, stored, table

BUCKET_BITS = 18
PREFIXES = (4, 6, 8)
# Labelled texts of each class that the scores are learned from, at most: those with the smallest hashes of their ids.
TRAIN_PER_CLASS = 8_000
PRIOR_WORDS = 20_000.0  # weight of the prior, in words, besides half a word for each bucket
CERTAINTY = 2.5  # standard errors that a log-odds is shrunk by
DRIFT = 0.08  # what every word loses
SIGNIFICANCE = 0.01  # of a passage
FOLDS = 3  # parts of the labelled texts: each is scored by the log-odds of the others
_N_BUCKETS = (1 + len(PREFIXES)) << BUCKET_BITS


@dataclass(frozen=True)
class Model:
    """Log-odds by bucket, the extreme-value parameters and the logistic curve."""

    odds: np.ndarray
    rate: float
    scale: float
    curve: tuple[float, float]

    def expected(self, n_words: np.ndarray) -> np.ndarray:
        """Normalised score that one segment of clean text of this length exceeds: log(K n)."""
        return np.log(self.scale * np.maximum(n_words, 1))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(evidence), -30, 30)))


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[tb.Words, list[np.ndarray]]:
    """The words of a slice of rows, their buckets, and the buckets of their prefixes of each length."""
    start, end, first = tb.bounds(~tb.NOT_ALNUM[data], offsets)
    ranges = [(start, end), *((start, np.minimum(end, start + n)) for n in PREFIXES)]
    every = tb.range_hashes(data, ranges)
    shift = np.uint64(64 - BUCKET_BITS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return tb.Words(start, end, row, every[0], first), [(h >> shift).astype(np.int64) + (i << BUCKET_BITS) for i, h in enumerate(every)]


def _first_of_text(found: tb.Words) -> np.ndarray:
    """Indices of the words that their text does not hold before, ascending."""
    key = tb.mix(found.hash + found.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.unique(key, return_index=True)[1])


def _scored(odds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[tb.Words, np.ndarray]:
    """The words of a slice of rows and their scores; a word that comes again in its text says nothing new."""
    found, buckets = _buckets(data, offsets)
    once = _first_of_text(found)
    strongest = odds[buckets[0][once]]
    for prefix in buckets[1:]:
        other = odds[prefix[once]]
        strongest = np.where(np.abs(strongest) >= np.abs(other), strongest, other)
    score = np.full(len(found.row), -DRIFT)
    score[once] += strongest
    return found, score


def count_words(texts: DataFrame) -> DataFrame:
    """(bucket, n): words and prefixes of the column ``text`` of all rows by bucket, each word once per text.

    Standard errors hold for words that come independently, which the repeats of one text do not.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N_BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in tb.slices(batch.column(0)):
                found, every = _buckets(data, offsets)
                once = _first_of_text(found)
                for buckets in every:
                    np.add.at(total, buckets[once], 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts: DataFrame) -> np.ndarray:
    """Counts by bucket on the driver; bounded by the number of buckets."""
    rows = counts.toArrow()
    out = np.zeros(_N_BUCKETS)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def _run_sums(score: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, total) of maximal runs of words of one row whose scores have one sign."""
    if not len(score):
        return np.zeros(0, np.int64), np.zeros(0)
    positive = score > 0
    heads = np.flatnonzero(np.concatenate([[True], (positive[1:] != positive[:-1]) | (row[1:] != row[:-1])]))
    return heads, np.add.reduceat(score, heads)


def best_segments(found: tb.Words, score: np.ndarray) -> np.ndarray:
    """By row, the score of its best segment; 0 if no word scores."""
    n_rows = len(found.first) - 1
    best = np.zeros(n_rows)
    heads, total = _run_sums(score, found.row)
    if not len(heads):
        return best
    # Within a row, the best segment ends where the running sum is highest above its lowest point so far. Rows are
    # kept apart by a step down that is larger than any sum.
    row = found.row[heads]
    step = (np.abs(total).sum() + 1.0) * 2
    after = np.cumsum(total) - row * step
    before = after - total
    rise = after - np.minimum.accumulate(before)
    np.maximum.at(best, row, rise)
    return best


def segments(heads: np.ndarray, total: np.ndarray, end: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of one text: (first word, word after the last, score), in order.

    ``heads`` and ``total`` are runs of words with scores of one sign, ``end`` the
    word after the last run. Linear in the number of runs.
    """
    # start, end, sum before the segment, sum up to its end, index of the nearest one before with a lower sum before it
    out: list[list[float]] = []
    running = 0.0
    bounds = np.append(heads, end)
    for i, value in enumerate(total.tolist()):
        running += value
        if value <= 0:
            continue
        current = [bounds[i], bounds[i + 1], running - value, running, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= current[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= current[3]:
                break
            # The segment that starts lower and ends lower joins this one, with all between.
            current[0], current[2] = out[j][0], out[j][2]
            del out[j:]
        current[4] = j
        out.append(current)
    return [(int(a), int(b), float(up - low)) for a, b, low, up, _ in out]


def sum_evidence(values: np.ndarray) -> float:
    """-log of the probability that clean text has passages like these, given as normalised scores above 0.

    By chance the r highest sum to x with a probability of about e^-x x^(r-1) / (r! (r-1)!). The r with the least one
    counts; since the result chooses it, each passage after the first has to be twice as unlikely.
    """
    total = np.cumsum(np.sort(values)[::-1])
    r = np.arange(1, len(total) + 1)
    ways = np.cumsum(np.log(r))
    return max(0.0, float((total - (r - 1) * np.log(2 * total) + 2 * ways - np.log(r)).max(initial=0.0)))


def passages_of(model: Model, found: tb.Words, score: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """By row, the evidence of all its passages that clean text has less than once, and those passages in order."""
    best, expected = best_segments(found, score), model.expected(np.diff(found.first))
    evidence, passages = np.zeros(len(best)), [[] for _ in best]
    for r in np.flatnonzero((best > 0) & (model.rate * best > expected)):
        a, b = found.first[r], found.first[r + 1]
        heads, total = _run_sums(score[a:b], found.row[a:b])
        passages[r] = [s for s in segments(heads, total, b - a) if model.rate * s[2] > expected[r]]
        evidence[r] = sum_evidence(model.rate * np.array([s[2] for s in passages[r]]) - expected[r])
    return evidence, passages


def log_odds(toxic: np.ndarray, other: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Shrunk log-odds by bucket, 0 where the labelled texts say too little or a class has none."""
    out = np.zeros(len(corpus), np.float32)
    if not toxic.sum() or not other.sum():
        return out
    for part in np.split(np.arange(len(corpus)), 1 + len(PREFIXES)):  # words, and prefixes of each length
        share = corpus[part] + 0.01
        a, b = (n[part] + 0.5 + PRIOR_WORDS * share / share.sum() for n in (toxic, other))
        odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
        error = CERTAINTY * np.sqrt(1 / a + 1 / b)
        out[part] = np.sign(odds) * np.maximum(np.abs(odds) - error, 0)
    return out


def score_histogram(texts: DataFrame, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores in steps of 0.01, share of words) of the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tb.slices(batch.column(0)):
                step, n = np.unique(np.rint(_scored(odds, data, offsets)[1] * 100).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n, pa.int64())], ["step", "n"])

    rows = texts.select("text").mapInArrow(count, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    step, n = rows["step"].to_numpy(), rows["n"].to_numpy()
    return step / 100, n / max(n.sum(), 1)


def _rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum(share * exp(rate * score)) = 1."""
    if not (score[share > 0] > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    excess = lambda x: float((share * np.exp(np.minimum(x * score, 700))).sum() - 1)
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature by Newton's method, with a little ridge; a row counts ``weight`` times."""
    if not len(y) or y.min() == y.max():
        return (-4.0 if not len(y) or y.max() == 0 else 4.0), 0.0
    w, features = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (y - p)) - 1e-3 * w
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hessian, gradient)
    return float(w[0]), float(w[1])


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, weight): at most TRAIN_PER_CLASS rows of either class, by the smallest hashes of their ids.

    weight is how many rows of its class each stands for, so that the classes keep
    their share of all labels whatever the size of the table. Rows without an id or a label are left out; an id that is labelled both ways is toxic.
    """
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    weight = [max(1.0, there.get(t, 0) / TRAIN_PER_CLASS) for t in (0, 1)]
    pick = [one.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_PER_CLASS).withColumn("weight", F.lit(weight[t])) for t in (0, 1)]
    return pick[0].unionByName(pick[1])


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from (doc_id, text) and (doc_id, toxic); word shares come from all documents, labels from a bounded sample."""
    corpus = _as_array(count_words(documents))
    # At most 2 * TRAIN_PER_CLASS short rows.
    picked = F.broadcast(training_labels(labels).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS))))
    sample = stored(documents.select("doc_id", "text").join(picked, "doc_id").select("text", "toxic", "weight", "fold"), "toxic-train")
    folds = [sample.filter(F.col("fold") == f) for f in range(FOLDS)]
    counts = [[_as_array(count_words(rows.filter(F.col("toxic") == t))) for t in (1, 0)] for rows in folds]
    toxic, other = (sum(c[t] for c in counts) for t in (0, 1))
    parts, seen = [], []
    for rows, (a, b) in zip(folds, counts, strict=True):
        parts.append(_calibrated(rows, log_odds(toxic - a, other - b, corpus)))
        seen.append(rows.select("toxic", "weight", _evidence_udf(parts[-1])("text").alias("evidence")).toArrow())
    evidence, y, weight = (np.concatenate([rows[c].to_numpy().astype(float) for rows in seen]) for c in ("evidence", "toxic", "weight"))
    rate, scale = (float(np.exp(np.mean([np.log(getattr(m, name)) for m in parts]))) for name in ("rate", "scale"))
    return Model(log_odds(toxic, other, corpus), rate, scale, _fit_curve(np.log1p(evidence), y, weight))


def _calibrated(rows: DataFrame, odds: np.ndarray) -> Model:
    """The extreme-value law of these log-odds in the clean ones of rows (text, toxic) that they were not learned from."""
    clean = rows.filter("toxic = 0")
    rate = _rate(*score_histogram(clean, odds))
    found = clean.select(_best_udf(odds)("text").alias("b")).select("b.*").toArrow()
    best, n = (found[c].to_numpy().astype(float) for c in ("best", "n_words"))
    # Maximum likelihood of K given the rate, where a clean text in which nothing scores is one whose best is at most 0.
    expected = (n * np.exp(-rate * best)).sum()
    return Model(odds, rate, ((best > 0).sum() + 0.5) / expected if expected > 0 else 1.0, (0.0, 1.0))


def _best_udf(odds: np.ndarray):
    @F.arrow_udf("struct<best: double, n_words: bigint>")
    def best(text: pa.Array) -> pa.Array:
        top, n = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, data, offsets in tb.slices(text):
            found, score = _scored(odds, data, offsets)
            top.append(best_segments(found, score))
            n.append(np.diff(found.first))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(top)), pa.array(np.concatenate(n))], ["best", "n_words"])

    return best


def _evidence_udf(model: Model):
    @F.arrow_udf("double")
    def evidence(text: pa.Array) -> pa.Array:
        parts = [passages_of(model, *_scored(model.odds, data, offsets))[0] for _, data, offsets in tb.slices(text)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return evidence


def score_udf(model: Model):
    """text -> struct(score, n_words, n_passages, passages): passages are (first word, word after the last, score).

    A null text is an empty one: no words, no passages, the lowest score there is.
    """
    @F.arrow_udf("struct<score: double, n_words: bigint, passages: array<struct<first: int, until: int, score: double>>>")
    def scored(text: pa.Array) -> pa.Array:
        scores, words, bounds, firsts, untils, values = [np.zeros(0)], [np.zeros(0, np.int64)], [0], [], [], []
        for _, data, offsets in tb.slices(text):
            found, score = _scored(model.odds, data, offsets)
            n = np.diff(found.first)
            evidence, above = passages_of(model, found, score)
            scores.append(model.probability(evidence))
            words.append(n)
            needed = (model.expected(n) - np.log(SIGNIFICANCE)) / model.rate
            for r, row in enumerate(above):
                for first, until, value in row:
                    if value >= needed[r]:
                        firsts.append(first)
                        untils.append(until)
                        values.append(value)
                bounds.append(len(firsts))
        passages = pa.StructArray.from_arrays(
            [pa.array(firsts, pa.int32()), pa.array(untils, pa.int32()), pa.array(values, pa.float64())], ["first", "until", "score"])
        return pa.StructArray.from_arrays([
            pa.array(np.concatenate(scores)), pa.array(np.concatenate(words)),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), passages),
        ], ["score", "n_words", "passages"])

    return scored


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_words, passages) of every row of (doc_id, text), on whole texts."""
    return documents.select("doc_id", score_udf(model)("text").alias("s")).select("doc_id", "s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels are learned from those whose crc32 modulo 5 is not 0."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels.filter(fold_of("doc_id", 5) != 0))
    return score_documents(documents, model).select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
