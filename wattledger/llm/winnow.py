"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive k-grams of words the one with the smallest hash
is a fingerprint (the rightmost of equals). Two texts that share ``K + WINDOW - 1``
consecutive words share the fingerprint of that span, so joining fingerprints
finds every shared span of that length. Each hit carries the word hashes around
it and is extended to both sides as far as the words agree; it counts if the
span has at least that many words. Items of fewer words are looked up whole.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bit_filter, in_filter, stored, table, text_key

SPAN = 10  # words that must agree
K = 5
WINDOW = SPAN - K + 1
# Bits of the filter that spares documents the join; fixed, whatever the size of the benchmark.
FILTER_BITS = 1 << 24
_AROUND = WINDOW - 1  # words kept on either side of a fingerprint

_PRINTS = "array<struct<h: bigint, pos: int, size: int, around: array<bigint>>>"


def _selected(found: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the fingerprints of every row with at least SPAN words."""
    every = tb.grams(found.hash, K)
    n = len(found.row) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    window = np.flatnonzero(found.row[:n] == found.row[SPAN - 1:])
    best, at = every[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, WINDOW):
        other = every[i:i + n]
        less = other <= best  # the rightmost of equals
        best[less] = other[less]
        at[less] = i
    picked = np.unique(window + at[window])
    return picked, every[picked]


def _around(found: tb.Words, at: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Word hashes from _AROUND before a fingerprint to _AROUND behind it; 0 beyond the text."""
    index = at[:, None] + np.arange(-_AROUND, K + _AROUND)
    inside = (index >= found.first[row_of][:, None]) & (index < found.first[row_of + 1][:, None])
    words = found.hash | np.uint64(1)  # never 0
    return np.where(inside, words[np.clip(index, 0, max(len(words) - 1, 0))], np.uint64(0))


def _prints_udf(may_match: np.ndarray | None, short: tuple[int, ...]):
    """text -> (number of words, fingerprints). ``may_match``: keep only hashes whose bit is set.

    ``short``: lengths of items below SPAN words; every such run of words is a
    fingerprint of that size. Without a filter the text is an item: a short one is
    its whole text.
    """

    def keep(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if may_match is None:
            return at, h
        known = in_filter(may_match, h)
        return at[known], h[known]

    @F.arrow_udf(f"struct<n: bigint, prints: {_PRINTS}>")
    def prints(text: pa.Array) -> pa.Array:
        counts, parts = [], []
        for first_row, data, offsets in tb.slices(text):
            found = tb.words(data, offsets, tb.NOT_ALNUM)
            n = np.diff(found.first)
            counts.append(n)
            at, h = keep(*_selected(found))
            row = found.row[at]
            parts.append((row + first_row, at - found.first[row], np.full(len(at), SPAN), h, _around(found, at, row)))
            for m in short:
                if may_match is None:
                    rows = np.flatnonzero(n == m)
                    at = found.first[rows]
                    h = tb.grams(found.hash, m)[at] if len(rows) else np.zeros(0, np.uint64)
                else:
                    at, h = keep(*tb.grams_in_rows(found, m))
                row = found.row[at]
                parts.append((row + first_row, at - found.first[row], np.full(len(at), m), h, np.zeros((len(at), 2 * _AROUND + K), np.uint64)))
        return _struct(len(text), counts, parts)

    return prints


def _struct(n_rows: int, counts: list, parts: list) -> pa.Array:
    if not n_rows:
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros((0, 2 * _AROUND + K), np.uint64))]
    row, pos, size, h, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    width = 2 * _AROUND + K
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(len(row) + 1) * width, pa.int32()), pa.array(around[order].reshape(-1).view(np.int64)))
    prints = pa.StructArray.from_arrays([
        pa.array(h[order].view(np.int64)), pa.array(pos[order], pa.int32()), pa.array(size[order], pa.int32()), lists,
    ], ["h", "pos", "size", "around"])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))]) if n_rows else np.zeros(1, np.int64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), prints)], ["n", "prints"])


def contamination(documents: DataFrame, items: DataFrame, with_key: bool = False) -> DataFrame:
    """Which words of each document stand in an item's text.

    ``documents`` (doc_id, text), ``items`` (item_id, text). Words are runs of
    letters, digits and characters outside ASCII, A-Z as a-z. Returns per row of
    documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; ``with_key``
    adds key, a 64-bit hash of the text.

    A null or empty text has no words; an item without words hits nothing. Rows
    with one doc_id are judged by their own texts each. Items with one text all
    count; a null item_id counts for hits only.
    """
    items = items.select("item_id", "text").distinct()
    item_prints = stored(
        items.select("item_id", _prints_udf(None, tuple(range(1, SPAN)))("text").alias("p"))
        .select("item_id", F.explode("p.prints").alias("x")).select("item_id", "x.*"), "item-prints")
    may_match = bit_filter(item_prints, "h", FILTER_BITS)
    short = tuple(sorted(r[0] for r in item_prints.filter(F.col("size") < SPAN).select("size").distinct().collect()))
    scanned = stored(documents.select("doc_id", text_key().alias("key"), _prints_udf(may_match, short)("text").alias("p")), "doc-prints")
    prints = scanned.select("doc_id", "key", F.explode("p.prints").alias("x")).select("doc_id", "key", "x.*").distinct()
    hits = _extended(prints, item_prints)
    per_item = hits.select("doc_id", "key", "item_id").distinct().groupBy("doc_id", "key").agg(
        F.count("item_id").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    per_word = _covered(hits.select("doc_id", "key", "a", "b").distinct()).groupBy("doc_id", "key").agg(F.sum("fresh").alias("n_hit"))
    found = per_word.join(per_item, per_word["doc_id"].eqNullSafe(per_item["doc_id"]) & (per_word["key"] == per_item["key"])).select(
        per_word["doc_id"], per_word["key"], "n_hit", "n_items", "items_sha256")
    every = scanned.select("doc_id", "key", F.col("p.n").alias("n_words"))
    joined = every.join(found, every["doc_id"].eqNullSafe(found["doc_id"]) & (every["key"] == found["key"]), "left")
    return joined.select(
        every["doc_id"], *([every["key"]] if with_key else []), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _extended(prints: DataFrame, item_prints: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, a, b): spans [a, b) of words that agree with the item, at least SPAN or a whole short item."""
    item = item_prints.select("item_id", "h", "size", F.col("around").alias("item_around"))
    joined = prints.join(item, ["h", "size"])

    def agreeing(places: range):
        """How many of these places agree, from the first up to the first that does not."""
        run, out = F.lit(True), F.lit(0)
        for i in places:
            run = run & (F.col("around")[i] == F.col("item_around")[i]) & (F.col("around")[i] != 0)
            out = out + run.cast("int")
        return out

    middle = F.lit(True)
    for i in range(_AROUND, _AROUND + K):
        middle = middle & (F.col("around")[i] == F.col("item_around")[i])
    left = agreeing(range(_AROUND - 1, -1, -1))
    right = agreeing(range(_AROUND + K, 2 * _AROUND + K))
    spans = joined.select("doc_id", "key", "item_id", "pos", "size", left.alias("left"), right.alias("right"), middle.alias("same"))
    long = (F.col("size") == SPAN) & F.col("same") & (F.col("left") + F.col("right") + K >= SPAN)
    return spans.filter((F.col("size") < SPAN) | long).select(
        "doc_id", "key", "item_id",
        F.when(F.col("size") < SPAN, F.col("pos")).otherwise(F.col("pos") - F.col("left")).alias("a"),
        F.when(F.col("size") < SPAN, F.col("pos") + F.col("size")).otherwise(F.col("pos") + K + F.col("right")).alias("b")).distinct()


def _covered(spans: DataFrame) -> DataFrame:
    """Adds ``fresh``: the words of a span that no span before it, in order of its start, covers."""
    before = Window.partitionBy("doc_id", "key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("b").over(before), F.lit(0))
    return spans.withColumn("fresh", F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), seen)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
