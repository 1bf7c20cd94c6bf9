"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each place of a
word; the best segmentation up to there is carried as its score, its number of
pieces and whether it ends in an unknown character. Ties go as in the tokenizer:
scores are added from the left in double precision, a later candidate must be
strictly better, and candidates come by the place where they start. Characters
without a piece of their own may stand as unknown at ten below the lowest score;
neighbouring unknown ones are one token.

Spaces become marks and a text starts with one; words are cut before each mark
and segmented on their own, so the counts of different words are kept per worker.

The vocabulary is that of a public piece model, whose file ranks its pieces. A
piece's log-probability follows from its rank by Zipf's law.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import table
from .tokens import vocabulary_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Rank that is added before the logarithm.
ZIPF_SHIFT = 2.7
# A worker forgets its words when it holds this many; results do not depend on it.
CACHE_WORDS = 3_000_000
_GROUP_BYTES = 1 << 20
_IS_SPACE = np.arange(256) == 0x20
_MARK_BYTES = MARK.encode()


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log-probability): an unknown piece first, then the ordinary pieces of the file in their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return [("<unk>", 0.0), *((piece, -math.log(rank + ZIPF_SHIFT)) for rank, piece in enumerate(ordinary))]


class Counter:
    """Numbers of tokens of texts under (piece, score) pairs; the first is the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        # The unknown piece's own score counts for the lowest one as well.
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def count_word(self, word: str) -> int:
        """Pieces of the best segmentation."""
        n = len(word)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        reached = [True] + [False] * n
        done = 0  # places up to here are final

        def finish(place: int) -> None:
            """Unknown characters start last of all candidates for a place, so they come after its pieces."""
            start = place - 1
            if word[start] not in self.single:
                value = score[start] + self.unknown
                if not reached[place] or value > score[place]:
                    score[place], reached[place], unknown[place] = value, True, True
                    count[place] = count[start] + (not unknown[start])

        for last, (length, value) in self.pieces.iter(word):
            end = last + 1
            while done < last:
                done += 1
                finish(done)
            start = end - length
            value += score[start]
            if not reached[end] or value > score[end]:
                score[end], reached[end], unknown[end], count[end] = value, True, False, count[start] + 1
        while done < n:
            done += 1
            finish(done)
        return count[n]

    def count_text(self, text: str) -> int:
        """The same without the cache of words: marks, cuts and counts one text."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        return sum(self.count_word(MARK + word) for word in marked[1:].split(MARK))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of every text; null is an empty one and has none."""
        out, group, size = [np.zeros(0, np.int64)], [], 0
        for _, data, offsets in tb.slices(texts):
            if group and size + len(data) > _GROUP_BYTES:
                out.append(self._group(group))
                group, size = [], 0
            start, end, first = tb.bounds(~_IS_SPACE[data], offsets)
            group.append((data, offsets, start, end, first, tb.hashes(data, start, end, _exact_values())))
            size += len(data)
        if group:
            out.append(self._group(group))
        return np.concatenate(out)

    def _group(self, group: list[tuple]) -> np.ndarray:
        key, at, inverse = np.unique(np.concatenate([g[5] for g in group]), return_index=True, return_inverse=True)
        by_key = self._of_words(group, key, at)
        ends = np.concatenate([[0], np.cumsum(by_key[inverse])])
        alone = self.count_word(MARK)
        out, base = [], 0
        for data, offsets, start, _, first, _ in group:
            words = np.diff(ends[first + base])
            base += len(start)
            length = np.diff(offsets)
            spaces = np.concatenate([[0], np.cumsum(_IS_SPACE[data])])
            leading = np.zeros(len(length), np.int64)
            leading[length > 0] = _IS_SPACE[data[offsets[:-1][length > 0]]]
            # Cuts without a word between them, but for the one before a leading space.
            empty = np.diff(spaces[offsets]) + 1 - np.diff(first) - leading
            counts = np.where(length > 0, words + alone * empty, 0)
            for r in np.unique(np.searchsorted(offsets, _marks(data), side="right") - 1):
                counts[r] = self.count_text(data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8"))
            out.append(counts)
        return np.concatenate(out)

    def _of_words(self, group: list[tuple], key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Counts of words by their hash; new ones are segmented and kept."""
        place = np.searchsorted(self.keys, key)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == key[known]
        counts = np.zeros(len(key), np.int64)
        counts[known] = self.counts[place[known]]
        new = np.flatnonzero(~known)
        bases = np.cumsum([0, *(len(g[2]) for g in group)])
        which = np.searchsorted(bases, at[new], side="right") - 1
        for i, w, j in zip(new.tolist(), which.tolist(), (at[new] - bases[which]).tolist(), strict=True):
            data, _, start, end = group[w][:4]
            counts[i] = self.count_word(MARK + data[start[j]:end[j]].tobytes().decode("utf-8"))
        if len(self.keys) + len(new) > CACHE_WORDS:
            self.clear()
        every = np.concatenate([self.keys, key[new]])
        order = np.argsort(every, kind="stable")
        self.keys, self.counts = every[order], np.concatenate([self.counts, counts[new]])[order]
        return counts


@cache
def _exact_values() -> np.ndarray:
    return tb.mix(np.arange(5001, 5257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _marks(data: np.ndarray) -> np.ndarray:
    """Places where a text holds the mark itself."""
    first = np.flatnonzero(data[:-2] == _MARK_BYTES[0]) if len(data) > 2 else np.zeros(0, np.int64)
    return first[(data[first + 1] == _MARK_BYTES[1]) & (data[first + 2] == _MARK_BYTES[2])]


@cache
def _counter(path: str) -> Counter:
    """The one counter of this worker process for a model file."""
    return Counter(unigram_vocabulary(path))


def count_tokens(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of (doc_id, text), on whole texts; null and empty texts have none."""

    @F.arrow_udf("bigint")
    def count(text: pa.Array) -> pa.Array:
        return pa.array(_counter(path).count(text))

    return documents.select("doc_id", count("text").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the 32k piece vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
