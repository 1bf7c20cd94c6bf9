"""Exact ids of a SentencePiece BPE model by vectorised merge rounds, and texts from ids.

Words are cut where no piece of the vocabulary can reach across, so each distinct
word is merged once per worker. The words that are new stand in one flat array of
symbols. In a round every segment takes the best rank among its pairs and merges
all pairs of that rank that do not overlap, from the left, at once; then the
array is closed up. A segment without a pair is finished.

Merging from left to right one by one would give the same, unless a merged symbol
makes a pair with a neighbour that is as good as the rank at hand: that pair comes
before the rest. So a segment's merges end with the first such one in a round.

Two neighbours whose text together is in no piece can never be joined; segments are
cut there, round by round, so a long run without spaces soon falls into short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import table
from .tokens import PieceCache, exact_byte_values, vocabulary_path

MARK = "▁"
# A worker forgets its words when it holds this many; results do not depend on it.
CACHE_WORDS = 1_000_000
_NONE = np.iinfo(np.int32).max


class MergeTable:
    """What the pairs of symbols of a model become, and at which rank.

    Symbols are the pieces by their ids, then characters that only occur within
    pieces, then one for all other characters.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = [model.is_unknown(i) or model.is_control(i) for i in range(n)]
        self.byte_ids = np.array([i for i in range(n) if model.is_byte(i)], np.int32)
        ordinary = {model.id_to_piece(i): i for i in range(n) if not (kinds[i] or model.is_byte(i))}
        self._check(model, ordinary)
        symbols = dict(ordinary)
        for piece in ordinary:
            for character in piece:
                symbols.setdefault(character, n + len(symbols) - len(ordinary))
        self.pieces, self.other = n, n + len(symbols) - len(ordinary)
        scores = {i: model.get_score(i) for i in ordinary.values()}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(self.other + 1, _NONE, np.int32)
        self.rank[list(scores)] = [order[s] for s in scores.values()]

        self.characters = np.array(sorted(ord(s) for s in symbols if len(s) == 1), np.uint32)
        self.symbol_of = np.array([symbols[chr(c)] for c in self.characters.tolist()], np.int32)
        pairs: dict[int, int] = {}
        joined = np.zeros((256, 256), bool)
        for piece in ordinary:
            for a in range(len(piece)):
                for b in range(a + 2, len(piece) + 1):
                    whole = ordinary.get(piece[a:b], -1)
                    for middle in range(a + 1, b):
                        left, right = symbols.get(piece[a:middle]), symbols.get(piece[middle:b])
                        if left is not None and right is not None:
                            pairs[left * (self.other + 1) + right] = whole
            raw = piece.replace(MARK, " ").encode()
            joined[list(raw[:-1]), list(raw[1:])] = True
        # Bytes of different ASCII characters that stand next to each other in no piece.
        self.apart = ~joined
        self.apart[128:] = self.apart[:, 128:] = False
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by_key = np.argsort(keys)
        self.keys, self.product = keys[by_key], np.fromiter(pairs.values(), np.int32, len(pairs))[by_key]
        self.eager = self._eager()
        self.run = self._longest_run(ordinary)

    @staticmethod
    def _check(model, ordinary: dict[str, int]) -> None:
        """Refuse files that ask for more than pairs of symbols: other normalization, other kinds of pieces."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        rules, training = proto.normalizer_spec, proto.trainer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
        marked = rules.add_dummy_prefix and rules.escape_whitespaces and not training.treat_whitespace_as_suffix
        others = any(p.type in (4, 5) for p in proto.pieces)  # user-defined, unused
        if training.model_type != 2 or not training.byte_fallback or not plain or not marked or others:
            raise ValueError("not a BPE model with byte fallback, identity normalization and a mark before the text")
        if any(MARK in piece.lstrip(MARK) for piece in ordinary):
            raise ValueError("pieces that go on after a space are not supported")

    def _eager(self) -> np.ndarray:
        """Symbols that can make a pair as good as they are themselves."""
        made = self.product >= 0
        rank = self.rank[self.product[made]]
        out = np.zeros(self.other + 1, bool)
        for symbol in (self.keys[made] // (self.other + 1), self.keys[made] % (self.other + 1)):
            out[symbol[rank <= self.rank[symbol]]] = True
        return out

    def _longest_run(self, ordinary: dict[str, int]) -> int:
        """Marks after which a run of marks can be cut, 0 if it cannot.

        Runs of marks must be the only pieces with several marks and all have one
        score below all others, so that they form last and from the left; and the
        longest must form out of its own marks, whatever follows.
        """
        runs = {len(p): i for p, i in ordinary.items() if MARK * 2 in p}
        ranks = {int(self.rank[i]) for i in runs.values()}
        rest = max(int(self.rank[i]) for p, i in ordinary.items() if MARK not in p or p != MARK * len(p))
        if not runs or len(ranks) > 1 or min(ranks) <= rest or not all(MARK * n in ordinary for n in runs):
            return 0
        longest = max(runs)
        alone, double = (self.merge(np.full(n * longest, ord(MARK), np.uint32), np.zeros(1, np.int64))[0] for n in (1, 2))
        return longest if [*alone, *double] == [runs[longest]] * 3 else 0

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the pair's piece or _NONE, whether some piece holds the pair's text) of each pair."""
        key = left.astype(np.int64) * (self.other + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        made = np.where(there, self.product[at], -1)
        return made, there

    def merge(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(final symbols, index of the character where each starts) of words given by code points and first characters."""
        at = np.minimum(np.searchsorted(self.characters, points), len(self.characters) - 1)
        symbol = np.where(self.characters[at] == points, self.symbol_of[at], self.other).astype(np.int32)
        origin = np.arange(len(symbol))
        last = np.zeros(len(symbol), bool)  # no symbol after this one in its segment
        last[np.append(first[1:], len(symbol)) - 1] = True
        made = np.full(len(symbol), -1, np.int32)
        self._pair(symbol, last, made, np.flatnonzero(~last))
        done_symbols, done_origins = [], []
        while len(symbol):
            rank = np.where(made >= 0, self.rank[made], _NONE)
            start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            size = np.diff(np.append(start, len(symbol)))
            best = np.minimum.reduceat(rank, start)
            open_ = np.repeat(best < _NONE, size)
            if not open_.all():
                done_symbols.append(symbol[~open_])
                done_origins.append(origin[~open_])
                symbol, origin, last, made, rank = symbol[open_], origin[open_], last[open_], made[open_], rank[open_]
                size, best = size[best < _NONE], best[best < _NONE]
                if not len(symbol):
                    break
            pick = self._picked(symbol, last, made, rank == np.repeat(best, size), rank)
            symbol[pick] = made[pick]
            last[pick] = last[pick + 1]
            keep = np.ones(len(symbol), bool)
            keep[pick + 1] = False
            place = np.cumsum(keep) - 1
            symbol, origin, last, made = symbol[keep], origin[keep], last[keep], made[keep]
            changed = place[pick]
            before = changed[changed > 0] - 1
            made[changed] = -1
            again = np.unique(np.concatenate([changed, before[~last[before]]]))
            self._pair(symbol, last, made, again[~last[again]])
        symbols, origins = np.concatenate([np.zeros(0, np.int32), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_origins])
        order = np.argsort(origins, kind="stable")
        return symbols[order], origins[order]

    def _pair(self, symbol: np.ndarray, last: np.ndarray, made: np.ndarray, at: np.ndarray) -> None:
        """Look up the pairs that start at these places; end segments at pairs that no piece holds."""
        made[at], there = self.find(symbol[at], symbol[at + 1])
        last[at[~there]] = True

    def _picked(self, symbol, last, made, candidate, rank) -> np.ndarray:
        """Places of the pairs to merge in this round."""
        at = np.flatnonzero(candidate)
        # Of neighbouring candidates, which overlap, every other one from the left. They are of one segment.
        head = np.concatenate([[True], np.diff(at) > 1])
        run = np.cumsum(head) - 1
        at = at[(at - at[head][run]) % 2 == 0]
        eager = np.flatnonzero(self.eager[made[at]])
        if not len(eager):
            return at
        i = at[eager]
        follows = np.zeros(len(at), bool)
        follows[1:] = np.diff(at) == 2
        follows &= ~last[at - 1]
        left = np.where(follows[eager], made[i - 2], symbol[i - 1])
        has_left = (i > 0) & ~last[i - 1]
        has_right = ~last[i + 1]
        loud = np.zeros(len(i), bool)
        for has, a, b in ((has_left, left, made[i]), (has_right, made[i], symbol[np.minimum(i + 2, len(symbol) - 1)])):
            product, _ = self.find(a, b)
            loud |= has & (product >= 0) & (self.rank[product] <= rank[i])
        if not loud.any():
            return at
        segment = np.concatenate([[0], np.cumsum(last)])[at]
        loud_at, loud_segment = eager[loud], segment[eager[loud]]
        first = np.unique(loud_segment, return_index=True)
        limit = np.full(len(at), len(at))
        place = np.searchsorted(first[0], segment)
        inside = place < len(first[0])
        inside[inside] = first[0][place[inside]] == segment[inside]
        limit[inside] = loud_at[first[1]][place[inside]]
        return at[np.arange(len(at)) <= limit]


class PieceEncoder:
    """Ids of whole texts as the model's own library gives them, without begin and end."""

    def __init__(self, path: str) -> None:
        self.table = MergeTable(path)
        self.words = PieceCache()

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of a run of rows, offsets of the rows in them) for run after run; null is an empty text."""
        # The mark itself, in a text, is a space to the model.
        texts = pc.replace_substring(texts, MARK, " ")
        for _, data, offsets in tb.slices(texts):
            yield self._encode_slice(*_with_space_before(data, offsets))

    def _encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self._word_starts(data, offsets)
        end = np.append(start[1:], len(data))
        key, at, inverse = np.unique(tb.hashes(data, start, end, exact_byte_values()), return_index=True, return_inverse=True)
        self._learn(data, start, end, key, at)
        place, _ = self.words.find(key)
        count = self.words.count[place][inverse].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.words.ids[np.repeat(self.words.at[place][inverse] - (ends - count), count) + np.arange(total)]
        return ids.view(np.int32), np.concatenate([[0], ends])[np.searchsorted(start, offsets)]

    def _word_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Every row starts a word, so does a space after another character, and two bytes that no piece holds are cut."""
        if not len(data):
            return np.zeros(0, np.int64)
        space = data == 0x20
        begins = np.zeros(len(data), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | self.table.apart[data[:-1], data[1:]]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        if self.table.run:
            head = np.flatnonzero(begins & space)
            length = _run_lengths(space, begins, head)
            long = length > self.table.run
            blocks = (length[long] - 1) // self.table.run
            number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks) + 1
            begins[np.repeat(head[long], blocks) + number * self.table.run] = True
        return np.flatnonzero(begins)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, at: np.ndarray) -> None:
        _, known = self.words.find(key)
        if known.all():
            return
        if len(self.words.keys) + np.count_nonzero(~known) > CACHE_WORDS:
            self.words.clear()
            known[:] = False
        at = at[~known]
        start, size = start[at], (end - start)[at]
        before = np.cumsum(size) - size
        raw = data[np.repeat(start - before, size) + np.arange(int(size.sum()))]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.searchsorted(np.flatnonzero(raw & 0xC0 != 0x80), before)
        marked = np.where(points == 0x20, np.uint32(ord(MARK)), points)
        ids, count = self._ids(marked, first)
        self.words.add(key[~known], ids.view(np.uint32), count)

    def _ids(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by word); a symbol that is no piece is spelled in bytes."""
        symbol, origin = self.table.merge(points, first)
        odd = np.flatnonzero(symbol >= self.table.pieces)
        spelled = [chr(c).encode() for c in points[origin[odd]].tolist()]
        width = np.ones(len(symbol), np.int64)
        width[odd] = [len(s) for s in spelled]
        ids = np.repeat(symbol, width)
        if len(odd):
            bytes_ = np.frombuffer(b"".join(spelled), np.uint8)
            ids[np.repeat(symbol >= self.table.pieces, width)] = self.table.byte_ids[bytes_]
        ends = np.concatenate([[0], np.cumsum(width)])
        return ids, np.diff(ends[np.append(np.searchsorted(origin, first), len(symbol))])


def _with_space_before(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space in front of every row that is not empty."""
    filled = offsets[:-1] < offsets[1:]
    moved = offsets + np.concatenate([[0], np.cumsum(filled)])
    out = np.empty(moved[-1], np.uint8)
    added = np.zeros(len(out), bool)
    added[moved[:-1][filled]] = True
    out[added] = 0x20
    out[~added] = data
    return out, moved


def _run_lengths(space: np.ndarray, begins: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Number of spaces from each head to the next other character or the next head."""
    stop = np.flatnonzero(~space | begins)
    return np.append(stop, len(space))[np.searchsorted(stop, head, side="right")] - head


@cache
def encoder(path: str) -> PieceEncoder:
    """The one encoder of this worker process for a model file."""
    return PieceEncoder(path)


@cache
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(text: str, path: str) -> Column:
    """The ids of a text column as array<int>; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        every, bounds, base = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for ids, offsets in encoder(path).encode(texts):
            every.append(ids)
            bounds.append(offsets[1:] + base)
            base += len(ids)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), pa.array(np.concatenate(every)))

    return ids_of(text)


def decode(ids: str, path: str) -> Column:
    """The text of a column of ids, by the library's own decoder; null for null."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        model = _library(path)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
        out = [model.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False)]
        return pa.array(out, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return text_of(ids)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, text).

    Null and empty texts have no ids and decode to an empty text; repeated rows and
    null ids are kept, further columns are not read.
    """
    encoded = documents.select("doc_id", encode("text", path).alias("ids"))
    return encoded.select("doc_id", "ids", decode("ids", path).alias("decoded"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, there and back."""
    found = round_trip(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
