"""Exact token ids of whole texts, encoding each distinct piece of text once per worker.

Both public tokenizers treat what stands between white space on its own, so the
ids of a text are those of its pieces, one after the other. Pieces recur far
more often than texts do: a worker keeps the ids of pieces it has seen, by their
64-bit hash, and hands only new ones to the tokenizers library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from . import textbytes as tb

# A worker forgets its pieces when it holds this many (about 60 bytes each); results do not depend on it.
CACHE_PIECES = 2_000_000
_GROUP_BYTES = 1 << 20
# A word is cut off from such a mark next to it: both patterns below end a run of letters there, and begin one.
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?|", np.uint8))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
# Words that neither normalization nor the split into runs can change but for their case.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
_ENCODE_PIECES = 20_000

# White space outside ASCII in UTF-8, as three bytes (two-byte characters: any third byte).
_WIDE_SPACES = np.array(
    [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080], np.uint32
)
_TWO_BYTE_SPACES = np.array([0xC285, 0xC2A0], np.uint32)


@cache
def _printable_bytes() -> dict[int, int]:
    """The byte-level alphabet: a byte that is a visible Latin-1 character is that, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


@cache
def exact_byte_values() -> np.ndarray:
    return tb.mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PieceCache:
    """Ids of the pieces seen so far: hashes in order, and where the ids of each stand."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(count) - count
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.at = np.concatenate([self.at, at])[order]
        self.count = np.concatenate([self.count, count.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    """Ids of whole texts as ``tokenizers`` gives them, without added special tokens.

    ``attached_space``: the tokenizer keeps the white space before a word (byte-level
    BPE) instead of dropping it, and keeps case. A text with white space outside
    ASCII, where it would matter for neighbouring pieces, or with what may begin an
    added token, is one piece as a whole.
    """

    def __init__(self, path: str, attached_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.attached_space = attached_space
        self.pieces = PieceCache()

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of a run of rows, offsets of the rows in them) for run after run; null is an empty text."""
        group: list[tuple] = []
        size = 0
        for _, data, offsets in tb.slices(texts):
            if group and size + len(data) > _GROUP_BYTES:
                yield self._group(group)
                group, size = [], 0
            start, end, first, odd = self._cut(data, offsets)
            group.append((data, start, end, first, self._hash(data, start, end, odd)))
            size += len(data)
        if group:
            yield self._group(group)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Bounds of the pieces, the index of each row's first piece, and the pieces that are a row as a whole."""
        spaces = tb.SPACE[data]
        start, end, first = tb.bounds(~spaces, offsets)
        if self.attached_space:
            begin = np.concatenate([[0], end])[:len(start)]
            rows = np.flatnonzero(first[:-1] < first[1:])
            begin[first[rows]] = offsets[rows]
            # White space at the end of a row, or a row of nothing else, is a piece of its own.
            last = np.where(first[1:] > first[:-1], np.append(end, 0)[first[1:] - 1], offsets[:-1])
            start = np.sort(np.concatenate([begin, last[last < offsets[1:]]]))
            end = np.sort(np.concatenate([end, offsets[1:][last < offsets[1:]]]))
        letter, mark = _LETTER[data], _MARK[data]
        cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
        cut = cut[~np.isin(cut, offsets)] if len(cut) else cut
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        first = np.searchsorted(start, offsets)
        odd = np.unique(np.searchsorted(offsets, self._odd(data), side="right") - 1)
        if len(odd):
            keep = np.ones(len(start), bool)
            for r in odd:
                keep[first[r] + 1:first[r + 1]] = False
                start[first[r]], end[first[r]] = offsets[r], offsets[r + 1]
            kept = np.concatenate([[0], np.cumsum(keep)])
            odd, first = kept[first[odd]], kept[first]
            start, end = start[keep], end[keep]
        return start, end, first, odd

    def _odd(self, data: np.ndarray) -> np.ndarray:
        """Places of white space outside ASCII and of what may begin an added token."""
        at = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3, 0x3C)))
        three = np.zeros((len(at), 3), np.uint32)
        for i in range(3):
            there = at + i < len(data)
            three[there, i] = data[at[there] + i]
        two = three[:, 0] << 8 | three[:, 1]
        odd = two == 0x3C7C
        if self.attached_space:
            odd |= np.isin(two, _TWO_BYTE_SPACES) | np.isin(two << 8 | three[:, 2], _WIDE_SPACES)
        return at[odd]

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> np.ndarray:
        if self.attached_space:
            return tb.hashes(data, start, end, exact_byte_values())
        out = tb.hashes(data, start, end)
        if len(odd):
            out[odd] = tb.hashes(data, start[odd], end[odd], exact_byte_values())
        return out

    def _group(self, group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        key, at, inverse = np.unique(np.concatenate([g[4] for g in group]), return_index=True, return_inverse=True)
        self._learn(group, key, at)
        place, _ = self.pieces.find(key)
        count = self.pieces.count[place][inverse].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pieces.ids[np.repeat(self.pieces.at[place][inverse] - (ends - count), count) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        offsets, base = [np.zeros(1, np.int64)], 0
        for _, start, _, first, _ in group:
            offsets.append(ends[first[1:] + base])
            base += len(start)
        return ids, np.concatenate(offsets)

    def _learn(self, group: list[tuple], key: np.ndarray, at: np.ndarray) -> None:
        _, known = self.pieces.find(key)
        if known.all():
            return
        if len(self.pieces.keys) + np.count_nonzero(~known) > CACHE_PIECES:
            self.pieces.clear()
            known[:] = False
        new, at = key[~known], at[~known]
        bases = np.cumsum([0, *(len(g[1]) for g in group)])
        which = np.searchsorted(bases, at, side="right") - 1
        texts = []
        for w, i in zip(which.tolist(), (at - bases[which]).tolist(), strict=True):
            data, start, end = group[w][:3]
            texts.append(data[start[i]:end[i]].tobytes().decode("utf-8"))
        for i in range(0, len(texts), _ENCODE_PIECES):
            self.pieces.add(new[i:i + _ENCODE_PIECES], *self._encode_pieces(texts[i:i + _ENCODE_PIECES]))

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by piece). The model is asked directly for plain words, the whole pipeline for the rest."""
        found: list = [None] * len(texts)
        rest, model, hidden = [], self.tokenizer.model, _printable_bytes()
        for i, text in enumerate(texts):
            plain = _PLAIN.fullmatch(text)
            if not plain or (plain[1] and not self.attached_space):
                rest.append(i)
                continue
            word = text if self.attached_space else text.lower()
            if plain[1] or not word.isascii():
                word = word.encode().decode("latin-1").translate(hidden)
            found[i] = [t.id for t in model.tokenize(word)]
        if rest:
            got = self.tokenizer.encode([texts[i] for i in rest], is_pretokenized=True, add_special_tokens=False)
            ids = got.ids
            ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(rest))).tolist()
            for i, a, b in zip(rest, [0, *ends], ends, strict=False):
                found[i] = ids[a:b]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), np.uint32, int(count.sum())), count


@cache
def encoder(path: str, attached_space: bool) -> Encoder:
    """The one encoder of this worker process for a tokenizer file."""
    return Encoder(path, attached_space)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
