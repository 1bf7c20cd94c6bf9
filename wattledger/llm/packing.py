"""Packing documents into sequences of a fixed number of tokens by swap-based local search.

Documents longer than a sequence are cut into whole sequences and a rest, the
rest first. All that is shorter is dealt into groups of bounded size; within a
group a first packing is improved by moving pieces and by exchanging one piece
for one or two others between bins that are not full. Only changes that raise
the sum of squared fills are made, so bins drift apart until some are empty.

The bins that are left least full in each group meet in groups of the next
round, until one group holds them all.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored, table
from .tokens import encoder, vocabulary_path

SEQUENCE = 1024
# Pieces in a group, and how many pieces in a group's worst bins go on to the next round.
GROUP_PIECES = 20_000
CARRIED_PIECES = 2_500
# How far the search looks: bins to take from, and bins to give to for each of them.
_DONORS = 200
_PARTNERS = 60

_PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: binary>>"


def pieces_of(documents: DataFrame, tokenizer: str, end_id: int, attached_space: bool, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and its end id.

    Only documents of more than SEQUENCE ids are cut. A null text is empty and has
    the end id alone. ``with_ids`` keeps the ids as little-endian 32-bit integers.
    """

    @F.arrow_udf(_PIECES)
    def cut(text: pa.Array) -> pa.Array:
        bounds, piece, start, length, crc, kept = [0], [], [], [], [], []
        for ids, offsets in encoder(tokenizer, attached_space).encode(text):
            raw = ids.astype("<u4").tobytes()
            end = np.uint32(end_id).tobytes()
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                own = raw[4 * a:4 * b] + end
                n = b - a + 1
                head = n % SEQUENCE or SEQUENCE
                at, size, k = 0, head, 0
                while at < n:
                    part = own[4 * at:4 * (at + size)]
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    kept.append(part if with_ids else None)
                    at, size, k = at + size, SEQUENCE, k + 1
                bounds.append(len(piece))
        fields = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(kept, pa.binary())]
        values = pa.StructArray.from_arrays(fields, ["piece", "start", "length", "ids_crc32", "ids"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    out = documents.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")
    return out if with_ids else out.drop("ids")


class _Bins:
    """Bins as multisets of lengths. Bins of one fill are interchangeable, so they are found by fill."""

    def __init__(self, lengths: list[int]) -> None:
        self.items: list[Counter] = []
        self.fill: list[int] = []
        self._best_fit(lengths)

    def _best_fit(self, lengths: list[int]) -> None:
        """Longest first, into the fullest bin that still has room."""
        by_room: list[list[int]] = [[] for _ in range(SEQUENCE + 1)]
        rooms = 0  # bit r: some bin has room r
        for length in sorted(lengths, reverse=True):
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                b, room = len(self.items), SEQUENCE
                self.items.append(Counter())
                self.fill.append(0)
            self.items[b][length] += 1
            self.fill[b] += length
            by_room[room - length].append(b)
            rooms |= 1 << (room - length)

    def _shift(self, a: int, b: int, out: list[int], back: list[int]) -> None:
        """Lengths ``out`` go from bin a to bin b, lengths ``back`` the other way."""
        for x, y, lengths in ((a, b, out), (b, a, back)):
            for length in lengths:
                self.items[x][length] -= 1
                if not self.items[x][length]:
                    del self.items[x][length]
                self.items[y][length] += 1
        moved = sum(out) - sum(back)
        self.fill[a] -= moved
        self.fill[b] += moved

    def _best_exchange(self, a: int, b: int) -> tuple[list[int], list[int]] | None:
        """The exchange that moves most from a to b, at most b's room: a move, one for one, or two for one."""
        room = SEQUENCE - self.fill[b]
        best, found = 0, None
        mine, theirs = list(self.items[a]), sorted(self.items[b])
        pairs = [[x, y] for i, x in enumerate(mine) for y in mine[i:] if x != y or self.items[a][x] > 1]
        for out in [[x] for x in mine] + pairs:
            size = sum(out)
            if best < size <= room:
                best, found = size, (out, [])
            at = np.searchsorted(theirs, size - room)  # the shortest piece of b that makes the exchange fit
            if at < len(theirs) and best < size - theirs[at]:
                best, found = size - theirs[at], (out, [theirs[at]])
        return found

    def improve(self) -> None:
        """Take from the emptiest bins for fuller ones; the sum of squared fills rises with every change."""
        open_bins = sorted((b for b, fill in enumerate(self.fill) if fill < SEQUENCE), key=lambda b: self.fill[b])
        for i, a in enumerate(open_bins[:_DONORS]):
            rest = open_bins[i + 1:]
            step = max(1, len(rest) // _PARTNERS)
            for b in rest[:_PARTNERS] + rest[_PARTNERS::step]:
                while 0 < self.fill[a] <= self.fill[b] < SEQUENCE and (found := self._best_exchange(a, b)):
                    self._shift(a, b, *found)
                if not self.fill[a]:
                    break

    def assignment(self, lengths: np.ndarray) -> np.ndarray:
        """A bin for each piece: pieces of one length are dealt out in their order."""
        slots: dict[int, list[int]] = {}
        for b, items in enumerate(self.items):
            for length, n in items.items():
                slots.setdefault(length, []).extend([b] * n)
        taken: Counter = Counter()
        out = np.empty(len(lengths), np.int64)
        for i, length in enumerate(lengths.tolist()):
            out[i] = slots[length][taken[length]]
            taken[length] += 1
        return out


def _pack_group(rows: pd.DataFrame, carried_pieces: int) -> pd.DataFrame:
    """Pack one group; ``done`` marks the pieces of bins that do not go on to the next round."""
    rows = rows.sort_values(["length", "piece_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    bins = _Bins(rows["length"].tolist())
    bins.improve()
    number = bins.assignment(rows["length"].to_numpy())
    fill = np.bincount(number, rows["length"], minlength=len(bins.items))
    count = np.bincount(number, minlength=len(bins.items))
    emptiest = np.argsort(fill, kind="stable")
    carried = np.zeros(len(fill), bool)
    carried[emptiest[np.cumsum(count[emptiest]) <= carried_pieces]] = True
    order = np.argsort(number, kind="stable")
    sorted_bins, sorted_lengths = number[order], rows["length"].to_numpy()[order]
    before = np.cumsum(sorted_lengths) - sorted_lengths
    head = np.searchsorted(sorted_bins, sorted_bins)
    offset = np.empty(len(rows), np.int64)
    offset[order] = before - before[head]
    return pd.DataFrame({
        "piece_id": rows["piece_id"], "length": rows["length"], "group": rows["group"],
        "bin": number, "offset": offset, "done": ~carried[number],
    })


def assign(pieces: DataFrame, group_pieces: int = GROUP_PIECES, carried_pieces: int = CARRIED_PIECES) -> DataFrame:
    """(piece_id, sequence_id, offset) for (piece_id, length): bins of SEQUENCE tokens, as few as local search finds.

    ``piece_id`` must be unique and length between 1 and SEQUENCE. Groups have about
    ``group_pieces``, of which at most ``carried_pieces``, a fraction, go on. Whole sequences
    are bins of their own, with negative numbers. An empty table gives an empty one.
    """
    schema = "piece_id bigint, length bigint, group bigint, bin bigint, offset bigint, done boolean"
    pieces = pieces.select("piece_id", "length")
    whole = pieces.filter(F.col("length") == SEQUENCE)
    results = [whole.select("piece_id", (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    left, level = pieces.filter(F.col("length") < SEQUENCE), 0
    while True:
        groups = max(1, -(-left.count() // group_pieces))
        last = groups == 1
        dealt = left.withColumn("group", F.pmod(F.xxhash64("piece_id", F.lit(level)), F.lit(groups)))

        carried = 0 if last else carried_pieces

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            return _pack_group(rows, carried)

        packed = stored(dealt.groupBy("group").applyInPandas(pack, schema), f"packed-{level}")
        results.append(packed.filter("done").select(
            "piece_id", (F.shiftleft(F.lit(level).cast("bigint"), 56) + F.shiftleft("group", 20) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        left, level = packed.filter("NOT done").select("piece_id", "length"), level + 1
    every = results[0]
    for part in results[1:]:
        every = every.unionByName(part)
    return every


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, attached_space: bool, with_ids: bool = True) -> DataFrame:
    """Every piece of (doc_id, text) with its sequence and its place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].
    Repeated rows are packed as often as they come; null ids are kept.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "pieces")
    pieces_of(documents.select("doc_id", "text"), tokenizer, end_id, attached_space, with_ids).withColumn(
        "piece_id", F.monotonically_increasing_id()).write.parquet(path)
    pieces = spark.read.parquet(path)
    return pieces.join(assign(pieces), "piece_id").drop("piece_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level ids, sequences of 1024 tokens."""
    packed = pack_documents(
        table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=2, attached_space=True, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
