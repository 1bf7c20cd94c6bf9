"""Fill-in-middle over texts that are stored as independent compressed frames.

A unit is a run of ASCII letters or any other single character. A text is kept as
zstandard frames of ``FRAME_UNITS`` units, each with the units and characters before
it. Where a document is cut is drawn from its id and its number of units alone, so
only the one or two frames that hold a cut are decompressed to select; the others
go into the output as they are. Frames put one after the other are a valid stream,
so the output is a list of frames too, and digests read it frame by frame.

Null texts are empty. Repeated rows are transformed alike, a null id draws as the
empty text, and further columns are not read. A unit is never cut, so a frame is as
long as its longest unit at least.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import stored, table

FRAME_UNITS = 1 << 12
# Marks of the three segments, and which form a document takes.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_FRAMES = "array<struct<units: bigint, chars: bigint, frame: binary>>"
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


@cache
def _tools():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(data: bytes) -> bytes:
    return _tools()[0].compress(data)


def _unpack(frame: bytes) -> bytes:
    return _tools()[1].decompress(frame)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places where units start, whether a character starts at each byte) in UTF-8 bytes of texts."""
    letter, lead = _LETTER[data], data & 0xC0 != 0x80
    starts = lead.copy()
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(starts), lead


def framed(text: str, frame_units: int = FRAME_UNITS) -> Column:
    """A text column as struct<n: units, chars: characters, frames>."""

    @F.arrow_udf(f"struct<n: bigint, chars: bigint, frames: {_FRAMES}>")
    def frames_of(texts: pa.Array) -> pa.Array:
        units, chars, frames, n, length, bounds = [], [], [], [], [], [0]
        for _, data, offsets in tb.slices(texts):
            start, lead = unit_starts(data, offsets)
            before = np.concatenate([[0], np.cumsum(lead)])
            first = np.searchsorted(start, offsets).tolist()
            n += np.diff(first).tolist()
            length += np.diff(before[offsets]).tolist()
            for row, (u, end) in enumerate(zip(first, first[1:], strict=False)):
                cuts = [*start[u:end:frame_units].tolist(), int(offsets[row + 1])]
                units += range(0, end - u, frame_units)
                chars += (before[cuts[:-1]] - before[offsets[row]]).tolist()
                frames += [_pack(data[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                bounds.append(len(frames))
        fields = [pa.array(units, pa.int64()), pa.array(chars, pa.int64()), pa.array(frames, pa.binary())]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["units", "chars", "frame"]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(length, pa.int64()), lists], ["n", "chars", "frames"])

    return frames_of(text)


def store(documents: DataFrame, name: str = "frames", frame_units: int = FRAME_UNITS) -> DataFrame:
    """(doc_id, marked, n, chars, frames) of (doc_id, text), written; ``marked``: the text contains one of the marks."""
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    rows = documents.select("doc_id", F.coalesce(marked, F.lit(False)).alias("marked"), framed("text", frame_units).alias("f"))
    return stored(rows.select("doc_id", "marked", "f.*"), name)


def _draw(number: int) -> Column:
    """The number-th group of eight hexadecimal digits of the digest of the id, from 0."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("bigint")


def drawn(stored_texts: DataFrame) -> DataFrame:
    """With the form and the two cuts of every document, in units."""
    one, other = (_draw(i) % (F.col("n") + 1) for i in (0, 1))
    plain = (F.col("n") == 0) | F.col("marked") | (_draw(2) % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, PLAIN).when(_draw(3) % 100 < SPM_PERCENT, SPM).otherwise(PSM)
    return stored_texts.withColumns({"form": form, "cut_a": F.least(one, other), "cut_b": F.greatest(one, other)})


class _Text:
    """One stored text, cut into segments by units."""

    def __init__(self, units: np.ndarray, chars: np.ndarray, frames: list[bytes]) -> None:
        self.units, self.chars, self.frames = units, chars, frames
        self.opened: dict[int, tuple] = {}

    def _open(self, i: int) -> tuple:
        if i not in self.opened:
            raw = _unpack(self.frames[i])
            data = np.frombuffer(raw, np.uint8)
            self.opened[i] = raw, *unit_starts(data, np.array([0, len(data)]))
        return self.opened[i]

    def place(self, unit: int, n: int, chars: int) -> tuple[int, int, int]:
        """(frame, byte in it, characters before) of a unit; the end of the text is the start of the frame after the last."""
        if unit == n:
            return len(self.frames), 0, chars
        i = int(np.searchsorted(self.units, unit, side="right")) - 1
        if self.units[i] == unit:
            return i, 0, int(self.chars[i])
        _, start, lead = self._open(i)
        at = int(start[unit - self.units[i]])
        return i, at, int(self.chars[i]) + int(np.count_nonzero(lead[:at]))

    def between(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> list[bytes]:
        """Frames of a segment: those within as they are, those that are cut packed anew."""
        (i, a, _), (j, b, _) = start, end
        if i == j:
            return [_pack(self._open(i)[0][a:b])] if a < b else []
        head = [_pack(self._open(i)[0][a:])] if a else [self.frames[i]]
        return head + self.frames[i + 1:j] + ([_pack(self._open(j)[0][:b])] if b else [])


def transform(stored_texts: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of stored texts; ``output`` is a list of frames."""
    marks = {m: _pack(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)}

    @F.arrow_udf("struct<prefix_chars: bigint, middle_chars: bigint, output: array<binary>>")
    def cut(n: pa.Array, chars: pa.Array, frames: pa.Array, form: pa.Array, cut_a: pa.Array, cut_b: pa.Array) -> pa.Array:
        values = frames.flatten()
        units, before = (values.field(k).to_numpy() for k in ("units", "chars"))
        data = values.field("frame").to_pylist()
        ends = np.cumsum(frames.value_lengths().to_numpy()).tolist()
        prefix, middle, output, bounds = [], [], [], [0]
        rows = zip([0, *ends], ends, *(c.to_pylist() for c in (n, chars, form, cut_a, cut_b)), strict=False)
        for lo, hi, size, length, kind, a, b in rows:
            text = _Text(units[lo:hi], before[lo:hi], data[lo:hi])
            if kind == PLAIN:
                prefix.append(None)
                middle.append(None)
                output += text.frames
            else:
                start, one, other, end = (text.place(u, size, length) for u in (0, a, b, size))
                prefix.append(one[2])
                middle.append(other[2] - one[2])
                head = [marks[PREFIX], *text.between(start, one)]
                tail = [marks[SUFFIX], *text.between(other, end)]
                inner = [marks[MIDDLE], *text.between(one, other)]
                output += (head + tail if kind == PSM else tail + head) + inner
            bounds.append(len(output))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(output, pa.binary()))
        return pa.StructArray.from_arrays([pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), lists], ["prefix_chars", "middle_chars", "output"])

    rows = drawn(stored_texts)
    return rows.select("doc_id", "n", "form", cut("n", "chars", "frames", "form", "cut_a", "cut_b").alias("c")).select("doc_id", "n", "form", "c.*")


@F.arrow_udf(T.StringType())
def digest(frames: pa.Array) -> pa.Array:
    """SHA-256 of the text that a list of frames holds, one frame in memory at a time."""
    out = []
    for row in frames:
        h = hashlib.sha256()
        for frame in row.values or ():
            h.update(_unpack(frame.as_py()))
        out.append(h.hexdigest())
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def restore(frames: pa.Array, form: pa.Array) -> pa.Array:
    """The text a document had, from its output and form."""
    out = []
    for row, kind in zip(frames, form.to_pylist(), strict=True):
        text = b"".join(_unpack(f.as_py()) for f in row.values or ())
        if kind != PLAIN:
            p, s, m = (text.index(mark.encode()) for mark in (PREFIX, SUFFIX, MIDDLE))
            prefix = text[p + len(PREFIX):s if kind == PSM else m]
            suffix = text[s + len(SUFFIX):m if kind == PSM else p]
            text = prefix + text[m + len(MIDDLE):] + suffix
        out.append(text.decode("utf-8"))
    return pa.array(out, pa.string())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: transformed, and restored from the output."""
    out = transform(store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"),
        F.sha2(restore("output", "form"), 256).alias("restored_sha256"))
