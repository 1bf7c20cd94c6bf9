"""Product codes of vectors, with Orchard's search for the nearest codebook entry.

Vectors become integers and are cut into parts; each part position has a codebook
that rounds of exact integer means improve. To find the nearest entry, a search
starts at some entry and goes through its list of the other entries by distance.
A closer entry on the way takes over, with its own list; entries already visited
are skipped; and the search ends where the list is more than twice as far as the
current entry, since by the triangle inequality nothing beyond can be as close.
All vectors of a batch search at once, each with its own state.

Sums are exact integers of any size: partial sums of a task leave it as two
decimals. Codebooks are the only thing that passes the driver; their size does
not depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Sums travel as high * _SPLIT + low.
_SPLIT = 10**18
_SUMS = "part int, entry int, n bigint, position int, high decimal(38,0), low decimal(38,0)"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null or empty and holds no null, NaN or infinite component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def integers(embedding: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length; Python integers where 64 bits could overflow in a search."""
    size = len(embedding.flatten()) // max(len(embedding), 1)
    x = np.floor(embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embedding), size) * SCALE)
    # Four times a squared distance must stay within 62 bits.
    if x.size and float(np.abs(x).max()) ** 2 * 16 * size >= 2.0**62:
        return np.vectorize(int, otypes=[object])(x)
    return x.astype(np.int64)


class Search:
    """Nearest of some entries under squared Euclidean distance, ties to the lower index."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        between = ((entries[:, None] - entries[None]) ** 2).sum(2)
        self.lists = np.argsort(between, axis=1, kind="stable")
        self.gaps = np.take_along_axis(between, self.lists, 1)

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point."""
        n, k = len(points), len(self.entries)
        best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        distance = ((points - self.entries[0]) ** 2).sum(1)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        rows = np.arange(n)
        while len(rows):
            rows = rows[at[rows] < k]
            rows = rows[(self.gaps[best[rows], at[rows]] <= 4 * distance[rows]).astype(bool)]
            entry = self.lists[best[rows], at[rows]]
            at[rows] += 1
            new = ~visited[rows, entry]
            r, e = rows[new], entry[new]
            visited[r, e] = True
            d = ((points[r] - self.entries[e]) ** 2).sum(1)
            closer = ((d < distance[r]) | ((d == distance[r]) & (e < best[r]))).astype(bool)
            r = r[closer]
            best[r], distance[r], at[r] = e[closer], d[closer], 0
        return best, distance


def _searches(codebooks: np.ndarray) -> list[Search]:
    return [Search(entries) for entries in codebooks]


def assign(points: np.ndarray, searches: list[Search]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) by vector and part."""
    # In Python integers throughout if the vectors or the codebooks are.
    if any(s.entries.dtype == object for s in searches):
        points = points.astype(object)
    cut = points.reshape(len(points), len(searches), -1)
    found = [search(cut[:, p]) for p, search in enumerate(searches)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """(part, entry, position) of the vectors with the smallest ids; None without vectors.

    Vectors of one id go by their components; vectors without an id come last.
    The vector that comes first sets the number of components, a multiple of
    ``parts``; see ``of_length``.
    """
    order = (F.asc_nulls_last("vec_id"), F.asc("embedding"))
    first = vectors.select("vec_id", "embedding").orderBy(*order).limit(1).toArrow()
    if not len(first):
        return None
    size = len(first["embedding"][0])
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    rows = of_length(vectors, size).select("vec_id", "embedding").orderBy(*order).limit(entries).toArrow()
    values = integers(rows["embedding"].combine_chunks())
    return values.reshape(len(values), parts, -1).transpose(1, 0, 2)


def of_length(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of the given number of components; others have no place in the codebooks and are dropped."""
    return vectors.filter(F.size("embedding") == size)


def improved(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of the mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        searches = _searches(codebooks)
        total, count = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            points = integers(batch.column(0))
            if not len(points):
                continue
            codes, _ = assign(points, searches)
            slot = (codes + np.arange(parts) * entries).reshape(-1)
            order = np.argsort(slot, kind="stable")
            used, start = np.unique(slot[order], return_index=True)
            # A batch has some ten thousand rows of at most 31 bits, or Python integers.
            total[used] += np.add.reduceat(points.reshape(-1, width)[order], start, axis=0).astype(object)
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        slot, position = np.repeat(used, width), np.tile(np.arange(width), len(used))
        split = [divmod(int(v), _SPLIT) for v in total[used].reshape(-1)]
        columns = [
            pa.array(slot // entries, pa.int32()), pa.array(slot % entries, pa.int32()), pa.array(count[slot], pa.int64()),
            pa.array(position, pa.int32()), *(pa.array([Decimal(s[i]) for s in split], pa.decimal128(38, 0)) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SUMS.split(", ")])

    summed = vectors.select("embedding").mapInArrow(sums, _SUMS).groupBy("part", "entry", "position").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = codebooks.astype(object)
    for row in summed.toArrow().to_pylist():
        mean = (int(row["high"]) * _SPLIT + int(row["low"])) // row["n"]
        out[row["part"], row["entry"], row["position"]] = mean
    return _compact(out)


def _compact(codebooks: np.ndarray) -> np.ndarray:
    """64-bit integers if their squared distances fit, as in ``integers``."""
    largest = max(abs(int(v)) for v in codebooks.reshape(-1))
    size = codebooks.shape[0] * codebooks.shape[2]
    return codebooks.astype(np.int64) if largest**2 * 16 * size < 2**62 else codebooks.astype(object)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) of all usable vectors of (vec_id, embedding); None without any."""
    kept = usable(vectors)
    codebooks = first_codebooks(kept, parts, entries)
    if codebooks is None:
        return None
    kept = of_length(kept, codebooks.shape[0] * codebooks.shape[2])
    for _ in range(rounds):
        codebooks = improved(kept, codebooks)
    return codebooks


def encode(vectors: DataFrame, codebooks: np.ndarray | None) -> DataFrame:
    """(vec_id, label, code, error) of every usable vector of (vec_id, embedding, label).

    ``code`` has two hexadecimal digits a part; ``error`` is the sum of squared
    distances, null beyond a BIGINT. Without codebooks there are no rows.
    """
    schema = vectors.select("vec_id", "label").schema.add("code", T.StringType()).add("error", T.LongType())
    kept = usable(vectors).select("vec_id", "label", "embedding")
    if codebooks is None:
        return kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(codebooks)
        for batch in batches:
            points = integers(batch.column(2))
            if not len(points):
                continue
            found, distance = assign(points, searches)
            text = [row.tobytes().hex() for row in found.astype(np.uint8)]
            error = [v if v < 2**63 else None for v in distance.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])

    return of_length(kept, codebooks.shape[0] * codebooks.shape[2]).mapInArrow(codes, schema)


def decode(code: pa.Array, codebooks: np.ndarray) -> np.ndarray:
    """The integers that codes stand for, one row per code."""
    raw = np.frombuffer(bytes.fromhex("".join(pc.fill_null(code, "").to_pylist())), np.uint8).reshape(len(code), -1)
    return np.concatenate([codebooks[p][raw[:, p]] for p in range(len(codebooks))], 1)


def codebooks_text(codebooks: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, codebooks.reshape(-1).tolist()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: their codes, errors, and the errors of all vectors with the same label."""
    vectors = table(spark, sf_dir, "embeddings")
    codebooks = train(vectors)
    coded = stored(encode(vectors, codebooks), "codes")
    # One row per label, combined before the shuffle; joined back with the size of the written table known.
    sums = stored(coded.groupBy("label").agg(
        F.expr("try_cast(sum(CAST(error AS DECIMAL(38, 0))) AS BIGINT)").alias("label_error")), "label-errors")
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest() if codebooks is not None else None
    same = F.col("c.label").eqNullSafe(F.col("s.label"))
    return coded.alias("c").join(sums.alias("s"), same, "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
