"""Token ids of documents as compact binary blocks, and back.

Ids are replaced by their rank in the frequency order of the whole corpus, so
that frequent ones are small numbers. Ranks are stored in one to four bytes
each; the number of bytes stands apart, in control bytes with two bits per
value. A decoder looks up whole control bytes in a table and gathers all values
of a block at once.

The output is a Parquet table of blocks in ascending order of ``doc_id``, and a
table of ranks. A block holds whole documents, about ``BLOCK_TOKENS`` ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored
from .tokens import encoder

BLOCK_TOKENS = 1 << 16
_BLOCK_SCHEMA = "part int, block int, start bigint, n_tokens bigint, doc_ids binary, doc_lengths binary, control binary, data binary"
# Bytes of the four values that one control byte describes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = raw[np.arange(4) <= extra[:, None]].tobytes()
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[:len(values)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), data


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of one block."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(length) - length
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for i in range(1, 4):
        longer = np.flatnonzero(length > i)
        out[longer] |= raw[start[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def token_ids(texts: DataFrame, tokenizer: str, end_id: int, attached_space: bool = False, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids) of (doc_id, text): all ids of the text and the end id, as little-endian unsigned integers.

    A null text is an empty one.
    """

    @F.arrow_udf("binary")
    def ids_of(text: pa.Array) -> pa.Array:
        out = []
        for ids, offsets in encoder(tokenizer, attached_space).encode(text):
            out += [np.append(ids[a:b], np.uint32(end_id)).astype(kind).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        return pa.array(out, pa.binary())

    return texts.select("doc_id", ids_of("text").alias("ids"))


def rank_table(ids: DataFrame, n_ids: int, kind: str = "<u4") -> np.ndarray:
    """Token id by rank: the most frequent first, ties by id. Counted over all documents; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            column = batch.column(0)
            flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
            total += np.bincount(flat[offsets[0]:offsets[-1]].view(kind), minlength=n_ids)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["id", "n"])

    counted = ids.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(n_ids, np.int64)
    n[counted["id"].to_numpy()] = counted["n"].to_numpy()
    return np.lexsort((np.arange(n_ids), -n)).astype(np.uint32)


def write_blocks(texts: DataFrame, path: str, tokenizer: str, end_id: int, attached_space: bool = False) -> None:
    """Encode (doc_id, text) and write blocks to ``path``/blocks and the ranks to ``path``/ranks.

    Rows come in ascending order of doc_id, null first; rows with one doc_id stand
    next to each other in the order of their ids. An empty table gives empty tables.
    """
    spark = texts.sparkSession
    n_ids = _vocabulary_size(tokenizer, end_id)
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"  # of the intermediate table
    ids = stored(token_ids(texts, tokenizer, end_id, attached_space, kind), "ids")
    by_rank = rank_table(ids, n_ids, kind)
    rank = np.empty_like(by_rank)
    rank[by_rank] = np.arange(n_ids, dtype=np.uint32)
    ranks = pa.table({"rank": pa.array(np.arange(n_ids), pa.int32()), "id": pa.array(by_rank, pa.int32())})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{path}/ranks")

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start, docs, chunks, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(c) for c in chunks], "<u4")
            control, data = encode_values(rank[np.concatenate(chunks)])
            # Null ids are the lowest number, which keeps them first.
            numbers = np.array([np.iinfo(np.int64).min if d is None else d for d in docs], "<i8")
            row = (part, block, start, size, numbers.tobytes(), lengths.tobytes(), control, data)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            names = [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk = np.frombuffer(value.as_buffer(), kind)
                if chunks and size + len(chunk) > BLOCK_TOKENS:
                    yield flush()
                    docs, chunks, block, start, size = [], [], block + 1, start + size, 0
                docs.append(doc)
                chunks.append(chunk)
                size += len(chunk)
        if chunks:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(to_blocks, _BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def _vocabulary_size(tokenizer: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks, and the token id by rank."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    return spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks"), ranks


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from the blocks; ``start`` counts the ids of all documents before."""
    blocks, by_rank = read_blocks(spark, path)
    # ``start`` of a block counts within its part; one row per part is gathered for the rest.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toPandas()
    before = dict(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[decode_values(row["control"], row["data"], row["n_tokens"])]
                lengths = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64(), mask=docs == np.iinfo(np.int64).min),
                    pa.array(ends - lengths + row["start"] + before[row["part"]], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends, lengths, strict=True)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents with the word-level tokenizer, read them back and digest what was read."""
    from .common import table
    from .tokens import vocabulary_path

    path = scratch_path(spark, "token-blocks")
    write_blocks(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
