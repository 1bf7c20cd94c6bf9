"""Token ids, blocks of them, packing and counts against the tokenizers library itself."""

import zlib
from collections import Counter
from functools import cache

import helpers
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from wattledger.llm import packing, token_counts, token_output
from wattledger.llm.tokens import Encoder, vocabulary_path

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")
PIECES = vocabulary_path("piece_bpe_32k.model")
VOCABULARY = token_counts.unigram_vocabulary(PIECES)
ALPHABET = st.lists(st.sampled_from(list("aAbé ,.'|:<\n\t  ▁19") + ["the", " of", "<|endoftext|>", "don't", "ß", "é"]), max_size=40).map("".join)


@cache
def library(path):
    return Tokenizer.from_file(path)


def plain(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return {path: (Encoder(path, path == BYTE), Tokenizer.from_file(path)) for path in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(ALPHABET | st.none(), max_size=8))
def test_ids_of_any_text(encoders, path, texts):
    mine, library = encoders[path]
    got = [ids[a:b].tolist() for ids, at in mine.encode(pa.array(texts, pa.string())) for a, b in zip(at, at[1:], strict=False)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr("wattledger.llm.tokens.CACHE_PIECES", 3)
    texts = ["a b c d e f g", "b c z", None, "a b"] * 3
    mine = Encoder(BYTE, True)
    for _ in range(2):
        got = [ids[a:b].tolist() for ids, at in mine.encode(pa.array(texts)) for a, b in zip(at, at[1:], strict=False)]
        assert got == [plain(BYTE, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_values_survive_coding(values):
    values = np.array(values, np.uint32)
    control, data = token_output.encode_values(values)
    assert len(control) == -(-len(values) // 4)
    assert token_output.decode_values(control, data, len(values)).tolist() == values.tolist()


def test_documents_survive_the_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 50)
    docs = helpers.odd_documents(spark)
    token_output.write_blocks(docs, str(tmp_path / "t"), WORD, end_id=2)
    rows = token_output.read_documents(spark, str(tmp_path / "t")).collect()
    got = Counter((r.doc_id, np.frombuffer(r.ids, "<u4").tobytes()) for r in rows)
    assert got == Counter((r.doc_id, np.array([*plain(WORD, r.text), 2], "<u4").tobytes()) for r in docs.collect())
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert (r.start, 4 * r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))


def test_no_documents_no_blocks(spark, tmp_path):
    token_output.write_blocks(helpers.empty_documents(spark), str(tmp_path / "t"), WORD, end_id=2)
    assert token_output.read_documents(spark, str(tmp_path / "t")).count() == 0


def test_query_of_token_output(spark):
    rows = {r.doc_id: r for r in token_output.query(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*plain(WORD, r.text), 2], "<u4")
        assert tuple(rows[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def check_packing(rows, docs):
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*plain(BYTE, text), 2], "<u4")
        at, size, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want[doc_id, piece, at, size, zlib.crc32(ids[at:at + size].tobytes())] += 1
            at, size, piece = at + size, 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert not fill or max(fill.values()) <= 1024
    return len(fill), sum(fill.values())


def test_packing_of_odd_documents(spark):
    docs = helpers.odd_documents(spark)
    for ids in (True, False):
        rows = packing.pack_documents(docs, BYTE, 2, True, with_ids=ids).collect()
        check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
        assert not ids or all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(helpers.empty_documents(spark), BYTE, 2, True).count() == 0


def test_packing_in_rounds(spark):
    pieces = packing.pieces_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), BYTE, 2, True, with_ids=False)
    numbered = pieces.selectExpr("doc_id * 1000 + piece AS piece_id", "length")
    rows = packing.assign(numbered, group_pieces=60, carried_pieces=20).join(numbered, "piece_id").collect()
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert len(rows) == numbered.count() and max(fill.values()) <= 1024
    assert len(fill) <= -(-sum(fill.values()) // 1024) * 1.03 + 1


def test_local_search_empties_bins():
    bins = packing._Bins([])
    for b, items in enumerate([[600, 300], [500, 400], [124], [62, 62]]):
        bins.items.append(Counter(items))
        bins.fill.append(sum(items))
    before = sum(f * f for f in bins.fill)
    bins.improve()
    assert sum(f * f for f in bins.fill) > before and sorted(bins.fill) == [0, 0, 1024, 1024]


@pytest.fixture(scope="module")
def unigram():
    library = Tokenizer(models.Unigram(VOCABULARY, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return library, token_counts.Counter(VOCABULARY)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(ALPHABET | st.none(), max_size=8))
def test_counts_of_any_text(unigram, texts):
    library, mine = unigram
    assert mine.count(pa.array(texts, pa.string())).tolist() == [len(library.encode(t or "").ids) for t in texts]


def test_ties_go_as_in_the_tokenizer():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -2.0), ("ba", -2.0)]
    library = Tokenizer(models.Unigram(pieces, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    mine = token_counts.Counter(pieces)
    for text in ("a", "ab", "aba", "abab", "ba ab", "aabba", "xay", "xx yy", "axxb"):
        assert mine.count_text(text) == len(library.encode(text).ids)


def test_counts_of_odd_documents(spark, unigram):
    library, _ = unigram
    docs = helpers.odd_documents(spark)
    got = Counter(map(tuple, token_counts.count_tokens(docs, PIECES).collect()))
    assert got == Counter((r.doc_id, len(library.encode(r.text or "").ids)) for r in docs.collect())
    assert token_counts.count_tokens(helpers.empty_documents(spark), PIECES).count() == 0


def test_query_of_token_counts(spark, unigram):
    library, _ = unigram
    got = {r.doc_id: r.n_tokens for r in token_counts.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == {r.doc_id: len(library.encode(r.text).ids) for r in docs}
