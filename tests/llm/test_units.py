"""Fill-in-middle, product codes and SentencePiece ids against plain versions and the library itself."""

import hashlib
import random
import re
from functools import cache

import helpers
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wattledger.llm import infill, merges, orchard
from wattledger.llm.tokens import vocabulary_path

PIECES = vocabulary_path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle

def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_units", [1, 3, 1 << 12])
def test_transformed_and_restored(spark, frame_units):
    more = ["a <P> b", "<S>", "x<M", "é" * 50, "word " * 400, "ab1c" * 60, "漢字 kanji\r\n" * 30]
    rows = [(i, t, "en") for i, t in enumerate((helpers.ODD_TEXTS + more) * 4)] + [(3, "one", "en"), (None, "one two", "en"), (None, None, None)]
    docs = helpers.documents(spark, rows)
    out = infill.transform(infill.store(docs, frame_units=frame_units))
    got = out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", infill.digest("output").alias("d"), infill.restore("output", "form").alias("r")).collect()
    want = []
    for i, t, _ in rows:
        *numbers, output = plain_infill(i, t)
        want.append((i, *numbers, sha(output), t or ""))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(infill.store(helpers.empty_documents(spark))).count() == 0


def test_only_frames_that_hold_a_cut_are_opened(monkeypatch):
    units, raw = list(range(0, 100, 10)), [b"a," * 5] * 10
    text = infill._Text(np.array(units), np.array(units), [infill._pack(r) for r in raw])
    start, one, other, end = (text.place(u, 100, 100) for u in (0, 20, 47, 100))
    parts = [text.between(*p) for p in ((start, one), (one, other), (other, end))]
    assert list(text.opened) == [4] and (one[2], other[2]) == (20, 47)
    assert parts[0] == text.frames[:2] and parts[1][:2] == text.frames[2:4] and parts[2][1:] == text.frames[5:]
    assert b"".join(infill._unpack(f) for p in parts for f in p) == b"".join(raw)


def test_frames_of_a_very_long_text(spark):
    text = ("Word, " * 50 + "é" * 20 + "z" * 500) * 4000  # 3.3 MB
    docs = helpers.documents(spark, [(12, text, "en"), (13, "x" * 3_000_000, "en")])
    got = {r.doc_id: r for r in infill.transform(infill.store(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", infill.digest("output").alias("d")).collect()}
    for i, t in ((12, text), (13, "x" * 3_000_000)):
        *numbers, output = plain_infill(i, t)
        assert tuple(got[i]) == (i, *numbers, sha(output))


# Product codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """vec_id -> (code, error) and the codebooks, with Python integers only."""
    import math

    kept = [(i, [math.floor(4096 * x) for x in e]) for i, e, _ in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    width = len(kept[0][1]) // parts
    cut = {i: [e[p * width:(p + 1) * width] for p in range(parts)] for i, e in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = {}
        for v in cut.values():
            for p in range(parts):
                members.setdefault((p, nearest(p, v[p])[1]), []).append(v[p])
        for (p, k), xs in members.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = {i: [nearest(p, v[p]) for p in range(parts)] for i, v in cut.items()}
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, books


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, "x") for i, e, label in rows], "vec_id bigint, embedding array<float>, label int, code int, error string")


def odd_vectors(n=300, size=16):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=size) * 3, 1).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]
    rows[5] = (5, rows[4][1], None)  # a repeated vector
    rows[7] = (7, [0.0] * size, 1)
    for i, bad in ((9, None), (10, []), (11, [None] + [1.0] * (size - 1)), (12, [float("nan")] * size), (13, [float("inf")] + [0.0] * (size - 1))):
        rows[i] = (i, bad, 2)
    return rows


def test_codes_equal_plain_ones(spark):
    rows = odd_vectors()
    df = vectors(spark, rows)
    books = orchard.train(df.repartition(5))
    want, plain_books = plain_codes(rows)
    assert books.tolist() == plain_books
    got = orchard.encode(df, books).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == len(want)
    codes = pa.array([r.code for r in got])
    assert orchard.decode(codes, books).shape == (len(got), 16)


def test_codes_of_few_huge_and_missing_vectors(spark):
    big = [(1, [3e38, -3e38, 1.0, 0.5, 1e20, 0.0, 2.0, -1.0], 1), (2, [1.0] * 8, 1), (None, [2.0] * 8, None), (4, [1.0] * 7, 1)]
    books = orchard.train(vectors(spark, big))
    # The vector without an id comes last among the first entries; the one of another length has no place.
    assert books.shape == (8, 3, 1) and int(books[0, 0, 0]) == int(np.float32(3e38)) * 4096
    got = {r.vec_id: r.error for r in orchard.encode(vectors(spark, big), books).collect()}
    assert got == {1: 0, 2: 0, None: 0}
    empty = vectors(spark, [])
    assert orchard.train(empty) is None and orchard.encode(empty, None).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        orchard.train(vectors(spark, [(1, [1.0] * 9, 1)]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=12), st.integers(0, 10**6))
def test_search_finds_the_first_of_the_nearest(entries, seed):
    entries = np.array(entries)
    points = np.random.default_rng(seed).integers(-4, 5, (50, 2))
    distance = ((points[:, None] - entries[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        best, found = orchard.Search(entries.astype(kind))(points.astype(kind))
        assert best.tolist() == distance.argmin(1).tolist() and found.tolist() == distance.min(1).tolist()


# SentencePiece

@cache
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@cache
def own():
    return merges.PieceEncoder(PIECES)


def ids_of(texts, encoder=None):
    return [ids[a:b].tolist() for ids, at in (encoder or own()).encode(pa.array(texts, pa.string())) for a, b in zip(at, at[1:], strict=False)]


_PARTS = [" ", "  ", "a", "b", "xx", "--", "=", "é", "ж", "漢", "😀", "\n", "\t", "\r", ".", ",", "12", "▁", "<s>", "<0x41>", "the", " of", "\0"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PARTS), max_size=40).map("".join) | st.none(), max_size=6))
def test_ids_of_any_text(texts):
    assert ids_of(texts) == [library().encode(t or "") for t in texts]


def test_ids_of_pieces_glued_together():
    rng = random.Random(5)
    pieces = [library().id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(pieces).strip() for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    texts += [("a" + " " * k) * 2 + x for k in range(70) for x in ("", "the", "ж", "1")]
    assert ids_of(texts) == [library().encode(t) for t in texts]


def test_ids_of_very_long_texts():
    rng = random.Random(6)
    one_word = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    texts = ["word, " * 600_000, " " * 100_001, one_word, "=" * 100_000, "ab" * 50_000]
    assert ids_of(texts) == [library().encode(t) for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("wattledger.llm.merges.CACHE_WORDS", 3)
    encoder = merges.PieceEncoder(PIECES)
    texts = ["a b c d e", None, "a b", "zebra"] * 2
    for _ in range(2):
        assert ids_of(texts, encoder) == [library().encode(t or "") for t in texts]


def test_round_trip_of_odd_documents(spark):
    docs = helpers.odd_documents(spark)
    got = sorted(map(str, map(tuple, merges.round_trip(docs, PIECES).collect())))
    want = []
    for r in docs.collect():
        ids = library().encode(r.text or "")
        want.append(str((r.doc_id, ids, library().decode(ids))))
    assert got == sorted(want)
    assert merges.round_trip(helpers.empty_documents(spark), PIECES).count() == 0


def test_query_digests(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in merges.query(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library().encode(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library().decode(ids)))
