"""Toxic passages and languages: parts against brute force, the whole by held-out accuracy."""

import math
import random
from collections import Counter

import helpers
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattledger.llm import language, toxicity
from wattledger.llm import textbytes as tb

SCORES = st.lists(st.integers(-4, 4).filter(bool), max_size=25)


def brute_best(values):
    return max([0, *(sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1))])


def brute_segments(values, start=0):
    """Maximal scoring segments by their definition: the best one, then left and right of it."""
    best, at = 0, None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            if sum(values[i:j]) > best:
                best, at = sum(values[i:j]), (i, j)
    if at is None:
        return []
    i, j = at
    return brute_segments(values[:i], start) + [(start + i, start + j, best)] + brute_segments(values[j:], start + j)


@settings(max_examples=300, deadline=None)
@given(SCORES)
def test_segments_by_definition(values):
    # Different weights make the best segment unique.
    values = [v + 0.001 * (i + 1) ** 1.5 * (1 if v > 0 else -1) for i, v in enumerate(values)]
    heads, total = toxicity._run_sums(np.array(values, float), np.zeros(len(values), int))
    got = toxicity.segments(heads, total, len(values))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(values)]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in brute_segments(values)])


@settings(max_examples=200, deadline=None)
@given(st.lists(SCORES, max_size=6))
def test_best_segment_of_each_row(rows):
    score = np.array([x for r in rows for x in r], float)
    first = np.cumsum([0, *map(len, rows)])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    empty = np.zeros(0, np.int64)
    assert toxicity.best_segments(tb.Words(empty, empty, row, empty, first), score).tolist() == pytest.approx([brute_best(r) for r in rows])


@settings(max_examples=200, deadline=None)
@given(st.lists(SCORES, max_size=6), st.sampled_from([0.002, 0.3]))
def test_evidence_of_all_passages(rows, scale):
    rows = [[v + 0.001 * (i + 1) ** 1.5 * (1 if v > 0 else -1) for i, v in enumerate(r)] for r in rows]
    model = toxicity.Model(np.zeros(1, np.float32), 0.7, scale, (0.0, 1.0))
    first = np.cumsum([0, *map(len, rows)])
    empty = np.zeros(0, np.int64)
    found = tb.Words(empty, empty, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), empty, first)
    evidence, passages = toxicity.passages_of(model, found, np.array([x for r in rows for x in r], float))
    for r, values in enumerate(rows):
        level = math.log(scale * max(len(values), 1))
        above = [(a, b, s) for a, b, s in brute_segments(values) if 0.7 * s > level]
        assert [(a, b) for a, b, _ in passages[r]] == [(a, b) for a, b, _ in above]
        best, total = 0.0, 0.0
        for n, x in enumerate(sorted((0.7 * s - level for *_, s in above), reverse=True), 1):
            total += x
            chance = math.exp(-total) * total ** (n - 1) / math.factorial(n) / math.factorial(n - 1) * 2 ** (n - 1)
            best = max(best, -math.log(chance))
        assert evidence[r] == pytest.approx(best, abs=1e-9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB é.\n☃", max_size=20), max_size=6))
def test_words_of_any_text(texts):
    import re

    for _, data, offsets in tb.slices(pa.array(texts, pa.string()), 8):
        found = tb.words(data, offsets)
        pieces = [bytes(data[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]
        rows = [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:], strict=False)]
        want = [re.findall(r"[^\x20\x09-\x0D]+", r) for r in rows]
        assert pieces == [w for r in want for w in r] and np.diff(found.first).tolist() == [len(r) for r in want]
        same = {}
        for piece, h in zip(pieces, found.hash.tolist(), strict=True):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), piece)
            assert same.setdefault(key, h) == h
        assert len(set(same.values())) == len(same)


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ba be bi bo bu da de di".split() for b in "la le li lo lu na ne".split()]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["vile", "nasty", "rotten", f"grim{rng.choice(words)}"]) for _ in range(rng.randrange(1, 4))]
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxic_texts_are_found(spark):
    rows, labels = toxic_corpus(1, 900)
    docs, marks = helpers.documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks.filter("doc_id < 600"))
    scored = toxicity.score_documents(docs, model).join(marks, "doc_id").filter("doc_id >= 600").collect()
    wrong = Counter(r.toxic for r in scored if (r.score >= 0.5) != bool(r.toxic))
    assert sum(wrong.values()) <= 3 and all(0 <= r.score <= 1 for r in scored)
    for r in scored:
        words = rows[r.doc_id][1].split()
        for p in r.passages:
            assert any(w in ("vile", "nasty", "rotten") or w.startswith("grim") for w in words[p.first:p.until])


def test_repeats_within_a_text_are_one_word(spark):
    """Texts that say some word of their own thirty times teach nothing about it, and are not toxic for it."""
    rows, labels = toxic_corpus(6, 900)
    rng = random.Random(7)
    spoken = sorted({w for _, text, _ in rows for w in text.split()} - {"vile", "nasty", "rotten"})
    rows = [(i, f"{text} {' '.join(w for w in rng.sample(spoken, 5) for _ in range(30))}" if i % 3 == 0 else text, lang) for i, text, lang in rows]
    docs, marks = helpers.documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks.filter("doc_id < 600"))
    scored = toxicity.score_documents(docs, model).join(marks, "doc_id").filter("doc_id >= 600").collect()
    wrong = Counter(r.toxic for r in scored if (r.score >= 0.5) != bool(r.toxic))
    assert sum(wrong.values()) <= 9
    once = toxicity.count_words(helpers.documents(spark, [(1, "Vile vile vile", "en")])).collect()
    assert sum(r.n for r in once) == 1 + len(toxicity.PREFIXES)


def test_scores_do_not_depend_on_the_bound_of_rows(spark, monkeypatch):
    """Texts with one doubtful word are toxic in three of ten cases, however many clean rows are learned from."""
    rows, labels = toxic_corpus(4, 900)
    rng = random.Random(5)
    clean = [i for i, _, bad in labels if not bad]
    grey = set(rng.sample(clean, 240))
    rows = [(i, f"{text} edgy edgy" if i in grey else text, lang) for i, text, lang in rows]
    labels = [(i, q, int(rng.random() < 0.3) if i in grey else bad) for i, q, bad in labels]
    docs, marks = helpers.documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")

    def grey_mean():
        got = toxicity.score_documents(docs, toxicity.train(docs, marks)).collect()
        return float(np.mean([r.score for r in got if r.doc_id in grey]))

    whole = grey_mean()
    monkeypatch.setattr(toxicity, "TRAIN_PER_CLASS", 240)
    assert sum(not bad for *_, bad in labels) > 2 * 240
    assert abs(grey_mean() - whole) < 0.08


def test_toxicity_of_odd_tables(spark):
    rows, labels = toxic_corpus(2, 200)
    marks = [*labels, (0, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 1), (9999, 0, 1)]
    model = toxicity.train(helpers.documents(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    odd = helpers.odd_documents(spark)
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.n_words for r in got if r.doc_id in (0, 1, 2)} == {0}
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    blank = toxicity.train(odd, none)
    assert all(r.score < 0.5 and not r.passages for r in toxicity.score_documents(odd, blank).collect())
    empty = helpers.empty_documents(spark)
    assert toxicity.score_documents(empty, toxicity.train(empty, none)).count() == 0


def test_query_of_toxicity(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert got.count() == docs == got.filter("score BETWEEN 0 AND 1 AND predicted = cast(score >= 0.5 AS int)").count()


def test_toxic_documents_of_the_table(spark):
    """Held-out rows: at least 80 of 97 toxic ones are found, with at most 9 clean ones among them."""
    sf_dir = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.query(spark, sf_dir).filter("held_out").join(marks, "doc_id").collect()
    found = Counter((r.toxic, r.predicted) for r in held)
    assert found[1, 1] >= 80 and found[0, 1] <= 9 and found[1, 1] + found[1, 0] == 97


def test_labels_and_ids_are_no_input(spark):
    rows, labels = toxic_corpus(3, 200)
    docs, marks = helpers.documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit("xx"))
    one, two = (sorted(r.score for r in toxicity.score_documents(d, model).collect()) for d in (docs, moved))
    assert one == two


def test_language_of_held_out_documents(spark):
    got = language.query(spark, "/root/testdata/sf0.01").filter("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98


def test_folded_weights_are_kernel_values(spark):
    """Scoring by one product equals the weighted sum of kernel values with the landmarks."""
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "a dog", "un chien"]
    x = np.concatenate([m for _, m in language._presence(pa.array(texts))])
    grams = [{(n, t.encode()[i:i + n]) for n in language.LENGTHS for i in range(len(t.encode()) - n + 1)} for t in texts]
    exact = np.array([[len(a & b) for b in grams] for a in grams])
    assert np.abs(x @ x.T - exact).max() <= 1  # a collision of hashed columns at most


def test_language_of_odd_tables(spark):
    odd = helpers.odd_documents(spark)
    model = language.train(odd)
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    unknown = {r.doc_id for r in got if r.lang_pred == language.UNKNOWN}
    assert {0, 1, 2, 7, 8} <= unknown and 3 not in unknown
    assert all(r.score == 0 for r in got if r.lang_pred == language.UNKNOWN)
    nothing = language.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None and {r.lang_pred for r in language.identify(odd, nothing).collect()} == {language.UNKNOWN}
    empty = helpers.empty_documents(spark)
    assert language.train(empty) is None and language.identify(empty, None).count() == 0


def test_every_labelled_language_is_learned(spark):
    rows = [(3 * k + i, f"{chr(0x4E00 + 5 * k) * 6} {chr(0x4E01 + 5 * k) * (4 + i)}", f"l{k:02}") for k in range(70) for i in range(3)]
    docs = helpers.documents(spark, rows)
    model = language.train(docs)
    assert len(model.languages) == 70
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
