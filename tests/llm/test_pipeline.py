"""Every stage of the pipeline against a plain version on its own input."""

import random
from collections import Counter
from fractions import Fraction

import helpers
import pytest
from test_pairs import brute_contamination, brute_join
from test_tokens import check_packing

import corpus_pipeline as pipeline
from wattledger.llm import language, toxicity

SF_DIR = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_order_of_the_stages():
    assert [f.__name__ for f in STAGES.values()] == ["drop_toxic", "drop_unknown_language", "drop_near_copies", "drop_contaminated", "pack"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
@pytest.mark.parametrize("make", [helpers.odd_documents, helpers.empty_documents])
def test_stages_keep_rows_and_columns_whole(spark, name, make):
    docs = make(spark)
    kept = STAGES[name](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert not rows(kept) - rows(docs)


def test_toxic_documents_go(spark, documents):
    model = toxicity.train(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_documents(documents, model).collect() if r.score >= 0.5}
    kept = {r.doc_id for r in STAGES["toxicity"](spark, documents, SF_DIR).collect()}
    assert kept == {r.doc_id for r in documents.collect()} - toxic


def test_only_texts_without_a_language_go(spark):
    docs = helpers.odd_documents(spark)
    kept = STAGES["language"](spark, docs, SF_DIR)
    assert rows(kept) == Counter(tuple(r) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    assert language.UNKNOWN == "und"


def test_texts_in_no_learned_language_go(spark):
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = [(-1 - i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(rng.randrange(50, 1500)))) for i in range(40)]
    more = docs.unionByName(spark.createDataFrame(noise, "doc_id bigint, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in STAGES["language"](spark, more, SF_DIR).select("doc_id").collect()}
    assert {i for i in kept if i >= 0} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(i < 0 for i in kept) <= 4


def test_one_of_each_group_stays(spark, documents):
    component = brute_join([(r.doc_id, r.text) for r in documents.collect()], 5, Fraction(8, 10))
    want = {i for i, _, c in component if i == c}
    assert {r.doc_id for r in STAGES["near copies"](spark, documents, SF_DIR).collect()} == want


def test_contaminated_documents_go(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    judged = brute_contamination([(r.doc_id, r.text) for r in documents.collect()], items)
    want = {i for i, *_, contaminated in judged if not contaminated}
    assert {r.doc_id for r in STAGES["decontamination"](spark, documents, SF_DIR).collect()} == want


def test_packing_holds_every_document(spark):
    docs = helpers.odd_documents(spark)
    check_packing(STAGES["packing"](spark, docs, SF_DIR).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_run_is_the_stages_one_after_the_other(spark, documents):
    docs = documents
    for stage in STAGES.values():
        docs = stage(spark, docs, SF_DIR)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(pipeline.run(spark, SF_DIR).select(*columns)) == rows(docs.select(*columns))
