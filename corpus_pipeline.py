"""From raw documents to packed training sequences: five stages over the operators of wattledger.llm.

Each stage works on all rows the stage before kept, judges a document by its own
text and passes on the columns it was given. A document goes if it is toxic, if
its language cannot be told, if a similar document stays in its place, or if it
holds a passage of a benchmark item; what is left is packed.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattledger.llm import language, packing, setjoin, toxicity, winnow
from wattledger.llm.common import stored, table
from wattledger.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half; all labels are learned from.

    A null text has no toxic passage and stays. Without labels nothing is toxic.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(F.coalesce(toxicity.score_udf(model)("text")["score"], F.lit(0.0)) < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts, texts without a letter and those that are in no learned language go.

    Learned from the rows that name theirs. A text is in none if its best value is below the language's margin,
    which learned rows that were held out set; where those are too few, only the letters decide.
    """
    model = language.train(docs)
    if model is None:  # nothing to tell languages by
        return docs.filter(language.has_letter())
    found = docs.withColumn("__found", language.predicted(model)).filter(F.col("__found.lang_pred") != language.UNKNOWN)
    margin = F.create_map(*[F.lit(x) for pair in zip(model.languages, model.margins, strict=True) for x in pair])[F.col("__found.lang_pred")]
    return found.filter(F.col("__found.score") >= F.least(margin, F.lit(1.0))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity connects: the one with the smallest doc_id.

    Sets of five words, similarity 0.8 or more. Of rows with one doc_id, which are
    one document, the first by text stays; rows without an id stay.
    """
    groups = setjoin.similar_documents(docs, 5, Fraction(8, 10))
    # Written tables have a known size: Spark sends them to all tasks only if they are small.
    gone = stored(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    repeated = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    first = Window.partitionBy("doc_id").orderBy("text")
    one = left.join(repeated, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").select(docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item, nor hold a shorter item whole."""
    judged = winnow.contamination(docs, table(spark, sf_dir, "benchmark"), with_key=True)
    bad = stored(judged.filter("contaminated").select("doc_id", "key").distinct(), "contaminated").alias("bad")
    same = F.col("docs.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64("docs.text") == F.col("bad.key"))
    return docs.alias("docs").join(bad, same, "left_anti").select("docs.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and its place there."""
    packed = packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), end_id=2, attached_space=True, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Scores of trained models and the packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
