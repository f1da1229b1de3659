"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import common, dedup, language_id, mixing, ngram_join, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Largest list of dropped documents that is sent to every task; a longer one meets them in a shuffled join.
SEND_ROWS = 500_000
#: Share of a document's text that its main language must have.
LEAST_SHARE = 0.5


def _without(docs: DataFrame, dropped: DataFrame, on: Column) -> DataFrame:
    dropped = dropped.checkpoint()
    return docs.join(F.broadcast(dropped) if dropped.count() <= SEND_ROWS else dropped, on, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language stay: those in which no language can be told (null, or without a
    letter) go, and so do mixtures in which no language has LEAST_SHARE of the text.

    What was inferred goes on in ``lang``: the language set with its proportions is boiled down to the main
    one, whatever label, or none, a document bore.  Where nothing could be learnt (no document has a
    language), none can be told."""
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.fit(docs))
    found = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that of the largest doc_id."""
    docs = docs.select(*COLUMNS)
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    old = F.coalesce(F.col("doc_id") <= ((span.low or 0) + (span.high or 0)) // 2, F.lit(True))
    found = dedup.exact_dedup(docs.where(old), docs.where(~old)).select(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_text"), "kept")
    on = docs.doc_id.eqNullSafe(F.col("of_id")) & (F.sha2(F.coalesce(docs.text, F.lit("")).cast("binary"), 256) == F.col("of_text"))
    out = _without(docs, found.where("NOT kept").select("of_id", "of_text").distinct(), on)
    again = found.where("kept").groupBy("of_id", "of_text").count().where("count > 1").select("of_id", "of_text").checkpoint()
    if again.isEmpty():
        return out
    once = out.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, on, "left_anti").union(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.ngram_jaccard_components(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("of_id")).distinct()
    return _without(docs, gone, docs.doc_id == F.col("of_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time a document is taken; a document that is taken in part is taken whole.

    A null source is a source of its own.  Documents without words are never taken.  Ties of the seeded
    order go by id and size."""
    out = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), keep=COLUMNS)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return out.where("taken > 0").withColumn("time", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, cut at window ends only.  A row that was taken twice is packed twice; null texts are
    one token, a null source a queue of its own, and equal due times go by source and place."""
    return packing.pack(docs, whole=True)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mixed), ("packing", packed)]
#: Language models and flow routing are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
