"""Teacher labelling of a dialogue corpus, with a cache of answers that a later run goes on from.

A dialogue is one request.  Its key is a digest of text, pairs, model and prompt version, so another
prompt or model asks anew, and dialogues that are alike ask once.  A run joins its keys with the cache,
calls the teacher for the keys that have no usable entry, and appends what it got in waves of key
prefixes: each wave is one committed write, so a run that dies repeats the calls of one wave, and a lost
task repeats its own.  Answers of a key that was asked twice are as good as one another; the smallest counts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx
from ..sources.scratch import exists, stored
from . import labels

#: What an entry holds; a line that is no such object is corrupt.
ENTRY = "key STRING, raw STRING, model STRING, prompt_version STRING, corrupt STRING"
ANSWER = "struct<labels: array<struct<index: string, relation: string>>>"
#: Key prefixes that are committed one after the other (16 at most).
WAVES = 16


def requests(dialogues: DataFrame, model: str, version: str = schema.PROMPT_VERSION) -> DataFrame:
    """``dialogues`` (dialogue_id, text, pairs of x, x_type, y, y_type, gold_relations) with their ``key``."""
    return dialogues.withColumn("key", fx.cache_key(F.col("text"), F.col("pairs"), F.lit(model), F.lit(version)))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, raw) of the usable entries; corrupt lines and entries without an answer are passed over."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, raw string")
    lines = spark.read.schema(ENTRY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return lines.where("corrupt IS NULL AND key IS NOT NULL AND raw IS NOT NULL").groupBy("key").agg(F.min("raw").alias("raw"))


def append_entries(entries: DataFrame, path: str) -> None:
    """Add (key, raw, model, prompt_version) as JSON lines, a folder a key prefix."""
    entries.withColumn("shard", F.left("key", F.lit(2))).write.mode("append").partitionBy("shard").json(path)


def split_cached(asked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their ``raw`` answer, misses); a dry run needs no more than their counts."""
    known = read_entries(asked.sparkSession, path)
    return asked.join(known, "key"), asked.join(known, "key", "left_anti")


def call(rows: DataFrame, teacher: Callable[[str, list], str], text: str = "text", pairs: str = "pairs") -> DataFrame:
    """``rows`` with ``raw`` and ``error``: teacher(text, pairs) is called once a row, in Arrow batches.

    A call that raises gives its error, and its row is asked again by the next run."""

    def one(said, found):
        try:
            return {"raw": teacher(said, [dict(p) for p in found]), "error": None}
        except Exception as e:
            return {"raw": None, "error": f"{type(e).__name__}: {e}"[:200]}

    @F.pandas_udf("struct<raw: string, error: string>")
    def ask(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, p) for t, p in zip(texts, lists)], columns=["raw", "error"])

    return rows.withColumn("_a", ask.asNondeterministic()(F.col(text), F.col(pairs))).select(*rows.columns, "_a.raw", "_a.error")


def fill_cache(asked: DataFrame, teacher: Callable[[str, list], str], path: str, model: str, version: str = schema.PROMPT_VERSION, waves: int = WAVES) -> DataFrame:
    """Ask the teacher for every key without a usable entry, and keep the answers.

    Gives (key, state, error) of all keys: ``hit``, ``new`` or ``failed``."""
    hits, misses = split_cached(asked, path)
    wave = F.conv(F.left("key", F.lit(1)), 16, 10).cast("int") % max(1, min(waves, 16))
    hits = stored(hits.select("key").distinct(), "hits")
    misses = stored(misses.groupBy("key").agg(F.min_by("text", "dialogue_id").alias("text"), F.min_by("pairs", "dialogue_id").alias("pairs")).withColumn("wave", wave), "misses")
    done = []
    for row in misses.select("wave").distinct().orderBy("wave").collect():  # 16 at most
        said = stored(call(misses.where(F.col("wave") == row.wave), teacher).select("key", "raw", "error"), "answers")
        append_entries(said.where("raw IS NOT NULL").select("key", "raw", F.lit(model).alias("model"), F.lit(version).alias("prompt_version")), path)
        done.append(said.select("key", F.when(F.col("raw").isNotNull(), "new").otherwise("failed").alias("state"), "error"))
    out = hits.select("key", F.lit("hit").alias("state"), F.lit(None).cast("string").alias("error"))
    for d in done:
        out = out.union(d)
    return out


def parse_answers(answers: DataFrame, legal: list[str] = schema.DIALOGUE_RELATIONS) -> DataFrame:
    """(dialogue_id, index, relation) of raw answers: fences go, the text from the first brace to the last is
    read, and of an index's legal relations the last one counts.  Other entries are passed over."""
    text = F.regexp_extract(fx.strip_fences("raw"), r"(?s)\{.*\}", 0)
    rows = answers.withColumn("_n", F.size("pairs")).select("dialogue_id", "_n", F.posexplode(F.from_json(F.when(text != "", text), ANSWER)["labels"]).alias("pos", "said"))
    rows = rows.select(F.col("dialogue_id").alias("dialogue"), "_n", "pos", F.expr("try_cast(said.index AS int)").alias("index"), fx.strip("said.relation").alias("relation"))
    return labels.last_answer(rows.where("index < _n"), 1 << 30, legal).withColumnRenamed("dialogue", "dialogue_id")


def labelled_rows(dialogues: DataFrame, answers: DataFrame) -> DataFrame:
    """A row a labelled pair: dialogue_id, index, subject, object, relation, gold_relations, multilabel, teacher_correct.

    Pairs without an answer are left out.  Pairs of several gold labels are told by ``multilabel``: the
    teacher has seen them, and a training set leaves them out."""
    pairs = dialogues.select("dialogue_id", F.posexplode("pairs").alias("index", "p"))
    met = pairs.join(answers, ["dialogue_id", "index"])
    return met.select("dialogue_id", "index", F.col("p.x").alias("subject"), F.col("p.y").alias("object"), "relation", F.col("p.gold_relations").alias("gold_relations"), fx.is_multilabel("p.gold_relations").alias("multilabel"), F.array_contains("p.gold_relations", F.col("relation")).alias("teacher_correct"))


def label_corpus(dialogues: DataFrame, teacher: Callable[[str, list], str], path: str, model: str, version: str = schema.PROMPT_VERSION, legal: list[str] = schema.DIALOGUE_RELATIONS, waves: int = WAVES) -> tuple[DataFrame, DataFrame]:
    """(training rows, report of one row) of a labelling run over ``dialogues`` with the cache at ``path``.

    Run again, it calls the teacher only for what failed, is corrupt or is new.  A null text or an empty list of
    pairs is a request like any other.  dialogue_id is unique."""
    asked = requests(dialogues, model, version)
    states = fill_cache(asked, teacher, path, model, version, waves)
    hits, _ = split_cached(asked, path)
    rows = stored(labelled_rows(dialogues, parse_answers(hits, legal)), "labelled")
    return rows.where("NOT multilabel").drop("multilabel"), labelling_report(rows, states, legal)


def labelling_report(rows: DataFrame, states: DataFrame, legal: list[str], thin: int = 20) -> DataFrame:
    """One row: hits, new, failed, labelled, multilabel_dropped, correct, agreement, types_used, absent, thin."""
    runs = states.agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("hit", "hits"), ("new", "new"), ("failed", "failed"))])
    kept = rows.where("NOT multilabel")
    counts = kept.groupBy("relation").agg(F.count("*").alias("n"), F.count_if("teacher_correct").alias("ok"))  # a row a legal relation
    names = lambda c: F.array_join(F.array_sort(c), ",")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"), F.count("*").alias("types_used"), names(F.array_except(F.array(*map(F.lit, legal)), F.collect_set("relation"))).alias("absent"), names(F.collect_list(F.when(F.col("n") < thin, F.col("relation")))).alias("thin"))
    dropped = rows.agg(F.count_if("multilabel").alias("multilabel_dropped"))
    one = runs.crossJoin(total).crossJoin(dropped)
    return one.select("hits", "new", "failed", "labelled", "multilabel_dropped", "correct", F.try_divide("correct", "labelled").alias("agreement"), "types_used", "absent", "thin")
