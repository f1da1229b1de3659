"""Speaker naming: application of a speaker map, and the deterministic rules that make one from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fx


def apply_speaker_map(utterances: DataFrame, names: DataFrame) -> DataFrame:
    """Rename speakers by (meeting_id, speaker_id, name); unmapped ones keep their label."""
    out = utterances.join(names.select("meeting_id", "speaker_id", "name"), ["meeting_id", "speaker_id"], "left")
    return out.withColumn("speaker_id", F.coalesce("name", "speaker_id")).drop("name")


def validate_answers(answers: DataFrame, labels: DataFrame, roster: DataFrame) -> DataFrame:
    """Answers (meeting_id, speaker_id, name) with a known label and a real name on the roster, in its spelling."""
    real = answers.join(labels.select("meeting_id", "speaker_id"), ["meeting_id", "speaker_id"], "left_semi").withColumn("name", fx.strip("name")).where(F.col("name") != "").where(~fx.is_placeholder("name"))
    spelled = roster.groupBy("meeting_id", F.lower("name").alias("key")).agg(F.max_by("name", "pos").alias("spelling"))
    return real.withColumn("key", F.lower("name")).join(spelled, ["meeting_id", "key"]).select("meeting_id", "speaker_id", F.col("spelling").alias("name"))


def one_label_a_name(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """Of several labels with one name the one with most utterances stays (first label on ties)."""
    w = Window.partitionBy("meeting_id", "name").orderBy(F.desc("n_utterances"), "speaker_id")
    rows = mapping.join(labels, ["meeting_id", "speaker_id"]).withColumn("_rn", F.row_number().over(w))
    return rows.where("_rn = 1").select("meeting_id", "speaker_id", "name")


def eliminate(mapping: DataFrame, labels: DataFrame, roster: DataFrame) -> DataFrame:
    """Where labels and roster are equally many and one of each is left, they belong together."""
    even = labels.groupBy("meeting_id").agg(F.count("*").alias("nl")).join(roster.groupBy("meeting_id").agg(F.count("*").alias("nr")), "meeting_id").where("nl = nr")
    free_l = labels.join(mapping, ["meeting_id", "speaker_id"], "left_anti").groupBy("meeting_id").agg(F.count("*").alias("n1"), F.min("speaker_id").alias("speaker_id"))
    free_r = roster.join(mapping, ["meeting_id", "name"], "left_anti").groupBy("meeting_id").agg(F.count("*").alias("n2"), F.min("name").alias("name"))
    forced = even.join(free_l, "meeting_id").join(free_r, "meeting_id").where("n1 = 1 AND n2 = 1")
    return mapping.union(forced.select("meeting_id", "speaker_id", "name"))


def name_speakers(answers: DataFrame, utterances: DataFrame, roster: DataFrame) -> DataFrame:
    """The whole chain: validation, one label a name, elimination."""
    labels = utterances.groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n_utterances"))
    return eliminate(one_label_a_name(validate_answers(answers, labels, roster), labels), labels, roster)
