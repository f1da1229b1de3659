"""Statistics over triples: type counts, meeting summaries, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fx


def endpoint_types(triples: DataFrame) -> DataFrame:
    """type, n, first_seen position over both endpoints, most frequent first."""
    e = F.explode(F.array(F.struct((F.col("mention_seq") * 2).alias("p"), F.col("subject_type").alias("type")), F.struct((F.col("mention_seq") * 2 + 1).alias("p"), F.col("object_type").alias("type")))).alias("e")
    return triples.select(e).groupBy("e.type").agg(F.count("*").alias("n"), F.min("e.p").alias("first_pos"))


def most_common(triples: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts of a column, most frequent first, ties by first appearance."""
    out = triples.groupBy(column).agg(F.count("*").alias("n"), F.min("mention_seq").alias("first_pos")).orderBy(F.desc("n"), "first_pos")
    return out.limit(k) if k else out


def confidence_histogram(triples: DataFrame) -> DataFrame:
    n = triples.groupBy(fx.confidence_bucket("confidence").alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def meeting_summary(triples: DataFrame) -> DataFrame:
    """Per meeting: triples, distinct subjects, objects, both together, in both roles, mean confidence."""
    ends = F.explode(F.array(F.struct(F.lower("subject").alias("e"), F.lit(1).alias("s"), F.lit(0).alias("o")), F.struct(F.lower("object").alias("e"), F.lit(0).alias("s"), F.lit(1).alias("o"))))
    roles = triples.select("source_meeting", ends.alias("x")).groupBy("source_meeting", "x.e").agg(F.max("x.s").alias("s"), F.max("x.o").alias("o"))
    names = roles.groupBy("source_meeting").agg(F.sum("s").alias("subjects"), F.sum("o").alias("objects"), F.count("*").alias("entities"), F.count_if((F.col("s") == 1) & (F.col("o") == 1)).alias("both_roles"))
    base = triples.groupBy("source_meeting").agg(F.count("*").alias("triples"), F.avg("confidence").alias("avg_confidence"))
    return base.join(names, "source_meeting")


def meeting_distributions(triples: DataFrame) -> DataFrame:
    """source_meeting, kind (relation or type), value, n, pct of its meeting and kind; types count both endpoints."""
    both = F.array(F.struct(F.lit("relation").alias("kind"), F.col("relation").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("subject_type").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("object_type").alias("value")))
    n = triples.select("source_meeting", F.explode(both).alias("x")).groupBy("source_meeting", "x.kind", "x.value").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("source_meeting", "kind")))


def qa_score(answers: DataFrame, ok: str, crossing: str) -> DataFrame:
    """One row: questions and right answers, of all and of those that cross meetings."""
    right, cross = F.coalesce(F.col(ok), F.lit(False)), F.coalesce(F.col(crossing), F.lit(False))
    return answers.agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count_if(cross).alias("cross_total"), F.count_if(right & cross).alias("cross_correct"))


def health(triples: DataFrame) -> DataFrame:
    """One row of indicators and flags."""
    n = F.count("*")
    flags = triples.agg(
        n.alias("triples"), F.count_distinct("source_meeting").alias("meetings"), F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("confidence") < 0.5).alias("very_low"), F.count_if(F.lower("subject") == F.lower("object")).alias("self_references"),
        F.count_if(F.col("subject").contains("SPEAKER_") | F.col("object").contains("SPEAKER_")).alias("speaker_leaks"),
    )
    types = endpoint_types(triples).agg(F.count("*").alias("types"), F.max("n").alias("top"), F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("type") == "UNKNOWN", F.col("n"))), F.lit(0)).alias("unknown"))
    rows = flags.crossJoin(types)  # one row each
    mean = F.col("triples") / F.col("meetings")
    volume = F.when(mean < 5, "LOW").when(mean > 100, "HIGH").otherwise("OK")
    diversity = F.when(F.col("types") < 3, "LOW").when(100.0 * F.col("top") / F.col("all") > 80, "DOMINATED").otherwise("OK")
    confidence = F.when(F.col("avg_confidence") < 0.6, "LOW").when(F.col("very_low") / F.col("triples") > 0.3, "MANY_LOW").otherwise("OK")
    return rows.select("triples", "meetings", mean.alias("per_meeting"), "types", (100.0 * F.col("top") / F.col("all")).alias("dominant_pct"), (100.0 * F.col("unknown") / F.col("all")).alias("unknown_pct"), "avg_confidence", "very_low", "self_references", "speaker_leaks", volume.alias("volume_flag"), diversity.alias("diversity_flag"), confidence.alias("confidence_flag"))
