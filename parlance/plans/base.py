"""Registration of queries, and the views that project the driver's tables onto the data model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a function as a query under its name, with its SQL and the views that the SQL uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {views}\n" if views else "") + sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- utterances: a conversation is a meeting, its turns have a 4 s clock

UTTERANCES = """u AS (SELECT conv_id AS meeting_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seq,
  role AS speaker_id, text, 4.0::DOUBLE * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS start_time,
  4.0::DOUBLE * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS end_time FROM conversations)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), (n - 1).cast("int").alias("seq"), F.col("role").alias("speaker_id"), "text", ((n - 1) * F.lit(4.0)).alias("start_time"), (n * F.lit(4.0)).alias("end_time"))


# --- triples: an event is what a user said of an item on a day

TRIPLES = """e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events),
t AS (SELECT event_id AS mention_seq,
  CASE WHEN event_id % 97 = 0 THEN 'SPEAKER_' || (user_id % 4) WHEN event_id % 2 = 0 THEN 'User ' || user_id ELSE 'user ' || user_id END AS subject,
  CASE WHEN user_id % 7 = 0 THEN 'DEPARTMENT' ELSE 'PERSON' END AS subject_type,
  CASE event_type WHEN 'click' THEN 'discussed' WHEN 'view' THEN 'reports_to' WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'assigned_to' ELSE 'off_topic' END AS relation,
  CASE WHEN event_id % 53 = 0 THEN 'User ' || user_id ELSE 'Item ' || k END AS object,
  CASE WHEN event_id % 53 = 0 THEN 'PERSON' ELSE CASE k % 5 WHEN 0 THEN 'COURSE' WHEN 1 THEN 'PROJECT' WHEN 2 THEN 'DEADLINE' WHEN 3 THEN 'EVENT' ELSE 'UNKNOWN' END END AS object_type,
  CASE WHEN value >= 100 THEN 1.0::DOUBLE ELSE value / 100 END AS confidence,
  'm' || strftime(ts, '%Y%m%d') AS source_meeting, CAST(ts AS DATE) AS meeting_date,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS "timestamp",
  CASE WHEN k % 10 IN (0, 2) THEN strftime(CAST(ts AS DATE) + CAST(k AS INTEGER), '%Y-%m-%d') WHEN k % 10 = 1 THEN 'next Friday' ELSE '' END AS deadline_date
  FROM e)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    user = F.col("user_id").cast("string")
    subject = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("SPEAKER_"), (F.col("user_id") % 4).cast("string"))).when(F.col("event_id") % 2 == 0, F.concat(F.lit("User "), user)).otherwise(F.concat(F.lit("user "), user))
    relation = F.when(F.col("event_type") == "click", "discussed").when(F.col("event_type") == "view", "reports_to").when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "signup", "assigned_to").otherwise("off_topic")
    back = F.col("event_id") % 53 == 0
    kind = F.when(back, "PERSON").when(F.col("k") % 5 == 0, "COURSE").when(F.col("k") % 5 == 1, "PROJECT").when(F.col("k") % 5 == 2, "DEADLINE").when(F.col("k") % 5 == 3, "EVENT").otherwise("UNKNOWN")
    due = F.when((F.col("k") % 10).isin(0, 2), F.date_format(F.date_add(F.col("ts").cast("date"), F.col("k")), "yyyy-MM-dd")).when(F.col("k") % 10 == 1, "next Friday").otherwise("")
    return e.select(
        F.col("event_id").alias("mention_seq"), subject.alias("subject"), F.when(F.col("user_id") % 7 == 0, "DEPARTMENT").otherwise("PERSON").alias("subject_type"), relation.alias("relation"),
        F.when(back, F.concat(F.lit("User "), user)).otherwise(F.concat(F.lit("Item "), F.col("k").cast("string"))).alias("object"), kind.alias("object_type"),
        F.when(F.col("value") >= 100, 1.0).otherwise(F.col("value") / 100).alias("confidence"), F.concat(F.lit("m"), F.date_format("ts", "yyyyMMdd")).alias("source_meeting"), F.col("ts").cast("date").alias("meeting_date"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("timestamp"), due.alias("deadline_date"),
    )


# --- labels: gold is the class of a vector, the teacher names the next class for a share of the rows

LABELS = """l AS (SELECT vec_id AS row_id, label AS gold, CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1 + vec_id % 4) % 10 ELSE label END AS INT) AS teacher,
  CAST(CASE WHEN label <= 2 THEN 0 WHEN label <= 5 THEN 1 ELSE 2 END AS INT) AS task FROM embeddings WHERE label IS NOT NULL)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, task = F.col("vec_id"), F.when(F.col("label") <= 2, 0).when(F.col("label") <= 5, 1).otherwise(2)
    return table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(v.alias("row_id"), F.col("label").alias("gold"), F.when(v % 3 == 0, (F.col("label") + 1 + v % 4) % 10).otherwise(F.col("label")).cast("int").alias("teacher"), task.cast("int").alias("task"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("x"))
