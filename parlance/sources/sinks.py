"""Writers and the graph's flat-file form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "name STRING, type STRING, first_seen DATE, last_seen DATE, first_meeting STRING, last_meeting STRING, resolved_date DATE"
EDGE = "edge_id BIGINT, src STRING, dst STRING, type STRING, confidence DOUBLE, source_meeting STRING, meeting_date DATE, stated_at TIMESTAMP_NTZ, utterance_time DOUBLE"


def write_triples(triples: DataFrame, path: str) -> None:
    """JSON lines, a folder a meeting."""
    triples.write.mode("overwrite").partitionBy("source_meeting").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/entities")
    edges.write.mode("overwrite").json(f"{path}/relations")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); a part that isn't there is an empty table."""
    jvm = spark._jvm

    def read(name: str, kind: str) -> DataFrame:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(kind).json(f"{path}/{name}") if there else spark.createDataFrame([], kind)

    return read("entities", NODE), read("relations", EDGE)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph as text for a reader that takes it at once: part, key, line; nodes by name, then edges by id.

    Order is in (part, key), not in the rows."""
    node = F.format_string("%s (%s)", "name", F.coalesce("type", F.lit("UNKNOWN")))
    when = F.coalesce(F.concat(F.lit(", "), F.col("stated_at").cast("string")), F.lit(""))
    edge = F.concat(F.format_string("%s -[%s]-> %s [%s", "src", "type", "dst", "source_meeting"), when, F.lit("]"))
    named = nodes.select(F.lit(0).alias("part"), F.col("name").alias("key"), node.alias("line"))
    return named.union(edges.select(F.lit(1), F.lpad(F.col("edge_id").cast("string"), 20, "0"), edge))


def clear_graph(spark: SparkSession, path: str) -> None:
    write_graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as a JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def report_json(report: DataFrame) -> str:
    return json.dumps(report.first().asDict(), sort_keys=True, default=str)


def append_cache(answers: DataFrame, path: str) -> None:
    """Teacher answers (key, answer) by the first two digits of the key."""
    answers.withColumn("shard", F.left("key", F.lit(2))).write.mode("append").partitionBy("shard").parquet(path)


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their answer, misses); an answer that is null counts as a miss, the first of several wins."""
    usable = cache.where("answer IS NOT NULL").groupBy("key").agg(F.min("answer").alias("answer"))
    return requests.join(usable, "key"), requests.join(usable, "key", "left_anti")
