"""Meetings as a stream: each micro-batch of triples updates the stored nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import graph, triples


def event_counts(stream: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Tumbling counts by event time; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def read_triples(spark: SparkSession, path: str, schema: str | StructType, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


#: Buckets of names that the node table is kept in; a batch rewrites only those it touches.
BUCKETS = 64


class GraphStore:
    """Nodes and edges as versioned Parquet tables in one folder.

    A batch is written under its own number, so a batch that is run again overwrites only itself: edges are
    partitioned by batch, and nodes by batch and bucket of names.  The newest version of each bucket counts;
    versions that no repeated batch can need any more are removed, so there are BUCKETS version folders or so at any
    time.  Nodes are written last: a batch is there, edges and all, when its version of the nodes is finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, path: str, key: str) -> dict[int, str]:
        """Number -> folder of the ``key=number`` folders in a folder."""
        at = self._fs_path(path)
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        names = [(s.getPath().getName(), s.getPath().toString()) for s in found]
        return {int(n.split("=")[1]): p for n, p in names if n.startswith(f"{key}=")}

    def _buckets(self, before: int | None = None) -> dict[int, list[str]]:
        """The folders of each bucket, oldest first, among the finished batches."""
        out: dict[int, list[str]] = {}
        for v, folder in sorted(self._list(f"{self.path}/nodes", "v").items()):
            if (before is None or v < before) and self._fs.exists(self._fs_path(f"{folder}/_SUCCESS")):
                for k, path in self._list(folder, "bucket").items():
                    out.setdefault(k, []).append(path)
        return out

    def nodes(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [p[-1] for k, p in self._buckets(before).items() if buckets is None or k in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def newest(self) -> int:
        """Number of the last finished batch, -1 before the first."""
        done = (v for v, folder in sorted(self._list(f"{self.path}/nodes", "v").items(), reverse=True) if self._fs.exists(self._fs_path(f"{folder}/_SUCCESS")))
        return next(done, -1)

    def edges(self) -> DataFrame:
        """The edges of all finished batches; those of one under way are not seen."""
        return self.spark.read.parquet(f"{self.path}/edges").where(F.col("batch") <= self.newest())

    def update(self, batch: DataFrame, number: int) -> None:
        """Fold one batch in; the same batch may come again after a failure."""
        clean = triples.dedup_triples(triples.drop_empty(triples.drop_placeholders(batch)))
        graph.build_edges(clean).write.mode("overwrite").parquet(f"{self.path}/edges/batch={number}")
        new, bucket = graph.build_nodes(clean), F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int")
        touched = [r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS rows at most
        old = self.nodes(number, touched)
        merged = new if old is None else graph.upsert_nodes(old, new)
        merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/nodes/v={number}")
        before = self._buckets(number)
        for k in touched:
            for path in before.get(k, [])[:-1]:
                self._fs.delete(self._fs_path(path), True)
        for v, folder in self._list(f"{self.path}/nodes", "v").items():
            if v < number and not self._list(folder, "bucket"):
                self._fs.delete(self._fs_path(folder), True)


def run(stream: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Start the update of the store; all files that are there now are taken, then it ends."""
    return stream.writeStream.foreachBatch(store.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
