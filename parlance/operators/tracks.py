"""Track data: the label rows of every condition, laid out beside their vectors, so that a sweep of runs joins without a shuffle.

Vectors and label rows are written once as tables bucketed and sorted by row id, with as many buckets; the
label rows are also parted by condition.  A run then reads its condition's folder and the buckets of the
vectors meet in place, however many runs follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder


class TrackStore:
    """Bucketed tables of vectors (row_id, x) and of label rows (condition, row_id, gold, label)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, folder: str | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or new_folder(spark, "tracks")
        self.name = "tracks_" + self.folder.rstrip("/").rsplit("-", 1)[-1].replace("/", "_").replace(".", "_").replace(":", "_")

    def _write(self, rows: DataFrame, part: str, by: list[str]) -> None:
        dealt = rows.repartition(self.buckets, "row_id")  # one file a bucket, and a condition
        writer = dealt.write.mode("errorifexists").bucketBy(self.buckets, "row_id").sortBy("row_id").option("path", f"{self.folder}/{part}")
        (writer.partitionBy(*by) if by else writer).saveAsTable(f"{self.name}_{part}")

    def write_vectors(self, vectors: DataFrame) -> None:
        """row_id, x; a row_id stands once.  Null vectors are left out: a run cannot train on them."""
        self._write(vectors.where("row_id IS NOT NULL AND x IS NOT NULL").select("row_id", "x"), "vectors", [])

    def write_labels(self, rows: DataFrame) -> None:
        """condition, row_id, gold, label of all conditions of a sweep (a condition is its name with seed and replicate)."""
        self._write(rows.select("row_id", "gold", "label", "condition"), "labels", ["condition"])

    def track(self, condition: str | None = None) -> DataFrame:
        """condition, row_id, gold, label, x of one condition, or of all; rows without a vector are left out.

        Only the condition's folder is read, and neither side is shuffled."""
        labels = self.spark.table(f"{self.name}_labels")
        labels = labels if condition is None else labels.where(F.col("condition") == condition)
        return labels.join(self.spark.table(f"{self.name}_vectors"), "row_id").select("condition", "row_id", "gold", "label", "x")

    def lost(self) -> DataFrame:
        """condition, row_id of the label rows that have no vector."""
        return self.spark.table(f"{self.name}_labels").join(self.spark.table(f"{self.name}_vectors"), "row_id", "left_anti").select("condition", "row_id")
