"""Helpers shared by the corpus operators: shared-folder checkpoints, sorted-run streaming, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch: whole texts travel in these batches, so they are kept small; rows of a few
#: numbers still go by the thousand.
ARROW_BYTES = str(1 << 20)


def prepare(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; where none is set, one under the warehouse.

    On a cluster that warehouse must be shared: a machine's own folder is refused."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local" and warehouse.startswith(("file:", "/", "spark-warehouse")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = f"{warehouse}/_checkpoints"
        spark.sparkContext.setCheckpointDir(configured)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def _give_back() -> None:
    """Return freed memory to the system, so that idle Python workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """mapInArrow whose workers give memory back at the end of a task."""

    def run(batches):
        yield from work(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder as Parquet and read it back.

    It cuts lineage like checkpoint(), stays columnar, and gives the optimizer a true size."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream sorted by ``key`` into tables of whole key runs, with the run bounds in each.

    Only the rows of one unfinished run are held over between batches, and they are put together once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in key:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and v[0] != held[-1].column(c)[-1].as_py()
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        size, cut = sum(h.num_rows for h in held), int(starts[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks(), np.concatenate(([0], starts + size))
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.array([0, sum(h.num_rows for h in held)])


def by_runs(df: DataFrame, key: list[str], order: list[str], work: Callable, schema: str) -> DataFrame:
    """Deal rows by ``key``, sort, and give ``work`` the stream of whole key runs."""

    def run(batches):
        yield from work(runs(batches, key))
        _give_back()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


class Forest:
    """Union-find over the positions 0..n-1; the smaller position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


#: Edges that one task holds at once; graphs of no more edges are finished by one executor task.
TASK_EDGES = 1_000_000


def _contract(batches):
    """Replace a task's edges by (node, smallest node reachable), TASK_EDGES at a time: an edge a node at most."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def contract():
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            forest.join(i, j)
        root = np.fromiter((forest.find(i) for i in range(len(nodes))), dtype=np.int64, count=len(nodes))
        keep = root != np.arange(len(nodes))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= TASK_EDGES:
            yield contract()
    if held:
        yield contract()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60, small: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node that isn't itself its component's smallest node.

    ``edges`` has long columns a and b.  Each task first contracts its own edges.  If no more than
    ``small`` are left, one executor task finishes the work; else alternating large-star and small-star rounds (Kiveris et al.,
    2014): logarithmic rounds, nothing goes to the driver but two totals.  The minimum of each
    neighbourhood is aggregated map-side and stored before the edges meet it in a plain join, so
    Spark's skew-join handling can split a hub's edges.  A graph that is not done after ``rounds`` rounds
    is an error, never a partial answer."""
    prepare(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = map_arrow(e, _contract, "a long, b long").distinct().checkpoint()
    seen = _mark(e)
    if seen[0] <= small:
        e = map_arrow(e.repartition(1), _contract, "a long, b long").checkpoint()
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).checkpoint()
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        low = e.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = moved.union(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"connected components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
