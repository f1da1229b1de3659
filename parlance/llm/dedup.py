"""Exact deduplication of a batch against an immutable snapshot, screened by static binary-fuse filters.

The snapshot's digests are grouped into exact buckets once; every bucket range gets a binary-fuse
filter (Graf & Lemire, 2022) that never changes.  Digests of the incoming batch are grouped among
themselves, screened by the filter of their range, and only the positives join the exact buckets.
Texts of groups with more than one row are then compared byte by byte, so that a match never rests
on a digest alone.

``exact_dedup`` takes both tables at once.  ``write_snapshot`` stores buckets and filters for good, and
``dedup_batch`` screens any number of later batches with them, without reading the old texts again but
for the positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_runs, prepare, read_table

#: Digests that a filter should hold, and the largest group table that is sent to every task.
SHARD_KEYS, SEND_ROWS = 50_000, 500_000

_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.full(1, seed & (2**64 - 1), dtype=np.uint64)
    x = (x ^ (x >> _U(33))) * np.full(1, 0xFF51AFD7ED558CCD, dtype=np.uint64)
    x = (x ^ (x >> _U(33))) * np.full(1, 0xC4CEB9FE1A85EC53, dtype=np.uint64)
    return x ^ (x >> _U(33))


class BinaryFuse:
    """A static three-way binary-fuse filter with 8-bit fingerprints over 64-bit keys.

    No false negatives; false positives in about 1 of 256 lookups, at about 9 bits a key."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, self.seed)
        first = ((h >> _U(32)) * _U(self.count)) >> _U(32)
        at = np.empty((len(keys), 3), dtype=np.int64)
        for k in range(3):
            inner = _mix(h, 0x9E3779B9 * (k + 1)) & _U(self.segment - 1)
            at[:, k] = ((first + _U(k)) * _U(self.segment) + inner).astype(np.int64)
        return at, (h ^ (h >> _U(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(1, len(keys))
        segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        count = max(1, -(-int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) // segment))
        for seed in range(1, 200):
            if seed % 20 == 0:
                count += max(1, count // 8)
            f = cls(seed, segment, count, np.zeros((count + 2) * segment, dtype=np.uint8))
            at, print_ = f._places(keys)
            order = f._peel(at)
            if order is not None:
                table = f.table
                for key, place in order:
                    a, b, c = at[key]
                    table[place] = print_[key] ^ table[a] ^ table[b] ^ table[c] ^ table[place]
                return f
        raise RuntimeError("no binary-fuse filter was found for these keys")

    def _peel(self, at: np.ndarray) -> list[tuple[int, int]] | None:
        """Keys in the order in which their fingerprints are set, each with the place that is its own."""
        n = len(at)
        degree = np.bincount(at.ravel(), minlength=len(self.table))
        which = np.zeros(len(self.table), dtype=np.int64)
        for k in range(3):
            np.bitwise_xor.at(which, at[:, k], np.arange(n))
        degree, which, rows = degree.tolist(), which.tolist(), at.tolist()
        ready = [p for p, d in enumerate(degree) if d == 1]
        out = []
        while ready:
            p = ready.pop()
            if degree[p] != 1:
                continue
            key = which[p]
            out.append((key, p))
            for q in rows[key]:
                degree[q] -= 1
                which[q] ^= key
                if degree[q] == 1:
                    ready.append(q)
        return out[::-1] if len(out) == n else None

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], dtype=np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, print_ = self._places(keys.astype(np.uint64))
        t = self.table
        return t[at[:, 0]] ^ t[at[:, 1]] ^ t[at[:, 2]] == print_

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], dtype="<i8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse:
        seed, segment, count = (int(x) for x in np.frombuffer(raw[:24], dtype="<i8"))
        return cls(seed, segment, count, np.frombuffer(raw[24:], dtype=np.uint8))


def build_filters(groups: DataFrame) -> DataFrame:
    """(shard, filter) from rows (shard, key): one immutable filter a shard."""

    def work(parts):
        for table, bound in parts:
            shard, key = table.column("shard").to_numpy(), table.column("key").to_numpy()
            filters = [BinaryFuse.build(key[lo:hi].view(np.uint64)).to_bytes() for lo, hi in zip(bound[:-1], bound[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[bound[:-1]]), pa.array(filters, pa.binary())], names=["shard", "filter"])

    return by_runs(groups.select("shard", "key"), ["shard"], ["key"], work, "shard int, filter binary")


def screen(filters: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows (shard, key) of ``incoming`` that their shard's filter lets through."""

    def work(parts):
        for table, bound in parts:
            key, filt = table.column("key").to_numpy(), table.column("filter").combine_chunks()
            shard = table.column("shard").to_numpy()
            keep = np.zeros(len(key), dtype=bool)
            for lo, hi in zip(bound[:-1], bound[1:]):
                if filt[int(lo)].is_valid:  # the filter is sorted before the keys
                    keep[lo + 1 : hi] = BinaryFuse.from_bytes(filt[int(lo)].as_py()).has(key[lo + 1 : hi].view(np.uint64))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(shard[keep]), pa.array(key[keep])], names=["shard", "key"])

    rows = filters.select("shard", F.lit(0).alias("late"), F.lit(0).cast("long").alias("key"), "filter")
    rows = rows.union(incoming.select("shard", F.lit(1).alias("late"), "key", F.lit(None).cast("binary").alias("filter")))
    return by_runs(rows, ["shard"], ["late", "key"], work, "shard int, key long")


def exact_dedup(snapshot: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of ``snapshot`` and ``batch``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes; null counts as empty.  Of equal texts the largest id
    stays.  Rows that repeat an id with one text count each in group_size, and all carry ``kept`` if
    theirs is the kept id.  A null id is smaller than any other: it is kept only if all ids of its
    group are null.  Empty tables give no rows; other columns are not read."""
    spark = snapshot.sparkSession
    prepare(spark)
    pick = lambda t, new: t.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), F.lit(new).alias("new"))
    whole = pick(snapshot, False).union(pick(batch, True))
    hexed = F.sha2(F.col("body").cast("binary"), 256)
    rows = whole.select("id", "new", F.unhex(hexed).alias("digest"), F.xxhash64(hexed).alias("key")).checkpoint()
    total = rows.count()
    shard = F.pmod(F.shiftright("key", 7), F.lit(max(1, -(-total // SHARD_KEYS)))).cast("int").alias("shard")

    groups = rows.groupBy("new", "key", "digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).select("*", shard).checkpoint()
    buckets, fresh = groups.where("NOT new"), groups.where("new")
    passed = screen(build_filters(buckets), fresh).select("key").distinct()
    met = fresh.join(passed, "key").join(buckets.select("digest", F.col("top").alias("old_top"), F.col("n").alias("old_n")), "digest")
    met = met.select("digest", F.greatest("top", "old_top").alias("keep"), (F.col("n") + F.col("old_n")).alias("size")).checkpoint()
    alone = groups.join(met.select("digest"), "digest", "left_anti").select("digest", F.col("top").alias("keep"), F.col("n").alias("size"))
    final = met.union(alone).checkpoint()

    _check_bytes(whole, hexed, final)
    out = rows.join(final, "digest")
    kept = F.col("id").eqNullSafe(F.col("keep"))
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store ``docs`` as an immutable snapshot in the folder ``path`` (which must be new): exact buckets
    (a row a text: shard, shards, key, digest, top id, n, body) and a binary-fuse filter a shard."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    hexed = F.sha2(F.col("body").cast("binary"), 256)
    groups = rows.groupBy(F.unhex(hexed).alias("digest"), F.xxhash64(hexed).alias("key")).agg(F.max("id").alias("top"), F.count("*").alias("n"), F.min("body").alias("body"), F.max("body").alias("other"))
    groups = groups.withColumn("body", F.when(F.col("body") == F.col("other"), F.col("body")).otherwise(F.raise_error("two different texts share a SHA-256 digest"))).drop("other")
    shards = max(1, -(-docs.count() // SHARD_KEYS))
    shard = F.pmod(F.shiftright("key", 7), F.lit(shards)).cast("int")
    groups.select(shard.alias("shard"), F.lit(shards).alias("shards"), "key", "digest", "top", "n", "body").write.parquet(f"{path}/buckets")
    build_filters(spark.read.parquet(f"{path}/buckets")).write.parquet(f"{path}/filters")


def dedup_batch(path: str, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of ``batch``: id, keep_id, group_size, kept, text_sha256, as exact_dedup over the
    stored snapshot and ``batch`` together would give for them; the snapshot is not changed."""
    spark = batch.sparkSession
    prepare(spark)
    buckets, filters = spark.read.parquet(f"{path}/buckets"), spark.read.parquet(f"{path}/filters")
    first = buckets.select("shards").first()
    whole = batch.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    hexed = F.sha2(F.col("body").cast("binary"), 256)
    rows = whole.select("id", F.unhex(hexed).alias("digest"), F.xxhash64(hexed).alias("key")).checkpoint()
    shard = F.pmod(F.shiftright("key", 7), F.lit(first.shards if first else 1)).cast("int")
    fresh = rows.groupBy("key", "digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).withColumn("shard", shard).checkpoint()
    passed = screen(filters, fresh).select("key").distinct()
    old = buckets.select(F.col("digest").alias("of"), F.col("top").alias("old_top"), F.col("n").alias("old_n"))
    met = fresh.join(passed, "key").join(old, F.col("digest") == F.col("of")).select("of", "old_top", "old_n").checkpoint()
    # positives meet the stored bodies, the others the first text of their group
    texts = whole.select("body", F.unhex(hexed).alias("digest"))
    known = buckets.join(met.select("of"), F.col("digest") == F.col("of"), "left_semi").select("digest", F.col("body").alias("first"))
    new = texts.join(fresh.where("n > 1").select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("body").alias("first"))
    if not texts.join(known.union(new), "digest").where("body <> first").isEmpty():
        raise ValueError("two different texts share a SHA-256 digest")
    final = fresh.join(met, F.col("digest") == F.col("of"), "left").select("digest", F.greatest("top", "old_top").alias("keep"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("size"))
    out = rows.join(final, "digest")
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _check_bytes(whole: DataFrame, hexed, final: DataFrame) -> None:
    """Compare the texts of each group with one of them; stop if a digest stands for two texts.

    Only texts of groups with several rows move.  The list of those groups is sent to the scan when
    it is small, and meets the texts in a shuffled join otherwise."""
    several = final.where("size > 1").select("digest", "keep").checkpoint()
    small = several.count() <= SEND_ROWS
    texts = whole.select("id", "body", F.unhex(hexed).alias("digest"))
    texts = texts.join(F.broadcast(several) if small else several, "digest")
    texts = texts.select("digest", "id", "keep", "body")
    # repeated rows of the kept id: any one of them is the group's first text
    first = texts.where("id <=> keep").groupBy("digest").agg(F.min("body").alias("first")).checkpoint()
    lost = texts.join(first, "digest").where("body <> first").limit(1).count()
    if lost:
        raise ValueError("two different texts share a SHA-256 digest")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the id range is the immutable snapshot, the newer half the incoming batch."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    middle = ((span.low or 0) + (span.high or 0)) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    return exact_dedup(docs.where(old), docs.where(~old))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
