"""Prefix trie of conversations, rolled up by pointer jumping.

A turn is a digest of its role and text; a prefix of d turns is the pair of sums, over its positions, of
two 62-bit hashes of (position, turn digest).  Sums can be carried over the parts of a range-sorted table,
so the prefixes of one endless conversation are made by many tasks.  Equal prefixes are one node, and each
row brings its node's and its parent's digest, which are the edges.

Subtree totals take logarithmic rounds: after round k a node knows its 2^k-th ancestor and the totals of
its descendants nearer than 2^k; the ancestor receives what the node holds, and the node takes over the
ancestor's pointer.  Nodes that have neither a pointer nor anything to receive are done and leave the
rounds, so short conversations cost a few rounds however deep the deepest is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, prepare, read_table, stored

#: Bits of a prefix sum, and characters of ids that are hashed at a time.
LANE, BLOCK = 62, 1 << 16
_MASK = (1 << LANE) - 1


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where the rows of a key begin in a batch of sorted rows."""
    change = np.ones(len(keys[0]), dtype=bool)
    change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within this task's range."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv").to_numpy()
        starts = _starts(conv)
        sizes = np.diff(np.append(starts, len(conv)))
        rank = np.arange(len(conv)) - np.repeat(starts, sizes)
        if conv[0] == last:
            rank[: sizes[0]] += seen
        last, seen = conv[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(np.full(len(conv), part)), pa.array(rank), b.column("digest"), b.column("bytes")], names=["conv", "part", "rank", "digest", "bytes"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of a conversation's lanes within this task's range, without and with the row itself."""
    part, last, carry = TaskContext.get().partitionId(), None, {"a": 0, "b": 0}
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        starts = _starts(conv)
        sizes = np.diff(np.append(starts, len(conv)))
        out = {}
        for lane in ("a", "b"):
            own = batch.column(lane).to_numpy().astype(np.uint64)
            run = np.cumsum(own, dtype=np.uint64)  # wraps at 2^64, a multiple of 2^LANE
            base = np.repeat(run[starts] - own[starts], sizes)
            run = run - base
            if conv[0] == last:
                run[: sizes[0]] += np.uint64(carry[lane])
            out[lane], out[f"p{lane}"] = run & np.uint64(_MASK), (run - own) & np.uint64(_MASK)
            carry[lane] = int(out[lane][-1])
        last = conv[-1]
        lanes = [pa.array(out[n].astype(np.int64)) for n in ("pa", "pb", "a", "b")]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("pos"), batch.column("bytes"), batch.column("last"), pa.array(np.full(len(conv), part)), *lanes], names=["conv", "pos", "bytes", "last", "part", "pa", "pb", "a", "b"])


def order_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, rank, digest, bytes) a row: its place in its conversation, by turn, null first, from 0.

    Null roles and texts are empty.  Turns of one number go by the SHA-256 of role and text, so repeated
    rows follow each other.  Rows without a conversation id belong to none and are left out.  The rows
    are dealt by ranges of (conversation, turn, digest), so a conversation may spread over many tasks;
    a task's first conversation then goes on where the tasks before it ended (a row a task at most)."""
    prepare(rows.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    turns = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranked = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "bytes")
    ranked = stored(map_arrow(ranked, _ranks, "conv long, part long, rank long, digest binary, bytes long"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.groupBy("conv", "part").agg(F.count("*").alias("n")).select(F.col("conv").alias("of"), F.col("part").alias("at"), F.sum("n").over(earlier).alias("before")).where("before > 0")
    out = ranked.join(F.broadcast(before), (F.col("conv") == F.col("of")) & (F.col("part") == F.col("at")), "left")  # a row a task at most
    return out.select("conv", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "digest", "bytes")


def lengths(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv, n): the turns of each conversation."""
    return rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv")).agg(F.count("*").alias("n"))


def rebuild(turns: DataFrame, sizes: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Give every conversation the opening of its family's first one: (turns, conversations) anew.

    Conversation c takes the first h turns (h: CRC-32 of the decimal id modulo ``heads``) of conversation
    c - c % family, all if there are fewer and none if it is absent, then its own turns after its first h.
    turns: conv, pos, digest, bytes, last; conversations: conv, length."""
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = sizes.withColumns({"base": F.col("conv") - F.pmod("conv", F.lit(family)), "head": head})
    bases = sizes.select(F.col("conv").alias("of"), F.col("n").alias("base_n"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, F.col("base") == F.col("of"), "left").select("conv", "base", "head", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("length"))
    convs = stored(convs)
    opening = turns.where((F.pmod("conv", F.lit(family)) == 0) & (F.col("rank") < heads - 1)).withColumnRenamed("conv", "of")
    opening = opening.join(convs.where("taken > 0"), (F.col("of") == F.col("base")) & (F.col("rank") < F.col("head"))).select("conv", F.col("rank").alias("pos"), "digest", "bytes", "length")
    # a conversation of very many turns: Spark splits its rows, and repeats the one row of ``convs``
    own = turns.join(convs, "conv").where("rank >= head").select("conv", (F.col("rank") - F.col("head") + F.col("taken")).alias("pos"), "digest", "bytes", "length")
    rows = opening.union(own).withColumn("last", F.col("pos") + 1 == F.col("length")).drop("length")
    return rows, convs.select("conv", "length")


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, bytes, last, a, b, pa, pb): the digests of a row's prefix and of the prefix before it."""
    mask = F.lit(_MASK)
    lane = lambda k: F.xxhash64("pos", "digest", F.lit(k)).bitwiseAND(mask)
    dealt = rows.repartitionByRange("conv", "pos").sortWithinPartitions("conv", "pos").select("conv", "pos", "bytes", "last", lane(1).alias("a"), lane(2).alias("b"))
    runs = stored(map_arrow(dealt, _sums, "conv long, pos long, bytes long, last boolean, part long, pa long, pb long, a long, b long"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = runs.groupBy("conv", "part").agg(F.max_by(F.struct("a", "b"), "pos").alias("end"))
    ends = ends.select(F.col("conv").alias("of"), F.col("part").alias("at"), *(F.sum(F.col(f"end.{c}").cast("decimal(38,0)")).over(earlier).alias(f"sum_{c}") for c in "ab")).where("sum_a IS NOT NULL")
    ends = ends.select("of", "at", *((F.col(f"sum_{c}") % F.lit(1 << LANE).cast("decimal(38,0)")).cast("long").alias(f"before_{c}") for c in "ab"))
    out = runs.join(F.broadcast(ends), (F.col("conv") == F.col("of")) & (F.col("part") == F.col("at")), "left")  # a row a task at most
    shifted = lambda c: (F.col(c) + F.coalesce(f"before_{c[-1]}", F.lit(0))).bitwiseAND(mask).alias(c)
    return out.select("conv", (F.col("pos") + 1).alias("depth"), "bytes", "last", shifted("a"), shifted("b"), shifted("pa"), shifted("pb"))


def _digest_ids(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): the ids of each node in ascending order, joined by commas and hashed.

    Ranges of ids are joined into blocks by many tasks; a node's blocks stream through one hash."""

    def blocks(batches):
        part, last, held, size, seq = TaskContext.get().partitionId(), None, [], 0, 0
        out: list[tuple] = []

        def flush():
            nonlocal held, size, seq
            if held:
                out.append((*last, part, seq, ",".join(held)))
                held, size, seq = [], 0, seq + 1

        def batch():
            cols = [pa.array(c, pa.string() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["depth", "a", "b", "part", "seq", "text"])

        for b in batches:
            for *key, conv in zip(*(b.column(k).to_pylist() for k in range(4))):
                if key != last or size > BLOCK:
                    flush()
                    last = key
                text = str(conv)
                held.append(text)
                size += len(text) + 1
            if len(out) >= 1000:
                yield batch()
        flush()
        if out:
            yield batch()

    def digests(batches):
        last, sha, out = None, None, []

        def batch():
            cols = [pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(zip(*out))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["depth", "a", "b", "ends_sha256"])

        for b in batches:
            for *key, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if key == last:
                    sha.update(b"," + text.encode())
                    continue
                if sha is not None:
                    out.append((*last, sha.hexdigest()))
                last, sha = key, hashlib.sha256(text.encode())
            if len(out) >= 1000:
                yield batch()
        if sha is not None:
            out.append((*last, sha.hexdigest()))
            yield batch()

    key = ["depth", "a", "b"]
    dealt = ends.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    dealt = map_arrow(dealt, blocks, "depth long, a long, b long, part long, seq long, text string")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "part", "seq").select(*key, "text")
    return map_arrow(dealt, digests, "depth long, a long, b long, ends_sha256 string")


def _roll_up(nodes: DataFrame) -> DataFrame:
    """(conv, depth, n_leaves, saved_tokens) from (conv, depth, up, leaves, saved): totals of each subtree.

    A node is (its smallest member, depth); up: the parent's smallest member, null for the tops."""
    state, step, done = stored(nodes.select("conv", "depth", "up", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(False).alias("over"))), 1, []
    while not state.where("NOT over AND up IS NOT NULL").isEmpty():
        done.append(state.where("over"))
        alive = state.where("NOT over")
        given = alive.where("up IS NOT NULL").groupBy(F.col("up").alias("to"), (F.col("depth") - step).alias("to_depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        jumps = alive.where("up IS NOT NULL").select(F.col("conv").alias("by"), F.col("depth").alias("by_depth"), F.col("up").alias("next"))
        met = alive.join(given, (F.col("conv") == F.col("to")) & (F.col("depth") == F.col("to_depth")), "left")
        met = met.join(jumps, (F.col("up") == F.col("by")) & (F.col("depth") - step == F.col("by_depth")), "left")
        state = stored(met.select(
            "conv", "depth", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            F.expr("next IS NULL AND more_leaves IS NULL").alias("over"),
        ))
        step *= 2
    return reduce(DataFrame.union, [*done, state]).select("conv", "depth", "n_leaves", "saved_tokens")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows``: (conv, pos, digest, bytes, last), a row a turn, positions from 0 without gaps; ``convs``: (conv,
    length), a row a conversation, those without turns too, which end at the root.  No conversation: no
    node.  The root is kept out of the rounds: its totals are those of the table."""
    key = ["depth", "a", "b"]
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "bytes")]
    root = convs.select("conv", *zero, (F.col("length") == 0).alias("last"), *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "pa", "pb")))
    members = _prefixes(rows).select("conv", "depth", "bytes", "last", "a", "b", "pa", "pb").union(root)
    nodes = stored(members.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb")))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    ups = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("up"))
    top = nodes.where("depth = 0").select(F.col("conv").alias("top"))  # one row
    tree = nodes.join(kids, key, "left").join(_digest_ids(members.where("last")), key, "left")
    tree = tree.where("depth > 1").join(ups, ["depth", "pa", "pb"], "left").select(*tree.columns, "up").union(tree.where("depth <= 1").crossJoin(F.broadcast(top)).select(*tree.columns, F.when(F.col("depth") == 1, F.col("top")).alias("up")))
    tree = stored(tree.select("conv", "depth", "up", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.expr("CASE WHEN n_children IS NULL THEN 1L ELSE 0L END").alias("leaves")))
    below = _roll_up(tree.where("depth > 0").withColumn("up", F.expr("CASE WHEN depth > 1 THEN up END")))
    whole = tree.groupBy().agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    fixed = [F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children"]
    totals = ["n_leaves", "saved_tokens", "ends_sha256"]
    inner = tree.where("depth > 0").join(below, ["conv", "depth"]).select(*fixed, *totals)
    return inner.union(tree.where("depth = 0").crossJoin(F.broadcast(whole)).select(*fixed, *totals))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations as they are: a table of conv_id, turn, role, text."""
    sizes = lengths(rows)
    turns = order_turns(rows).join(sizes, "conv").select("conv", F.col("rank").alias("pos"), "digest", "bytes", (F.col("rank") + 1 == F.col("n")).alias("last"))
    return prefix_trie(turns, sizes.select("conv", F.col("n").alias("length")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return prefix_trie(*rebuild(order_turns(rows), lengths(rows)))
