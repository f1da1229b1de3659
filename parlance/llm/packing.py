"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of documents, and a deficit round-robin deals them out: the queue furthest
behind its share has the next turn.  A queue's share grows with the tokens dealt, so document d of a
queue, after ``start`` tokens of that queue, falls due at virtual time (start + n/2) / rate: when half of
it is owed.  Ordering by due times is the round-robin, and it needs no walk: dues follow from sums a
source and task, places from sums a slice of due time, so deficits carry over windows, partitions and
machines alike.

Two turns are offered.  *Quanta* (``whole=False``, what the query takes): a source's quantum of a window is
its share of the window's tokens; what rounding leaves it short of is its deficit, which the next windows
make up for, so every window holds the target proportions to a token or so, and a document is cut into a piece
a window.  *Whole documents* (``whole=True``): a turn gives one whole document, windows cut the stream where
they end, and each source is ahead of or behind its share by about a document at most, in every prefix of
the stream; fewer pieces, but only many windows together hold the proportions.  Rates default to the sources' own totals, so that all queues run dry together; with other rates
a queue that has run dry leaves its share to the rest.
"""

from __future__ import annotations

import json
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, prepare, read_table, stored

WINDOW = 2048
VOCABULARY, END_ID = "byte_bpe_50k", 1
#: Longest list of task totals that is sent to every task; a longer one is joined in a shuffle.
SEND_ROWS = 300_000
#: Tokens of a slice of due time, and most slices (a row each is sent to every task).
SLICE, SLICES = 1 << 18, 1 << 18


class Encoder:
    """The ids that the vocabulary's JSON tokenizer gives, by the faster rank encoder of the same vocabulary.

    Texts that hold a special token's string go to the JSON tokenizer itself."""

    def __init__(self, name: str = VOCABULARY, folder: str | None = None):
        import base64

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        place = (lambda f: f"{folder}/{f}") if folder else P.path
        with open(place(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._load = lambda: Tokenizer.from_file(place(f"{name}.json"))
        self.special = self._specials(place(f"{name}.json"))

    @staticmethod
    @lru_cache
    def _specials(path: str) -> tuple[str, ...]:
        with open(path, encoding="utf-8") as f:
            return tuple(t["content"] for t in json.load(f)["added_tokens"])

    @cached_property
    def exact(self):
        """The JSON tokenizer; it is loaded when a text needs it."""
        return self._load()

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict = {}


def _encoder(name: str, folder: str | None) -> Encoder:
    if (name, folder) not in _encoders:
        _encoders[name, folder] = Encoder(name, folder)
    return _encoders[name, folder]


class Schedule:
    """Which tokens of each queue the windows take."""

    def __init__(self, totals: list[int], rates: list[float] | None = None, window: int = WINDOW):
        self.total = np.array(totals, dtype=np.int64)
        self.rate = np.array(rates if rates is not None else totals, dtype=np.float64)
        self.rate = np.where(self.total > 0, np.maximum(self.rate, 1e-12), 1.0)
        self.window, self.all = window, int(self.total.sum())
        self.windows = -(-self.all // window)
        dry = self.total / self.rate
        self.knots = np.unique(np.concatenate(([0.0], dry)))
        self.filled = np.minimum(self.knots[:, None] * self.rate, self.total).sum(1)

    def _time(self, tokens: np.ndarray) -> np.ndarray:
        return np.interp(tokens, self.filled, self.knots)

    def around(self, source: int, position: int) -> int:
        """About the window of a queue's token."""
        t = (position + 0.5) / self.rate[source]
        return int(np.interp(t, self.knots, self.filled)) // self.window

    def _counts(self, t: np.ndarray) -> np.ndarray:
        """Tokens of each queue whose virtual time is below t."""
        c = np.minimum(np.floor(t[:, None] * self.rate + 0.5).astype(np.int64), self.total)
        c -= (c > 0) & ((c - 0.5) / self.rate >= t[:, None])
        return c + ((c < self.total) & ((c + 0.5) / self.rate < t[:, None]))

    def taken(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue that stand before each of the windows."""
        goal = np.clip(windows.astype(np.int64) * self.window, 0, self.all)
        k = len(self.total)
        low, high = self._time(goal - k - 1.0), self._time(goal + k + 1.0) + 1e-9
        have = self._counts(low)
        while (over := have.sum(1) > goal).any():  # rounding at the very start
            low = np.where(over, low / 2 - 1e-9, low)
            have = self._counts(low)
        for _ in range(40):
            if (have.sum(1) == goal).all():
                break
            middle = (low + high) / 2
            c = self._counts(middle)
            fits = c.sum(1) <= goal
            low, high = np.where(fits, middle, low), np.where(fits, high, middle)
            have = np.where(fits[:, None], c, have)
        while (short := np.flatnonzero(have.sum(1) < goal)).size:  # ties: the first source goes first
            due = np.where(have[short] < self.total, (have[short] + 0.5) / self.rate, np.inf)
            have[short, due.argmin(1)] += 1
        return have

    def pieces(self, source: int, start: int, length: int, known: dict[int, np.ndarray]):
        """(from, to, window, offset) of tokens [start, start + length) of a queue."""
        w, at, end = self._first(source, start, known), start, start + length
        while at < end:
            before, after = known[w], known[w + 1]
            if after[source] > at:
                stop = min(end, int(after[source]))
                yield at - start, stop - start, w, int((after[:source] - before[:source]).sum()) + at - int(before[source])
                at = stop
            w += 1
            if w + 1 not in known:
                self.fill(known, w + 1, w + 64)

    def _first(self, source: int, start: int, known) -> int:
        w = max(0, min(self.around(source, start), self.windows - 1))
        self.fill(known, w - 1, w + 2)
        while w > 0 and known[w][source] > start:
            w -= 1
            self.fill(known, w - 1, w + 1)
        return w

    def fill(self, known: dict[int, np.ndarray], first: int, last: int) -> None:
        missing = [w for w in range(max(0, first), last + 1) if w not in known]
        if missing:
            known.update(zip(missing, self.taken(np.array(missing))))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY, folder: str | None = None, window: int = WINDOW, rates: dict | None = None, whole: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id, so a null or empty text is one token.  Every id lies in
    exactly one piece; all windows are full but the last.  ``whole``: turns give whole documents, cut only
    at window ends, so there are fewer pieces than documents and windows together; else each window holds
    the target proportions.  Equal due times go by source, then by place in the queue.  A null source is a
    queue of its own, after the others.  ``rates`` maps sources to relative shares (missing: 1); None: the corpus mixture.
    Rows that repeat an id are packed one by one; null ids stay null.  Other columns are not read.

    Texts are encoded once.  The encoded table keeps, for each row, its task and the tokens of its
    source before it in that task; only task totals have to be summed up to place every row."""
    spark = docs.sparkSession
    prepare(spark)

    def encode(batches):
        encoder, part, before = _encoder(vocabulary, folder), TaskContext.get().partitionId(), {}
        for b in batches:
            names = b.column(2).to_pylist()
            ids = [np.array([*encoder.ids(t or ""), END_ID], dtype="<u4") for t in b.column(1).to_pylist()]
            wide = any(len(x) and x.max() >= 1 << 16 for x in ids)
            starts = []
            for s, x in zip(names, ids):
                starts.append(before.get(s, 0))
                before[s] = starts[-1] + len(x)
            kind = "<u4" if wide else "<u2"
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["id", "source", "part", "before", "n", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    rows = stored(map_arrow(src, encode, "id long, source string, part int, before long, n long, ids binary"))
    parts = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens")).checkpoint()
    order = [F.col("source").asc_nulls_last()]
    totals = parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(*order).collect()  # a row a source
    names = [r["source"] for r in totals]
    schedule = Schedule([int(r["tokens"]) for r in totals], [float((rates or {}).get(n, 1)) for n in names] if rates else None, window)
    where = {n: k for k, n in enumerate(names)}
    # a row a source and task: tokens of the source in earlier tasks.  The list grows with the tasks, so
    # it is sent to all of them only while it is short
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    if whole:
        return _deal_whole(rows, base, schedule, names, window, parts.count() <= SEND_ROWS).withColumnRenamed("id", id_col)
    on = rows.source.eqNullSafe(F.col("of")) & (rows.part == F.col("at"))
    rows = rows.join(F.broadcast(base) if parts.count() <= SEND_ROWS else base, on).select("id", "source", (F.col("base") + F.col("before")).alias("start"), "n", "ids")

    def place(batches):
        known: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            cols = (b.column(k).to_pylist() for k in range(5))
            for doc, source, start, n, raw in zip(*cols):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for lo, hi, w, offset in schedule.pieces(where[source], start, n, known):
                    out.append((doc, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, w, offset))
            if len(known) > 20_000:
                known.clear()
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = map_arrow(rows, place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def _deal_whole(rows: DataFrame, base: DataFrame, schedule: Schedule, names: list, window: int, small: bool) -> DataFrame:
    """Place whole documents in the order of their due times."""
    spark = rows.sparkSession
    ranks = spark.createDataFrame([(n, k, float(schedule.rate[k])) for k, n in enumerate(names)], "of_source string, rank int, rate double")  # a row a source
    base = base.join(F.broadcast(ranks), F.col("of").eqNullSafe(F.col("of_source"))).drop("of_source")
    on = rows.source.eqNullSafe(F.col("of")) & (rows.part == F.col("at"))
    rows = rows.join(F.broadcast(base) if small else base, on)
    rows = rows.withColumn("due", (F.col("base") + F.col("before") + F.col("n") / 2) / F.col("rate"))
    # about the tokens that are dealt before a due time: linear between the times when queues run dry
    tokens = F.lit(float(schedule.filled[-1]))
    for k in range(len(schedule.knots) - 1, 0, -1):
        low, high = float(schedule.knots[k - 1]), float(schedule.knots[k])
        steep = float(schedule.filled[k] - schedule.filled[k - 1]) / (high - low)
        tokens = F.when(F.col("due") <= high, float(schedule.filled[k - 1]) + (F.col("due") - low) * steep).otherwise(tokens)
    slices = max(1, min(SLICES, schedule.all // SLICE))
    rows = rows.withColumn("slice", F.least(F.lit(slices - 1), F.floor(tokens / max(1, schedule.all) * slices)).cast("int"))
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("slice").agg(F.sum("n").alias("tokens")).select(F.col("slice").alias("of_slice"), F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("ahead"))  # SLICES rows at most
    rows = rows.join(F.broadcast(sums), F.col("slice") == F.col("of_slice")).select("id", "n", "ids", "slice", "ahead", "due", "rank", (F.col("base") + F.col("before")).alias("start"))

    def place(batches):
        now, at = None, 0
        for b in batches:
            out = []
            for doc, n, raw, slice_, ahead in zip(*(b.column(k).to_pylist() for k in range(5))):
                if slice_ != now:
                    now, at = slice_, ahead
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                lo = 0
                while lo < n:
                    hi = min(n, lo + window - at % window)
                    out.append((doc, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, at // window, at % window))
                    at, lo = at + hi - lo, hi
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = rows.repartition("slice").sortWithinPartitions("slice", "due", "rank", "start")
    return map_arrow(rows, place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window to the corpus' own proportions."""
    return pack(read_table(spark, sf_dir, "documents"))
