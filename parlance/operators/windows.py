"""Operators over ordered rows: count windows, turns, sessions, early stopping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def sliding_windows(utterances: DataFrame, size: int = schema.WINDOW, overlap: int = schema.OVERLAP) -> DataFrame:
    """Overlapping windows of ``size`` utterances: meeting_id, window_id, utterances.

    A window starts every max(1, size - overlap) utterances until one reaches the end.  Each utterance
    names its windows, so one shuffle by meeting and window suffices; there is no join."""
    step = max(1, size - overlap)
    n = F.count("*").over(Window.partitionBy("meeting_id"))
    last = F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step)
    first = F.greatest(F.ceil((F.col("seq") - size + 1) / step), F.lit(0))
    ids = F.sequence(first.cast("int"), F.least(F.floor(F.col("seq") / step), last).cast("int"))
    ids = F.when(first <= F.least(F.floor(F.col("seq") / step), last), ids)
    row = F.struct("seq", "speaker_id", "text", "start_time", "end_time")
    out = utterances.withColumn("n", n).select("meeting_id", F.explode(ids).alias("window_id"), row.alias("u"))
    return out.groupBy("meeting_id", "window_id").agg(F.array_sort(F.collect_list("u")).alias("utterances"))


def synthetic_clock(turns: DataFrame, key: str, order: str, seconds: float = schema.SECONDS_PER_TURN) -> DataFrame:
    """Add start_time and end_time: turn i lasts from seconds*i to seconds*(i+1)."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return turns.withColumn("start_time", i * F.lit(seconds)).withColumn("end_time", (i + 1) * F.lit(seconds))


def merge_turns(lines: DataFrame, key: str, order: str, text: str, starts: Column) -> DataFrame:
    """Lines that don't start a turn join the one before: key, turn_no, n_lines, text.  Leading ones go."""
    marked = lines.withColumn("turn_no", F.sum(starts.cast("int")).over(Window.partitionBy(key).orderBy(order)))
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    out = marked.where("turn_no > 0").groupBy(key, "turn_no").agg(rows.alias("rows"))
    return out.select(key, "turn_no", F.size("rows").alias("n_lines"), F.array_join(F.transform("rows", lambda r: r[text]), " ").alias("text"))


def turns_of(lines: Column, starts: Callable[[Column], Column]) -> Column:
    """An array of (turn_no, n_lines, text) of an array of lines, as ``merge_turns`` makes of rows: no shuffle, as a text's lines are in its row.

    ``starts`` tells whether a line begins a turn; lines before the first turn go."""
    first = F.array_compact(F.transform(lines, lambda x, i: F.when(starts(x), i + 1)))
    following = lambda k: F.coalesce(F.try_element_at(first, k + 2), F.size(lines) + 1)
    return F.transform(first, lambda at, k: F.struct((k + 1).cast("long").alias("turn_no"), (following(k) - at).alias("n_lines"), F.array_join(F.slice(lines, at, following(k) - at), " ").alias("text")))


def gap_sessions(rows: DataFrame, key: list[str], start: str, end: str, gap: float, tie: str) -> DataFrame:
    """Add session_no: a new session wherever start - previous end exceeds ``gap``."""
    w = Window.partitionBy(*key).orderBy(start, tie)
    new = F.coalesce((F.col(start) - F.lag(end).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def early_stop(log: DataFrame, run: list[str], epoch: str, score: str, patience: int = 5) -> DataFrame:
    """Per run: best_epoch (first strict maximum up to the stop), best_score, stop_epoch."""
    w = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(score).over(w)
    up = log.withColumn("better", before.isNull() | (F.col(score) > before))
    to_here = Window.partitionBy(*run).orderBy(epoch)
    up = up.withColumn("rn", F.row_number().over(to_here))
    up = up.withColumn("last_rn", F.max(F.when(F.col("better"), F.col("rn"))).over(to_here))
    stopped = up.where(F.col("rn") - F.col("last_rn") >= patience).groupBy(*run).agg(F.min("rn").alias("stop_rn"))
    seen = up.join(stopped, run, "left").where("stop_rn IS NULL OR rn <= stop_rn")
    best = F.max(F.when(F.col("better"), F.struct(F.col("rn"), F.col(epoch), F.col(score))))
    out = seen.groupBy(*run).agg(best.alias("b"), F.max(epoch).alias("stop_epoch"))
    return out.select(*run, F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{score}").alias("best_score"), "stop_epoch")
