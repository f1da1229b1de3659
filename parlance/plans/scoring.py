"""Verdicts on stated predictions about label conditions (lines 4, 5 and 10 to 17).

``cells`` has condition, regime, seed, replicate, f1 and share; ``reference`` has seed, gold_f1 and
gold_share.  Every verdict is an aggregation over the cells: first over the replicates of a seed, then
over the seeds, of which ``SEEDS_NEEDED`` must agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import metrics

SEEDS_NEEDED, POINT, RATIO, PAIR_DROP = 2, 0.03, 0.05, 0.10


def _wide(cells: DataFrame, value: str) -> DataFrame:
    """seed, replicate and a column ``condition__regime`` for each cell of an experiment."""
    names = [(r["condition"], r["regime"]) for r in cells.select("condition", "regime").distinct().orderBy("condition", "regime").collect()]  # a row a cell kind
    cols = [F.max(F.when((F.col("condition") == c) & (F.col("regime") == g), F.col(value))).alias(f"{c}__{g}") for c, g in names]
    return cells.groupBy("seed", "replicate").agg(*cols)


def _seeds(rows: DataFrame, each: Column, first_only: bool = False) -> DataFrame:
    """One row (ok): whether at least SEEDS_NEEDED seeds meet ``each`` in all replicates, or in replicate 0."""
    used = rows.where("replicate = 0") if first_only else rows
    by = used.groupBy("seed").agg(F.bool_and(F.coalesce(each, F.lit(False))).alias("ok"))
    return by.agg((F.count_if("ok") >= SEEDS_NEEDED).alias("ok"))


def _direction(rows: DataFrame, difference: Column) -> DataFrame:
    d = rows.select("seed", "replicate", difference.alias("d"))
    return metrics.direction(metrics.real_sign(d, ["seed"]), [], SEEDS_NEEDED)


def _line(line: int, observed: Column, holds: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(line).alias("line"), observed.cast("string").alias("observed"), holds.alias("holds"))


def _side_by_side(*parts: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    return reduce(lambda a, b: a.crossJoin(b), parts)


def pair_drop_verdict(drops: DataFrame) -> DataFrame:
    """Line 4: drops (track, seed, regime, drop): distillation's drop is smaller by more than PAIR_DROP on one seed at most, in each track."""
    d = metrics.paired_difference(drops, ["track", "seed"], "regime", "replay", "fkd", "drop")
    per = d.groupBy("track").agg(F.count_if(F.col("d") > PAIR_DROP).alias("n"))
    return _line(4, F.col("n"), F.col("n") <= 1, per.agg(F.max("n").alias("n")))


def gap_verdict(acc: DataFrame) -> DataFrame:
    """Line 5: acc (track, seed, fkd, replay): no real gap in either track; else the teacher's mean gap is smaller."""
    d = acc.withColumn("d", F.col("fkd") - F.col("replay"))
    up, down = F.count_if(F.col("d") > schema.REAL_DIFFERENCE), F.count_if(F.col("d") < -schema.REAL_DIFFERENCE)
    per = d.groupBy("track").agg((F.greatest(up, down) >= SEEDS_NEEDED).alias("real"), F.avg(F.abs("d")).alias("gap"))
    one = lambda t: F.max(F.when(F.col("track") == t, F.col("gap")))
    out = per.agg(F.bool_or("real").alias("real"), (one("teacher") < one("gold")).alias("smaller"))
    text = F.when(~F.col("real"), "no real gap").when(F.col("smaller"), "real gap, smaller in teacher").otherwise("real gap, not smaller in teacher")
    return out.select(F.lit(5).alias("line"), text.alias("observed"), (~F.col("real")).alias("holds"))


def condition_verdicts(cells: DataFrame, reference: DataFrame, expected: dict) -> DataFrame:
    """line, observed, holds of lines 10 to 17, given the predictions ``expected``."""
    f1, share = _wide(cells, "f1").join(F.broadcast(reference), "seed"), _wide(cells, "share").join(F.broadcast(reference), "seed")
    c = F.col
    near = lambda x, to, most: F.abs(x - F.lit(float(to))) <= most + 1e-12
    out = []

    a = _direction(f1, c("gold_I__joint") - c("gold_f1"))
    parts = [
        a.select((F.col("direction") != "none").alias("real"), "direction"),
        _seeds(f1, near(c("gold_I__joint") - c("gold_f1"), expected["line10_gold_I_minus_gold"], POINT), True).withColumnRenamed("ok", "p1"),
        _seeds(f1, near(c("gold_sub__joint") - c("gold_f1"), expected["line10_gold_sub_minus_gold"], POINT), True).withColumnRenamed("ok", "p2"),
        _seeds(f1, near(c("teacher_I__joint") / c("gold_I__joint"), expected["line10_ratio"], RATIO), True).withColumnRenamed("ok", "p3"),
    ]
    out.append(_line(10, c("direction"), (c("real") == F.lit(bool(expected["line10_gold_I_real"]))) & c("p1") & c("p2") & c("p3"), _side_by_side(*parts)))

    word = F.when(c("direction") == "real-negative", "lower").when(c("direction") == "real-positive", "higher").otherwise("same")
    for line, other in ((11, "rand_I"), (12, "perm_I")):
        out.append(_line(line, word, word == expected[f"line{line}"], _direction(f1, c("teacher_I__joint") - c(f"{other}__joint"))))

    gain = {k: _direction(f1, c(f"{k}__replay") - c(f"{k}__joint")).withColumnRenamed("direction", k) for k in ("teacher_I", "perm_I", "rand_I", "gold_I")}
    control = (lambda d: d == "none") if expected["line13_controls"] == "not_real" else (lambda d: d != "real-positive")
    clause = {"gold_I": control(c("gold_I")), "perm_I": c("perm_I") == "real-positive", "rand_I": control(c("rand_I")), "teacher_I": c("teacher_I") == "real-positive"}
    held = F.array_compact(F.array(*[F.when(v, k) for k, v in clause.items()]))
    hypothesis = F.when(F.size(held) == 4, "holds").when(F.size(held) == 0, "fails").otherwise(F.concat(F.lit("partly: "), F.array_join(held, ", ")))
    out.append(_line(13, hypothesis, hypothesis == expected["line13"], _side_by_side(*gain.values())))

    replay, balanced = c("teacher_I__replay") - c("teacher_I__joint"), c("teacher_I__joint_balanced") - c("teacher_I__joint")
    signs = metrics.real_sign(f1.select("seed", "replicate", replay.alias("d")), ["seed"])
    recovered = f1.groupBy("seed").agg(F.bool_and(F.round(F.try_divide(balanced, replay), 6) >= round(expected["line14_pct"] / 100, 6)).alias("ok"))
    by = signs.join(recovered, "seed").agg(F.count_if(c("sign") == 1).alias("gains"), F.count_if((c("sign") == 1) & c("ok")).alias("n"))
    out.append(_line(14, F.concat_ws(" of ", c("n").cast("string"), c("gains").cast("string")), (c("gains") >= SEEDS_NEEDED) & (c("n") >= SEEDS_NEEDED), by))

    cut = expected["line15_pp"] / 100
    checks = [_seeds(share, c(f"{k}__joint") > 2 * c("gold_share")) for k in ("teacher_I", "perm_I")] + [_seeds(share, c("rand_I__joint") <= 2 * c("gold_share"))]
    checks += [_seeds(share, c(f"{k}__joint") - c(f"{k}__replay") > cut) for k in ("teacher_I", "perm_I")]
    named = [t.withColumnRenamed("ok", f"k{i}") for i, t in enumerate(checks)]
    all_ = reduce(lambda x, y: x & y, [c(f"k{i}") for i in range(len(named))])
    met = F.concat_ws(",", *[F.when(c(f"k{i}"), "yes").otherwise("no") for i in range(len(named))])
    out.append(_line(15, met, all_, _side_by_side(*named)))

    ran = cells.agg((F.max("replicate") > 0).alias("ran"))
    out.append(_line(16, F.when(c("ran"), "replicates ran").otherwise("no replicates ran"), F.lit(True), ran))

    lost, fair = c("teacher_I__joint") - c("teacher_I__replay"), c("teacher_I__joint") - c("teacher_I__joint_balanced")
    rows = share.groupBy("seed").agg(F.bool_and(lost > schema.REAL_DIFFERENCE).alias("bar"), F.bool_and(F.round(F.try_divide(fair, lost), 6) >= round(expected["line17_pct"] / 100, 6)).alias("ok"))
    by = rows.agg(F.count_if("bar").alias("gains"), F.count_if(c("bar") & c("ok")).alias("n"))
    out.append(_line(17, F.concat_ws(" of ", c("n").cast("string"), c("gains").cast("string")), (c("gains") >= SEEDS_NEEDED) & (c("n") >= SEEDS_NEEDED), by))
    return reduce(DataFrame.union, out)


def with_expectations(verdicts: DataFrame, expected: dict) -> DataFrame:
    """Add expected (holds / fails) and expectation_correct for the lines that state one."""
    said = F.lit(None).cast("string")
    for line in (14, 15, 17):
        if f"line{line}_expect" in expected:
            said = F.when(F.col("line") == line, expected[f"line{line}_expect"]).otherwise(said)
    return verdicts.withColumn("expected", said).withColumn("expectation_correct", said == F.when(F.col("holds"), "holds").otherwise("fails"))


def framing(verdicts: DataFrame) -> DataFrame:
    """The branches of interpretation whose condition is met."""
    one = lambda line, col: F.max(F.when(F.col("line") == line, F.col(col)))
    row = verdicts.agg(one(13, "observed").alias("h13"), one(14, "holds").alias("b14"), one(12, "observed").alias("o12"))
    branches = F.array(
        F.when(F.col("h13") == "holds", "structured noise, countered by balanced replay"),
        F.when((F.col("h13") != "holds") & ~F.contains(F.col("h13"), F.lit("rand_I")), "replay is robust to label noise in general"),
        F.when(F.col("b14"), "the mechanism is class balancing"),
        F.when(F.col("o12") == "same", "the structure that matters is class-conditional").otherwise("instance dependence matters too"),
    )
    return row.select(F.explode(F.array_compact(branches)).alias("branch"))
