"""Report tables over runs: pivots of metrics by seed, verdicts on stated predictions, Markdown and CSV."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import metrics


def by_seed(values: DataFrame, rows: list[str], measures: list[str], seeds: Iterable[int] = schema.TRAINING["seeds"], seed: str = "seed") -> DataFrame:
    """One row for ``rows``, a column ``measure_seed`` for each pair; conditional aggregation, one shuffle."""
    cells = [F.max(F.when(F.col(seed) == s, F.col(m))).alias(f"{m}_{s}") for m in measures for s in seeds]
    return values.groupBy(*rows).agg(*cells)


def main_table(r: DataFrame) -> DataFrame:
    """ACC, BWT and forgetting of the first two tasks, by track and regime."""
    keys = ["track", "regime", "seed"]
    f = metrics.forgetting(r, keys)
    lost = f.groupBy(*keys).agg(*[F.max(F.when(F.col("j") == j, F.col("forgetting"))).alias(f"forget_t{j}") for j in (0, 1)])
    values = metrics.acc(r, keys).join(metrics.bwt(r, keys), keys).join(lost, keys, "left")
    return by_seed(values, ["track", "regime"], ["acc", "bwt", "forget_t0", "forget_t1"])


def observed_table(values: DataFrame) -> DataFrame:
    """Observed accuracy after each stage and its mean, by track and regime."""
    mean = values.groupBy("track", "regime", "seed").agg(F.avg("accuracy").alias("accuracy")).withColumn("stage", F.lit(-1))
    rows = values.select("track", "regime", "seed", "accuracy", "stage").unionByName(mean)
    return by_seed(rows.withColumn("column", F.when(F.col("stage") < 0, "mean").otherwise(F.concat(F.lit("after_t"), F.col("stage").cast("string")))), ["track", "regime", "column"], ["accuracy"])


def final_f1_table(values: DataFrame, joint: DataFrame) -> DataFrame:
    """Final macro-F1 by regime, and the joint upper bound as a regime of its own."""
    rows = values.select("track", "regime", "seed", "macro_f1").unionByName(joint.select("track", F.lit("joint (upper bound)").alias("regime"), "seed", "macro_f1"))
    return by_seed(rows, ["track", "regime"], ["macro_f1"])


def fixed_schedule_table(r: DataFrame, degenerate: DataFrame) -> DataFrame:
    """ACC, and forgetting of the tasks that are not degenerate as one string ``t0 -0.063, t1 +0.041``."""
    keys = ["track", "seed", "regime"]
    f = metrics.forgetting(r, keys).join(degenerate.select("track", "seed", F.col("task").alias("j")), ["track", "seed", "j"], "left_anti")
    cell = F.struct("j", F.format_string("t%d %+.3f", F.col("j"), F.col("forgetting")).alias("s"))
    lost = f.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["s"]), ", ").alias("forgetting"), F.avg("forgetting").alias("mean_forgetting"))
    return metrics.acc(r, keys).join(lost, keys, "left")


def continual_table(values: DataFrame) -> DataFrame:
    """ACC, forgetting of the old tasks that are not degenerate, and the final score of the continual runs, by condition and regime."""
    return by_seed(values, ["condition", "regime"], ["acc", "forgetting", "final"], [1, 2])


def spread_cell(values: DataFrame, by: list[str], v: str) -> DataFrame:
    """``r0 [low, high]`` of the replicates of a cell, and low-high (spread)."""
    out = values.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col(v))).alias("r0"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))
    shown = F.when(F.col("n") == 1, F.format_string("%.3f", F.col("r0"))).otherwise(F.format_string("%.3f [%.3f, %.3f]", F.col("r0"), F.col("low"), F.col("high")))
    return out.withColumn("cell", shown).withColumn("resolution", F.format_string("%.3f–%.3f (%.3f)", F.col("low"), F.col("high"), F.col("high") - F.col("low")))


def key_comparison(values: DataFrame, a: str, b: str, v: str = "acc") -> DataFrame:
    """Per condition and seed the replicate-paired difference and its sign; per condition its direction."""
    d = metrics.paired_difference(values, ["condition", "seed", "replicate"], "regime", a, b, v)
    signs = metrics.real_sign(d, ["condition", "seed"]).join(d.where("replicate = 0").select("condition", "seed", F.col("d").alias("delta")), ["condition", "seed"], "left")
    return signs.join(metrics.direction(signs, ["condition"]), "condition")


def joint_report(train: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """The joint bound of each track: *by, train_rows, test_rows, accuracy, majority_accuracy, macro_f1, per_class.

    ``train``: *by, label; ``pred``: *by, gold, pred of the test rows.  majority_accuracy: the share of the most frequent
    gold class of the test rows; per_class: ``label f1`` to four places, by label."""
    n = train.groupBy(*by).agg(F.count("*").alias("train_rows"))
    most = pred.groupBy(*by, "gold").agg(F.count("*").alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))
    cell = F.struct("label", F.format_string("%s %.4f", F.col("label").cast("string"), F.col("f1")).alias("s"))
    f1 = metrics.class_f1(pred, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["s"]), ", ").alias("per_class"))
    out = metrics.accuracy(pred, by).withColumnRenamed("n", "test_rows").join(most, by).join(f1, by).join(n, by, "left")
    return out.select(*by, F.coalesce("train_rows", F.lit(0)).alias("train_rows"), "test_rows", "accuracy", "majority_accuracy", "macro_f1", "per_class")


#: The differences of the key comparison: name, regime, measure.  Each is the regime minus joint.
KEY_DELTAS = [("replay", "replay", "f1"), ("bal", "joint_balanced", "f1"), ("share_replay", "replay", "share"), ("share_bal", "joint_balanced", "share")]


def key_table(values: DataFrame, needed: int = 2, least: float = schema.REAL_DIFFERENCE) -> DataFrame:
    """The key comparison, all four differences at once: a row a condition and seed, and a summary row (seed null) a condition.

    ``values``: condition, regime, seed, replicate, f1, share.  Differences pair the runs of a replicate.  Of
    each: ``delta_*`` of replicate 0, ``low_*`` and ``high_*`` over the replicates, ``sign_*`` (+1 or -1 if replicate 0
    exceeds ``least`` and all replicates share one strict sign), and in the summary row ``rule_*``: the direction
    in which ``needed`` seeds are real, ``none``, or null where the regime did not run.  Wide conditional sums
    make all pairs in one shuffle, grouping sets both levels in another."""
    one = lambda g, m: F.max(F.when(F.col("regime") == g, F.col(m)))
    pairs = values.groupBy("condition", "seed", "replicate").agg(*[(one(g, m) - one("joint", m)).alias(n) for n, g, m in KEY_DELTAS])
    first = lambda n: F.max(F.when(F.col("replicate") == 0, F.col(n)))
    sign = lambda n: F.when(F.abs(first(n)) <= least, 0).when(F.min(n) > 0, 1).when(F.max(n) < 0, -1).otherwise(0)
    cells = pairs.groupBy("condition", "seed").agg(*[c for n, _, _ in KEY_DELTAS for c in (first(n).alias(f"delta_{n}"), F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"), F.when(F.count(n) > 0, F.coalesce(sign(n), F.lit(0))).alias(f"sign_{n}"))])
    whole = F.grouping("seed") == 1
    rule = lambda n: F.when(F.count(f"sign_{n}") == 0, None).when(F.count_if(F.col(f"sign_{n}") == 1) >= needed, "real-positive").when(F.count_if(F.col(f"sign_{n}") == -1) >= needed, "real-negative").otherwise("none")
    out = [F.when(~whole, F.max(f"{k}_{n}")).alias(f"{k}_{n}") for n, _, _ in KEY_DELTAS for k in ("delta", "low", "high", "sign")]
    return cells.groupingSets([["condition", "seed"], ["condition"]], "condition", "seed").agg(*out, *[F.when(whole, rule(n)).alias(f"rule_{n}") for n, _, _ in KEY_DELTAS])


def task_rows(rows: DataFrame, tasks: DataFrame, by: list[str], least: int = schema.MIN_EXAMPLES) -> DataFrame:
    """Rows of a condition by task: *by, rows, per_task, task_share, min_share, thin.

    ``rows``: *by, label; ``tasks``: label, task, a row a class, which is sent to the counts.  A row's task is that of
    its training label; labels outside the split are left out.  per_task and task_share go by task; thin: the
    classes of under ``least`` rows, those without any too, as ``label count``, by label."""
    counts = rows.groupBy(*by, "label").agg(F.count("*").alias("n"))
    grid = counts.select(*by).distinct().crossJoin(F.broadcast(tasks.select("label", "task")))  # a row a condition and class
    cells = grid.join(counts, [*by, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = cells.groupBy(*by, "task").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") < least, F.struct("label", F.concat_ws(" ", "label", "n").alias("t")))).alias("thin"))
    out = per.groupBy(*by).agg(F.sum("n").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("task", "n"))), lambda x: x["n"]).alias("per_task"), F.min("n").alias("_least"), F.array_sort(F.flatten(F.collect_list("thin"))).alias("_thin"))
    share = F.transform("per_task", lambda n: F.try_divide(n, F.col("rows")))
    return out.select(*by, "rows", "per_task", share.alias("task_share"), F.try_divide("_least", "rows").alias("min_share"), F.array_join(F.transform("_thin", lambda x: x["t"]), ", ").alias("thin"))


def broad_check(train: DataFrame, pred: DataFrame, scores: DataFrame) -> DataFrame:
    """Is one class over-predicted, and does replay change that: seed, broad, ratio, same_on_all_seeds, track, regime, share, gold_share, f1, minus_joint.

    ``train``: seed, gold, teacher.  The broad class of a seed has the greatest ratio of teacher to gold rows (ties: the
    smallest class).  ``pred``: seed, track, regime, gold, pred of test rows: share is its part of the predictions.
    ``scores``: seed, track, regime, f1; minus_joint is taken from the joint run of the track."""
    named = train.select("seed", F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("t")), F.struct(F.col("teacher").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("t")))).alias("c"))
    ratio = named.groupBy("seed", "c.label").agg(F.sum("c.g").alias("g"), F.sum("c.t").alias("t")).where("g > 0").withColumn("ratio", F.col("t") / F.col("g"))
    top = ratio.groupBy("seed").agg(F.max_by("label", F.struct("ratio", -F.col("label"))).alias("broad"), F.max("ratio").alias("ratio"))
    alike = top.agg((F.count_distinct("broad") <= 1).alias("same_on_all_seeds"))
    shares = pred.join(F.broadcast(top.select("seed", "broad")), "seed").groupBy("seed", "track", "regime").agg(F.avg((F.col("pred") == F.col("broad")).cast("double")).alias("share"), F.avg((F.col("gold") == F.col("broad")).cast("double")).alias("gold_share"))  # a row a seed
    joint = scores.where("regime = 'joint'").select("seed", "track", F.col("f1").alias("joint_f1"))
    met = shares.join(scores, ["seed", "track", "regime"], "left").join(joint, ["seed", "track"], "left")
    return met.join(top, "seed").crossJoin(alike).select("seed", "broad", "ratio", "same_on_all_seeds", "track", "regime", "share", "gold_share", "f1", (F.col("f1") - F.col("joint_f1")).alias("minus_joint"))


def analogous_drops(drops: DataFrame, pairs: DataFrame) -> DataFrame:
    """The drop of a pair is that of its earlier-learnt member; null within one task."""
    one = lambda s: drops.select(*[c for c in drops.columns if c not in ("label", "task", "drop", "first_f1", "final_f1")], F.col("label").alias(s), F.col("task").alias(f"task_{s}"), F.col("drop").alias(f"drop_{s}"))
    keys = [c for c in drops.columns if c not in ("label", "task", "drop", "first_f1", "final_f1")]
    both = pairs.join(one("a"), "a").join(one("b"), [*keys, "b"])
    earlier = F.when(F.col("task_a") < F.col("task_b"), F.col("drop_a")).when(F.col("task_b") < F.col("task_a"), F.col("drop_b"))
    return both.select(*keys, "a", "b", earlier.alias("drop"))


def purity_by_class(memory: DataFrame, train: DataFrame, by: list[str]) -> DataFrame:
    """Per class: memory rows, impure ones, and the impure rows that a random draw would give."""
    base = train.groupBy(*by, "label").agg(F.count("*").alias("train_rows"), F.count_if(F.col("label") != F.col("gold")).alias("train_impure"))
    held = memory.groupBy(*by, "label").agg(F.count("*").alias("rows"), F.count_if(F.col("label") != F.col("gold")).alias("impure"))
    return held.join(base, [*by, "label"]).withColumn("expected_impure", F.col("rows") * F.col("train_impure") / F.col("train_rows"))


def largest_drops(f1: DataFrame, before: str, after: str, by: list[str], k: int = 3) -> DataFrame:
    """The k labels whose F1 falls most from one condition to another."""
    from pyspark.sql import Window

    one = lambda c: F.max(F.when(F.col("condition") == c, F.col("f1")))
    d = f1.groupBy(*by, "label").agg((one(before) - one(after)).alias("drop")).where("drop IS NOT NULL")
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("drop"), "label"))).where(F.col("place") <= k)


def track_gap(acc: DataFrame) -> DataFrame:
    """ACC of the gold track minus the teacher track, by regime and seed."""
    one = lambda t: F.max(F.when(F.col("track") == t, F.col("acc")))
    return acc.groupBy("regime", "seed").agg((one("gold") - one("teacher")).alias("gap"))


def naive_report(r: DataFrame, by: list[str], tolerance: float = 1e-3) -> DataFrame:
    """A row a run: acc, bwt, forgotten (earlier tasks that ended below their own stage, ``0,1``), verdict
    (all, some or none of them; null for a single task), and whether BWT is degenerate: minus the mean diagonal."""
    from pyspark.sql import Window

    rows = r.withColumn("k", F.max("t").over(Window.partitionBy(*by)))
    one = lambda on: F.max(F.when(on, F.col("v")))
    cells = rows.groupBy(*by, "j").agg(one(F.col("t") == F.col("k")).alias("end"), one(F.col("t") == F.col("j")).alias("own"), F.max("k").alias("k"))
    early = F.col("j") < F.col("k")
    lost = early & (F.col("end") < F.col("own"))
    names = F.transform(F.array_sort(F.collect_list(F.when(lost, F.col("j")))), lambda j: j.cast("string"))
    out = cells.groupBy(*by).agg(
        F.when(F.count("end") == F.max("k") + 1, F.avg("end")).alias("acc"), F.avg(F.when(early, F.col("end") - F.col("own"))).alias("bwt"), F.avg(F.when(early, F.col("own"))).alias("_diag"),
        F.array_join(names, ",").alias("forgotten"), F.count_if(lost).alias("_lost"), F.count_if(early).alias("_early"),
    )
    verdict = F.when(F.col("_early") == 0, None).when(F.col("_lost") == F.col("_early"), "all").when(F.col("_lost") > 0, "some").otherwise("none")
    return out.select(*by, "acc", "bwt", "forgotten", verdict.alias("verdict"), (F.abs(F.col("bwt") + F.col("_diag")) <= tolerance).alias("degenerate"))


# --- verdicts: each takes one row a seed and gives one row (holds)

def verdict(name: str, rows: DataFrame, holds: Column) -> DataFrame:
    return rows.agg(holds.alias("holds")).select(F.lit(name).alias("line"), "holds")


def within_every_seed(d: str, most: float = schema.REAL_DIFFERENCE) -> Column:
    return F.bool_and(F.abs(F.col(d)) <= most)


def on_seeds(condition: Column, least: int = 2) -> Column:
    return F.count_if(condition) >= least


def score_predictions(ratios: DataFrame, acc: DataFrame, shares: DataFrame, kd: DataFrame) -> DataFrame:
    """The verdicts that rest on simple differences.

    ratios (seed, ratio, reference): 0.  acc (track, seed, naive, replay, fkd): 1-3 and 7.
    shares (seed, before, after): 6.  kd (seed, kd, replay): 8."""
    out = verdict("0", ratios, F.bool_and(F.abs(F.col("ratio") - F.col("reference")) <= 0.05))
    out = out.union(verdict("1", acc, F.bool_and(F.col("replay") > F.col("naive"))))
    for line, track in (("2", "gold"), ("3", "teacher")):
        out = out.union(verdict(line, acc.where(F.col("track") == track).withColumn("d", F.col("fkd") - F.col("replay")), within_every_seed("d")))
    out = out.union(verdict("6", shares, on_seeds(F.col("before") - F.col("after") > schema.REAL_DIFFERENCE)))
    near = acc.groupBy("track").agg(on_seeds(F.abs(F.col("fkd") - F.col("replay")) <= schema.REAL_DIFFERENCE).alias("ok"))
    out = out.union(verdict("7", near, F.bool_and("ok")))
    return out.union(verdict("8", kd, on_seeds(F.col("kd") - F.col("replay") > schema.REAL_DIFFERENCE)))


# --- rendering: reports are a few rows, so they are formatted on the driver

def _cell(x) -> str:
    return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def to_markdown(table: DataFrame, order: list[str]) -> str:
    rows = [[_cell(x) for x in r] for r in table.orderBy(*order).collect()]
    lines = [table.columns, ["---"] * len(table.columns), *rows]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def to_csv(table: DataFrame, order: list[str]) -> str:
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s
    rows = [table.columns, *([_cell(x) for x in r] for r in table.orderBy(*order).collect())]
    return "\n".join(",".join(quote(c) for c in r) for r in rows) + "\n"
