"""Label conditions, task splits, samplers and their checks."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema


def draw_key(seed: int, *columns: str) -> Column:
    """A seeded, engine-independent order: md5 of seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def recode(rows: DataFrame, label: str, head: DataFrame, out: str) -> DataFrame:
    """Label -> head index by (relation, head_index); -1 outside."""
    table = head.select(F.col("relation").alias("_rel"), F.col("head_index").alias("_h"))
    return rows.join(F.broadcast(table), F.col(label) == F.col("_rel"), "left").withColumn(out, F.coalesce("_h", F.lit(-1))).drop("_rel", "_h")


def intersection(rows: DataFrame, kept: list[int]) -> DataFrame:
    return rows.where(F.col("gold").isin(kept) & F.col("teacher").isin(kept))


def permute_within_class(rows: DataFrame, seed: int) -> DataFrame:
    """Teacher labels dealt anew within each gold class: row_id, gold, label.  The confusion matrix stays."""
    by = lambda order: F.row_number().over(Window.partitionBy("gold").orderBy(*order))
    seats = rows.select("row_id", "gold", by([F.col("row_id")]).alias("rn"))
    dealt = rows.select("gold", F.col("teacher").alias("label"), by([draw_key(seed, "row_id"), F.col("row_id")]).alias("rn"))
    return seats.join(dealt, ["gold", "rn"]).select("row_id", "gold", "label")


def _ranked(rows: DataFrame, key: Column) -> DataFrame:
    """Add the rank of each row in one global order, without a single-task sort: ranks within 4096 slices of
    the key, then the slices' offsets (a small table)."""
    rows = rows.withColumn("_k", key).withColumn("_s", F.substring("_k", 1, 3))
    w = Window.partitionBy("_s").orderBy("_k", "row_id")
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("_s", ahead.alias("_a"))), "_s").withColumn("rank", F.row_number().over(w) + F.col("_a")).drop("_k", "_s", "_a")


def random_flip(rows: DataFrame, seed: int, classes: int) -> DataFrame:
    """As many gold labels as teacher and gold disagree on (half-even) become another class: row_id, gold, label."""
    share = rows.agg((F.count("*") * (1.0 - F.avg((F.col("gold") == F.col("teacher")).cast("double")))).alias("x")).select(F.bround("x", 0).cast("long").alias("flips"))
    rows = _ranked(rows, draw_key(seed, "row_id")).crossJoin(F.broadcast(share))  # one row
    other = (F.col("gold") + 1 + F.pmod(F.conv(F.substring(draw_key(seed + 1, "row_id"), 1, 8), 16, 10).cast("long"), F.lit(classes - 1))) % classes
    return rows.select("row_id", "gold", F.when(F.col("rank") <= F.col("flips"), other).otherwise(F.col("gold")).cast("int").alias("label"))


def uniform_subset(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return _ranked(rows, draw_key(seed, "row_id")).where(F.col("rank") <= n).drop("rank")


def viable_classes(rows: DataFrame, least: int = schema.MIN_EXAMPLES, excluded: tuple = ()) -> DataFrame:
    """label, gold_n, teacher_n, reason (null if viable in both tracks)."""
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("t")), F.struct(F.col("teacher").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("t"))))
    out = rows.select(sides.alias("x")).groupBy("x.label").agg(F.sum("x.g").alias("gold_n"), F.sum("x.t").alias("teacher_n"))
    reason = F.when(F.col("label").isin(list(excluded)) if excluded else F.lit(False), "excluded").when((F.col("gold_n") < least) & (F.col("teacher_n") < least), "rare in both").when(F.col("gold_n") < least, "rare in gold").when(F.col("teacher_n") < least, "rare in teacher")
    return out.withColumn("reason", reason)


def split_score(counts: list[dict[int, int]], task: dict[int, int], tasks: int) -> float | None:
    """Largest deviation of a task's share from an equal one, over all tracks; None if a constraint fails."""
    worst = 0.0
    for track in counts:
        total = sum(track.values())
        for t in range(tasks):
            members = [c for c, k in task.items() if k == t]
            share = sum(track[c] for c in members) / total
            if len(members) < schema.MIN_CLASSES or share < schema.MIN_SHARE:
                return None
            worst = max(worst, abs(share - 1 / tasks))
    return worst


def search_split(counts: list[dict[int, int]], tasks: int = 3, seed: int = 1234, restarts: int = 200) -> dict[int, int]:
    """Best split over seeded restarts of steepest single-class moves; tasks renumbered by first appearance."""
    r, classes = random.Random(seed), sorted(counts[0])
    best: tuple[float, dict[int, int]] | None = None
    for _ in range(restarts):
        task = {c: r.randrange(tasks) for c in classes}
        score = split_score(counts, task, tasks)
        while True:
            moves = ((split_score(counts, task | {c: t}, tasks), c, t) for c, t in itertools.product(classes, range(tasks)) if task[c] != t)
            moves = [m for m in moves if m[0] is not None and (score is None or m[0] < score - 1e-12)]
            if not moves:
                break
            score, c, t = min(moves)
            task[c] = t
        if score is not None and (best is None or score < best[0] - 1e-12):
            best = (score, dict(task))
    if best is None:
        raise ValueError("no split meets the constraints")
    order = {t: k for k, t in enumerate(dict.fromkeys(best[1][c] for c in classes))}
    return {c: order[best[1][c]] for c in classes}


def renumber(split: DataFrame) -> DataFrame:
    """Tasks numbered from 0 by the smallest head index in them."""
    first = split.groupBy("task").agg(F.min("head_index").alias("f"))
    number = first.withColumn("new_task", F.dense_rank().over(Window.orderBy("f")) - 1)  # a row a task
    return split.join(F.broadcast(number.select("task", "new_task")), "task")


def check_split(split: DataFrame, classes: DataFrame) -> DataFrame:
    """problem, relation: a class in two tasks, a class without task, a task's class that is unknown."""
    twice = split.groupBy("relation").agg(F.count_distinct("task").alias("n")).where("n > 1").select(F.lit("in two tasks").alias("problem"), "relation")
    lost = classes.join(split, "relation", "left_anti").select(F.lit("in no task").alias("problem"), "relation")
    odd = split.join(classes, "relation", "left_anti").select(F.lit("unknown").alias("problem"), "relation").distinct()
    return twice.union(lost).union(odd)


def largest_remainder(strata: DataFrame, n: int) -> DataFrame:
    """stratum, size -> seats: floors of the quotas, the rest to the largest remainders (ties by name)."""
    total = F.sum("size").over(Window.partitionBy(F.lit(1)))  # a row a stratum
    quota = strata.withColumn("quota", F.col("size") * F.lit(float(n)) / total).withColumn("low", F.floor("quota"))
    left = F.lit(n) - F.sum("low").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("quota") - F.col("low"), 9)), "stratum"))
    return quota.withColumn("left", left).withColumn("place", place).select("stratum", "size", (F.col("low") + (F.col("place") <= F.col("left")).cast("long")).alias("seats"))


def stratified_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """row_id, stratum -> the seats of each stratum filled in seeded order."""
    seats = largest_remainder(rows.groupBy("stratum").agg(F.count("*").alias("size")), n)
    w = Window.partitionBy("stratum").orderBy(draw_key(seed, "row_id"), "row_id")
    return rows.join(F.broadcast(seats.select("stratum", "seats")), "stratum").withColumn("rn", F.row_number().over(w)).where("rn <= seats").select("row_id", "stratum")


def last_answer(answers: DataFrame, n_labels: int, legal: list[str]) -> DataFrame:
    """(dialogue, pos, index, relation) -> the last legal relation of each index in range."""
    ok = answers.where((F.col("index") >= 0) & (F.col("index") < n_labels) & F.col("relation").isin(legal))
    return ok.groupBy("dialogue", "index").agg(F.max_by("relation", "pos").alias("relation"))


def reverse_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with the label of (y, x) in their dialogue; the last such pair counts."""
    back = pairs.groupBy("dialogue", F.col("y").alias("bx"), F.col("x").alias("by")).agg(F.max_by("label", "pos").alias("reverse_label"))
    return pairs.join(back.select("dialogue", F.col("bx").alias("x"), F.col("by").alias("y"), "reverse_label"), ["dialogue", "x", "y"], "left")


def balanced_draws(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement, every label alike: draw, row_id, label.

    Draw i picks a label, then a place in it, by its own digest; places are row numbers, so the draw is
    an equi-join and no cumulative weights are needed."""
    spark: SparkSession = rows.sparkSession
    sized = rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("row_id")) - 1)
    labels = rows.groupBy("label").agg(F.count("*").alias("size")).withColumn("k", F.row_number().over(Window.orderBy("label")) - 1)
    number = labels.count()
    u = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-{salt}"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = spark.range(n).select(F.col("id").alias("draw")).select("draw", F.pmod(u("label"), F.lit(max(1, number))).cast("int").alias("k"), u("row").alias("u"))
    picked = draws.join(F.broadcast(labels), "k").select("draw", "label", F.pmod("u", "size").alias("place"))
    return picked.join(sized.select("label", "place", "row_id"), ["label", "place"]).select("draw", "row_id", "label")
