"""Label conditions: which rows a run trains on, under which labels, and the seeds of its draws."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import labels

# fixed values: conditions on the common rows, those with a draw, replicates, and a replicate's seed distance
CONDITIONS = ["gold_I", "teacher_I", "perm_I", "rand_I", "gold_sub"]
DRAWN = ["perm_I", "rand_I", "gold_sub"]
REPLICATES = [0, 1, 2]
REPLICATE_STEP = 100


def init_seed(seed: Column, replicate: Column) -> Column:
    """Null for replicate 0, which keeps the default."""
    return F.when(replicate != 0, seed + REPLICATE_STEP * replicate)


def draw_seed(condition: Column, seed: Column, replicate: Column) -> Column:
    """Null for conditions without a draw."""
    return F.when(condition.isin(DRAWN), seed + REPLICATE_STEP * replicate)


def condition_grid(spark: SparkSession, seeds: list[int] | None = None) -> DataFrame:
    """condition, seed, replicate, init_seed, draw_seed, path of every condition that must exist."""
    keys = [(c, s, r) for s in (seeds or schema.TRAINING["seeds"]) for c in CONDITIONS for r in (REPLICATES if c in DRAWN else [0])]
    grid = spark.createDataFrame(keys, "condition string, seed int, replicate int")
    c, s, r = F.col("condition"), F.col("seed"), F.col("replicate")
    return grid.select(c, s, r, init_seed(s, r).alias("init_seed"), draw_seed(c, s, r).alias("draw_seed"), F.concat_ws("/", c, F.concat(F.lit("seed"), s), F.concat(F.lit("r"), r)).alias("path"))


def train_rows(rows: DataFrame, condition: str, kept: list[int], seed: int | None = None) -> DataFrame:
    """row_id, gold, label of the rows that a run under ``condition`` trains on.

    ``rows`` has row_id, gold, teacher as head indices, those in ``kept`` being classes of the head.
    gold, teacher: all rows that the track keeps; the others live on the rows that both keep."""
    track = {"gold": "gold", "teacher": "teacher", "gold_I": "gold", "teacher_I": "teacher"}
    both = labels.intersection(rows, kept)
    if condition in track:
        base = both if condition.endswith("_I") else rows.where(F.col(condition).isin(kept))
        return base.select("row_id", "gold", F.col(track[condition]).alias("label"))
    if seed is None:
        raise ValueError(f"{condition} needs the seed of its draw")
    if condition == "perm_I":
        return labels.permute_within_class(both, seed)
    if condition == "rand_I":
        return labels.random_flip(both, seed, len(kept))
    if condition == "gold_sub":
        return labels.uniform_subset(rows.where(F.col("gold").isin(kept)), both.count(), seed).select("row_id", "gold", F.col("gold").alias("label"))
    raise ValueError(f"no such condition: {condition}")


def write_conditions(rows: DataFrame, kept: list[int], path: str, seeds: list[int] | None = None) -> int:
    """Every condition of the grid in a folder of its own; how many there are."""
    made = condition_grid(rows.sparkSession, seeds).collect()  # a few dozen keys
    for g in made:
        train_rows(rows, g.condition, kept, g.draw_seed).write.mode("overwrite").parquet(f"{path}/{g.path}")
    return len(made)


def frozen(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made only if it isn't there, so that later runs read the very same rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def eval_sets(pairs: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of the evaluation sets of a task split, by gold labels alone.

    ``pairs``: part (dev, test), dialogue, index, gold_relations and what else a row keeps; ``split``: relation, task,
    head_index, a row a class, which is sent to the pairs.  Pairs of several labels are dropped, and so are those
    whose label (none: unanswerable) the split lacks.  rows: the others with y (head index) and task.  counts: part, n_examples, per_task (by task, of all tasks of
    the split), dropped_multilabel, dropped_class.  ``frozen`` keeps the rows for later runs."""
    gold = F.coalesce(F.try_element_at("gold_relations", F.lit(1)), F.lit("unanswerable"))
    kinds = F.broadcast(split.select(F.col("relation").alias("_r"), "task", F.col("head_index").alias("y")))
    met = pairs.withColumn("_several", F.coalesce(F.size("gold_relations"), F.lit(0)) > 1).withColumn("_gold", gold).join(kinds, F.col("_gold") == F.col("_r"), "left")
    used = ~F.col("_several") & F.col("y").isNotNull()
    tasks = split.select("task").distinct()
    counts = met.groupBy("part").agg(F.count_if(used).alias("n_examples"), F.count_if(F.col("_several")).alias("dropped_multilabel"), F.count_if(~F.col("_several") & F.col("y").isNull()).alias("dropped_class"))
    n = met.where(used).groupBy("part", "task").agg(F.count("*").alias("n"))
    per = met.select("part").distinct().crossJoin(F.broadcast(tasks)).join(n, ["part", "task"], "left")  # a row a part and task
    per = per.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("task", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("per_task"))
    return met.where(used).select(*pairs.columns, "y", "task"), counts.join(per, "part").select("part", "n_examples", "per_task", "dropped_multilabel", "dropped_class")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with the side that has them, which one of two memories or conditions has and the other lacks."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).union(b.exceptAll(a).withColumn("side", F.lit("second")))


def teacher_rows(pairs: DataFrame, answers: DataFrame, legal: list[str], thin: int = 20) -> tuple[DataFrame, DataFrame]:
    """(labelled pairs, one-row report) of a teacher's answers.

    ``pairs`` has dialogue, index, gold_relations; ``answers`` dialogue, pos, index, relation.  The teacher
    sees all pairs of a dialogue; its last legal answer for a pair counts, pairs without one are dropped, and
    so are pairs of several gold labels, after the teacher has seen them."""
    said = answers.where(F.col("relation").isin(legal)).groupBy("dialogue", "index").agg(F.max_by("relation", "pos").alias("relation"))
    met = pairs.join(said, ["dialogue", "index"])
    one = met.where(F.size("gold_relations") == 1)
    out = one.withColumn("teacher_correct", F.array_contains("gold_relations", F.col("relation")))
    report = out.agg(F.count("*").alias("labelled"), F.avg(F.col("teacher_correct").cast("double")).alias("agreement"), F.count_distinct("relation").alias("types_used"))
    return out, report.withColumn("types_absent", F.lit(len(legal)) - F.col("types_used"))


def label_distribution(rows: DataFrame, label: str, legal: DataFrame, thin: int = 20) -> DataFrame:
    """relation, n, state: every legal relation with its count; ``absent``, ``thin`` (fewer than ``thin`` rows) or ``used``."""
    counts = rows.groupBy(F.col(label).alias("relation")).agg(F.count("*").alias("n"))
    out = legal.select("relation").join(counts, "relation", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("state", F.when(F.col("n") == 0, "absent").when(F.col("n") < thin, "thin").otherwise("used"))


def diagnostics_summary(epochs: DataFrame, by: list[str]) -> DataFrame:
    """Of (*by, task, epoch, entropy, uniform_entropy, row_max, uniform_max, focal, fkd, cls): means over the
    tasks of the entropy fraction, of the maximum over the uniform one, and of focal factor and weighted loss
    ratio at the first and the last epoch."""
    at = lambda v, pick: pick(v, "epoch")
    ratio = F.col("fkd") / F.col("cls")
    task = epochs.groupBy(*by, "task").agg(
        F.max(F.col("entropy") / F.col("uniform_entropy")).alias("e"), F.max(F.col("row_max") / F.col("uniform_max")).alias("m"),
        at(ratio, F.min_by).alias("r0"), at(ratio, F.max_by).alias("r1"), at(F.col("focal"), F.min_by).alias("f0"), at(F.col("focal"), F.max_by).alias("f1"),
    )
    return task.groupBy(*by).agg(F.avg("e").alias("s_entropy_frac"), F.avg("m").alias("s_max_over_uniform"), F.avg("r0").alias("loss_ratio_first"), F.avg("r1").alias("loss_ratio_last"), F.avg("f0").alias("focal_first"), F.avg("f1").alias("focal_last"))


def target_agreement(targets: DataFrame, keys: list[str]) -> DataFrame:
    """One row of (row_id, label, proto, weight): share of rows whose heaviest target is their label, mean and
    median weight of the label, mean entropy as a fraction of the uniform one."""
    best = F.max_by("proto", F.struct(F.round("weight", 9), -F.col("proto")))
    entropy = -F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.ln("weight")).otherwise(0.0))
    rows = targets.groupBy(*keys, "label").agg(best.alias("top"), F.max(F.when(F.col("proto") == F.col("label"), F.col("weight"))).alias("p"), F.when(F.count("*") > 1, entropy / F.ln(F.count("*"))).otherwise(0.0).alias("h"))
    return rows.agg(F.avg((F.col("top") == F.col("label")).cast("double")).alias("agreement"), F.avg("p").alias("mean_p"), F.percentile("p", 0.5).alias("median_p"), F.avg("h").alias("entropy_frac"))


def parameter_hash(weights: list[np.ndarray]) -> str:
    """The first 16 hex digits of a SHA-256 over a network's weights, in order."""
    digest = hashlib.sha256()
    for k, w in enumerate(weights):
        digest.update(f"w{k}".encode())
        digest.update(np.ascontiguousarray(w, dtype="<f8").tobytes())
    return digest.hexdigest()[:16]


def run_payload(r: DataFrame, by: list[str]) -> DataFrame:
    """One row a run: its R-matrices as nested arrays with ACC and BWT, for both metrics.

    ``r`` has *by, metric (f1 or acc), t, j, v; ACC is the mean of the last row, BWT the mean change of the
    earlier tasks from their own stage to the last (null for a single task)."""
    last = F.max("t").over(_by(by + ["metric"]))
    own = F.max(F.when(F.col("t") == F.col("j"), F.col("v"))).over(_by(by + ["metric", "j"]))
    cells = r.withColumn("last", last).withColumn("own", own)
    row = cells.groupBy(*by, "metric", "t").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("vs"), F.avg(F.when(F.col("t") == F.col("last"), F.col("v"))).alias("acc"), F.avg(F.when((F.col("t") == F.col("last")) & (F.col("j") < F.col("last")), F.col("v") - F.col("own"))).alias("bwt"))
    m = row.groupBy(*by, "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "vs"))), lambda x: F.transform(x["vs"], lambda c: c["v"])).alias("R"), F.max("acc").alias("acc"), F.max("bwt").alias("bwt"))
    one = lambda metric, c: F.any_value(F.when(F.col("metric") == metric, F.col(c)), ignoreNulls=True)
    return m.groupBy(*by).agg(*[one(k, c).alias(f"{n}_{k}") for k in ("f1", "acc") for c, n in (("R", "R"), ("acc", "ACC"), ("bwt", "BWT"))])


def _by(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
