"""What a run is made of, and the guards that a sweep has to pass before it starts.

A run is a row: track, regime, seed, replicate, schedule, with the code version, settings and the digest of
the label condition it trains on.  Guards compare the planned rows with what is stored, by anti joins, and give
every reason not to start as a row.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import conditions

# fixed values: the regimes that each condition runs under, and those of each schedule
CONDITION_REGIMES = {
    "gold_I": ["joint", "joint_balanced", "naive", "replay"], "teacher_I": ["joint", "joint_balanced", "naive", "replay"], "perm_I": ["joint", "joint_balanced", "naive", "replay"],
    "rand_I": ["joint", "joint_balanced", "naive", "replay"], "gold_sub": ["joint", "replay"],
}
SCHEDULE_REGIMES = {"primary": ["joint", "joint_balanced", "naive", "replay", "fkd"], "fixed": ["replay", "fkd", "kd"]}
KEYS = ["track", "regime", "seed", "replicate", "schedule"]


def settings_text(settings: dict | None = None) -> str:
    """Training settings as JSON with sorted keys."""
    return json.dumps(schema.TRAINING if settings is None else settings, sort_keys=True)


def condition_digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """*by, rows, digest of (*by, row_id, label) rows: the same for the same rows in whatever order.

    Sums of two hashes a row, so it is one aggregation with map-side combine; repeated rows count."""
    h = lambda k: F.sum(F.xxhash64("row_id", "label", F.lit(k)).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.left(F.sha2(F.concat_ws("|", F.count("*").cast("string"), h(1), h(2)), 256), F.lit(16)).alias("digest"))


def plan_runs(spark: SparkSession, seeds: list[int] | None = None, replicates: list[int] | None = None, regimes: dict[str, list[str]] | None = None, schedule: str = "primary") -> DataFrame:
    """A row a run of the sweep over the label conditions: KEYS, init_seed, draw_seed.  Every replicate runs every condition anew."""
    keys = [(c, g, s, r, schedule) for r in (conditions.REPLICATES if replicates is None else replicates) for c, gs in (regimes or CONDITION_REGIMES).items() for g in gs for s in (seeds or schema.TRAINING["seeds"])]
    grid = spark.createDataFrame(keys, "track string, regime string, seed int, replicate int, schedule string")
    seed, replicate = F.col("seed"), F.col("replicate")
    return grid.select("*", F.coalesce(conditions.init_seed(seed, replicate), seed).alias("init_seed"), conditions.draw_seed(F.col("track"), seed, replicate).alias("draw_seed"))


def provenance(runs: DataFrame, digests: DataFrame, version: str, settings: dict | None = None) -> DataFrame:
    """``runs`` with run_id, code version, whether it is dirty, settings and their hash, and the digest of their condition.

    ``digests``: track, draw_seed (null: no draw), rows, digest.  A version that ends in ``-dirty`` has changes that are
    not committed.  A run whose condition is not there keeps a null digest, which a guard tells."""
    text = settings_text(settings)
    name = F.concat_ws("_", "track", F.concat("regime", F.when(F.col("schedule") == "fixed", "-fixed").otherwise("")), "seed", F.concat(F.lit("i"), "init_seed"))
    of = digests.select(F.col("track").alias("of"), F.col("draw_seed").alias("drawn"), F.col("rows").alias("train_rows"), F.col("digest").alias("condition_digest"))
    met = runs.join(of, (F.col("track") == F.col("of")) & F.col("draw_seed").eqNullSafe(F.col("drawn")), "left").drop("of", "drawn")
    return met.select(name.alias("run_id"), "*", F.lit(version.removesuffix("-dirty")).alias("git_hash"), F.lit(version.endswith("-dirty")).alias("dirty"), F.lit(text).alias("settings"), F.left(F.sha2(F.lit(text), 256), F.lit(16)).alias("settings_hash"))


def guards(planned: DataFrame, saved: DataFrame, finished: DataFrame) -> DataFrame:
    """run_id, problem: every reason why a run of ``planned`` (rows of ``provenance``) must not start.

    ``saved``: track, draw_seed, digest of the conditions that were frozen; ``finished``: KEYS, git_hash, settings_hash
    of the runs that are there.  Problems: ``code has changes``, ``regime not in schedule``, ``regime not of
    condition``, ``replicate without condition``, ``no saved condition``, ``condition differs``, ``run is there``,
    ``runs of other code``, ``planned twice``."""
    say = lambda df, what: df.select("run_id", F.lit(what).alias("problem"))
    runs = planned.sparkSession
    allowed = runs.createDataFrame([(s, g) for s, gs in SCHEDULE_REGIMES.items() for g in gs], "schedule string, regime string")
    of = runs.createDataFrame([(c, g) for c, gs in CONDITION_REGIMES.items() for g in gs], "track string, regime string")
    known = of.select("track").distinct()
    kept = saved.select(F.col("track").alias("of"), F.col("draw_seed").alias("drawn"), F.col("digest").alias("saved_digest"))
    on = (F.col("track") == F.col("of")) & F.col("draw_seed").eqNullSafe(F.col("drawn"))
    conditioned = planned.join(known, "track", "left_semi")
    there = finished.select(*KEYS).distinct()
    other = finished.join(planned.select("git_hash").distinct(), "git_hash", "left_anti").select(*KEYS).distinct()
    out = [
        say(planned.where("dirty"), "code has changes"),
        say(planned.join(allowed, ["schedule", "regime"], "left_anti"), "regime not in schedule"),
        say(conditioned.join(of, ["track", "regime"], "left_anti"), "regime not of condition"),
        say(planned.where("replicate <> 0").join(known, "track", "left_anti"), "replicate without condition"),
        say(conditioned.join(kept, on, "left_anti"), "no saved condition"),
        say(conditioned.join(kept, on).where("NOT condition_digest <=> saved_digest"), "condition differs"),
        say(planned.join(there, KEYS, "left_semi"), "run is there"),
        say(planned.join(other, KEYS, "left_semi"), "runs of other code"),
        say(planned.groupBy("run_id").count().where("count > 1"), "planned twice"),
    ]
    rows = out[0]
    for o in out[1:]:
        rows = rows.union(o)
    return rows


def require(problems: DataFrame, shown: int = 5) -> None:
    """Stop with the first few problems, if there is one."""
    found = problems.orderBy("run_id", "problem").limit(shown).collect()
    if found:
        raise ValueError("; ".join(f"{r.run_id}: {r.problem}" for r in found))
