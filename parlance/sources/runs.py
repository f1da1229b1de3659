"""Run artefacts: metrics, R-matrices, predictions, feature and split files, and the scoring block of a pre-registration."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import read_files


def read_r_matrices(spark: SparkSession, glob: str) -> DataFrame:
    """run_id, track, regime, seed, metric, t, j, v of ``R_matrix.json`` files; nulls above the diagonal go."""
    kind = "run_id STRING, track STRING, regime STRING, seed INT, R_f1 ARRAY<ARRAY<DOUBLE>>, R_acc ARRAY<ARRAY<DOUBLE>>"
    raw = spark.read.schema(kind).json(glob, multiLine=True)
    both = raw.select("run_id", "track", "regime", "seed", F.explode(F.array(F.struct(F.lit("f1").alias("metric"), F.col("R_f1").alias("m")), F.struct(F.lit("acc").alias("metric"), F.col("R_acc").alias("m")))).alias("r"))
    rows = both.select("run_id", "track", "regime", "seed", "r.metric", F.posexplode("r.m").alias("t", "row"))
    return rows.select("run_id", "track", "regime", "seed", "metric", "t", F.posexplode("row").alias("j", "v")).where("v IS NOT NULL")


def read_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """One row a run: its metadata flattened beside its metrics; the directory's name is run_dir."""
    raw = spark.read.json(glob, multiLine=True).withColumn("run_dir", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return raw.select("run_dir", "meta.*", *[c for c in raw.columns if c not in ("meta", "run_dir")])


def select_runs(runs: DataFrame, keys: list[str], expected: DataFrame | None = None, schedule: str | None = None) -> DataFrame:
    """Clean runs only (of one ``schedule``, if named); a key may occur once, all share one hash, and no expected key is missing."""
    clean = runs.where("dirty = false")
    clean = clean if schedule is None else clean.where(F.col("schedule") == schedule)
    if clean.select("git_hash").distinct().count() > 1:
        raise ValueError("runs of more than one code version")
    twice = clean.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one run of {twice[0].asDict()}")
    if expected is not None and (lost := expected.join(clean, keys, "left_anti").limit(1).collect()):
        raise ValueError(f"no run of {lost[0].asDict()}")
    return clean


def scoring_block(spark: SparkSession, path: str, section: str, known: list[str]) -> DataFrame:
    """key, value, problem of ``key = value`` lines after ``section:``; duplicate, missing and unknown keys are told."""
    lines = read_files(spark, path).select(F.posexplode(F.split(F.element_at(F.split("content", f"(?m)^{section}:\\s*$"), 2), r"\r?\n")).alias("pos", "line"))
    pair = r"^\s*([A-Za-z0-9_]+)\s*=\s*(.+?)\s*$"
    rows = lines.where(F.col("line").rlike(pair)).select("pos", F.regexp_extract("line", pair, 1).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))
    want = spark.createDataFrame([(k,) for k in known], "key string").withColumn("known", F.lit(True))
    seen = rows.groupBy("key").agg(F.min_by("value", "pos").alias("value"), F.count("*").alias("n"))
    out = want.join(seen, "key", "full")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return out.select("key", "value", problem.alias("problem"))


def write_runs(payload: DataFrame, path: str) -> None:
    """A JSON file a run under ``path/_run=<run_id>``, as ``read_r_matrices`` takes it.

    Only the runs of ``payload`` are replaced, so a run that is written again stands once."""
    _write(payload, path, "json")


def write_predictions(pred: DataFrame, path: str) -> None:
    """Predictions (run_id, stage, row_id, gold, pred and whatever else) as Parquet, a folder a run."""
    _write(pred, path, "parquet")


def write_settings(provenance: DataFrame, path: str) -> None:
    """A JSON file of provenance and settings a run, in its folder."""
    _write(provenance, path, "json")


def write_epochs(log: DataFrame, path: str) -> None:
    """Epoch rows (run_id, t, stage, epoch, loss, dev_f1 and whatever else) as JSON lines, a folder a run, in order of t, stage and epoch."""
    rows = log.withColumn("_run", F.col("run_id")).repartition("_run").sortWithinPartitions("_run", "t", "stage", "epoch")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run").json(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """The epoch rows of all runs under ``path``."""
    return spark.read.schema("run_id string, t int, stage string, epoch int, loss double, dev_f1 double").json(f"{path}/_run=*")


def _write(rows: DataFrame, path: str, kind: str) -> None:
    one = rows.withColumn("_run", F.col("run_id")).repartition("_run") if kind == "json" else rows.withColumn("_run", F.col("run_id"))
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run").format(kind).save(path)


def read_predictions(spark: SparkSession, path: str, runs: DataFrame | None = None) -> DataFrame:
    """The predictions of all runs, or of the run_ids in ``runs``, whose folders alone are read."""
    pred = spark.read.parquet(path)
    if runs is not None:
        pred = pred.join(runs.select(F.col("run_id").cast(pred.schema["_run"].dataType).alias("_run")).distinct(), "_run", "left_semi")
    return pred.drop("_run")


def read_split(spark: SparkSession, path: str, relations: list[str]) -> DataFrame:
    """relation, task, head_index of a task split ``{"relation_to_task": {...}}``, numbered in the order of ``relations``."""
    kind = "struct<relation_to_task: map<string, int>>"
    found = read_files(spark, path).select(F.explode(F.from_json("content", kind)["relation_to_task"]).alias("relation", "task"))
    place = spark.createDataFrame(list(enumerate(relations)), "place int, relation string")
    rows = found.join(place, "relation")  # a row a relation
    ordered = F.array_sort(F.collect_list(F.struct("place", "relation", "task")))
    return rows.agg(ordered.alias("r")).select(F.posexplode("r").alias("head_index", "r")).select("r.relation", "r.task", "head_index")


def read_labelled(spark: SparkSession, paths: str | list[str], relations: list[str]) -> DataFrame:
    """corpus, row_id, window_text, subject, object, teacher, gold of JSON arrays of labelled pairs.

    Labels are places in ``relations``; pairs with a label outside it are left out, and ``row_id`` counts the rest of a file."""
    kind = "array<struct<window_text: string, subject: string, object: string, relation: string, gold_relation: string>>"
    place = F.create_map(*[F.lit(x) for i, r in enumerate(relations) for x in (r, i)])
    pair = F.transform(F.from_json("content", kind), lambda p: F.struct(p["window_text"].alias("window_text"), p["subject"].alias("subject"), p["object"].alias("object"), place[p["relation"]].alias("teacher"), place[p["gold_relation"]].alias("gold")))
    usable = F.filter(pair, lambda p: p["teacher"].isNotNull() & p["gold"].isNotNull())
    return read_files(spark, paths).select(F.col("stem").alias("corpus"), F.posexplode(usable).alias("row_id", "p")).select("corpus", F.col("row_id").cast("long").alias("row_id"), "p.*")


def read_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """corpus, row_id, x, teacher, gold of ``.npz`` files with X, y_teacher and y_gold; row_id is the row's place.

    A file is a task's work; its rows leave in blocks, so only its own arrays are held."""

    def rows(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1].removesuffix(".npz")
                with np.load(io.BytesIO(content), allow_pickle=False) as f:
                    x, teacher, gold = f["X"], f["y_teacher"], f["y_gold"]
                for lo in range(0, len(x), 1024):
                    hi = min(lo + 1024, len(x))
                    yield pd.DataFrame({"corpus": name, "row_id": np.arange(lo, hi), "x": list(x[lo:hi].astype("float32")), "teacher": teacher[lo:hi].astype("int64"), "gold": gold[lo:hi].astype("int64")})

    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    return raw.mapInPandas(rows, "corpus string, row_id long, x array<float>, teacher long, gold long")


def condition_difference(drawn: DataFrame, saved: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows (side, key, label) that one of two label conditions has and the other lacks; empty if they agree."""
    cols = [key, "label"]
    a = drawn.select(*cols).exceptAll(saved.select(*cols)).select(F.lit("drawn").alias("side"), *cols)
    return a.union(saved.select(*cols).exceptAll(drawn.select(*cols)).select(F.lit("saved").alias("side"), *cols))


def load_env(text: str, environ: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines, ``#`` comments; what the environment has wins."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs} | environ


def mask_secret(value: str) -> str:
    return value[:4] + "*" * max(0, len(value) - 4) if value else ""


