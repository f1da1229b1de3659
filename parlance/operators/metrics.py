"""Classification and continual-learning metrics over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def accuracy(pred: DataFrame, by: list[str], gold: str = "gold", guess: str = "pred") -> DataFrame:
    return pred.groupBy(*by).agg(F.coalesce(F.avg((F.col(gold) == F.col(guess)).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def confusion(pred: DataFrame, by: list[str], gold: str = "gold", guess: str = "pred") -> DataFrame:
    return pred.groupBy(*by, F.col(gold).alias("gold"), F.col(guess).alias("pred")).agg(F.count("*").alias("n"))


def row_normalised(c: DataFrame, by: list[str]) -> DataFrame:
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "gold")))


def diagonal_check(c: DataFrame, by: list[str]) -> DataFrame:
    """gold, diagonal, the largest off-diagonal cell (larger label on ties), and whether the diagonal is the row's maximum."""
    off = F.max(F.when(F.col("gold") != F.col("pred"), F.struct("n", "pred")))
    out = c.groupBy(*by, "gold").agg(F.coalesce(F.max(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("diagonal"), off.alias("o"))
    return out.select(*by, "gold", "diagonal", F.col("o.n").alias("off_n"), F.col("o.pred").alias("off_label"), (F.col("diagonal") >= F.coalesce("o.n", F.lit(0))).alias("dominant"))


def class_f1(pred: DataFrame, by: list[str], gold: str = "gold", guess: str = "pred") -> DataFrame:
    """label, support, precision, recall, f1 of every class that occurs as gold; 0 where undefined."""
    c = confusion(pred, by, gold, guess)
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"))))
    out = c.select(*by, sides.alias("s")).groupBy(*by, "s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.said").alias("said")).where("support > 0")
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("said")), F.lit(0.0)), F.col("tp") / F.col("support")
    return out.select(*by, "label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def macro_f1(pred: DataFrame, by: list[str], gold: str = "gold", guess: str = "pred") -> DataFrame:
    return class_f1(pred, by, gold, guess).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def majority_accuracy(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))


def r_matrix(pred: DataFrame, by: list[str]) -> DataFrame:
    """t, j, v: accuracy on task j's rows after stage t, for j <= t."""
    return accuracy(pred.where("task <= stage"), [*by, "stage", "task"]).select(*by, F.col("stage").alias("t"), F.col("task").alias("j"), F.round("accuracy", 6).alias("v"))


def acc(r: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the last row; null if a cell is missing."""
    last = r.withColumn("k", F.max("t").over(Window.partitionBy(*by)) + 1).where("t = k - 1")
    return last.groupBy(*by).agg(F.when(F.count("v") == F.max("k"), F.avg("v")).alias("acc"))


def forgetting(r: DataFrame, by: list[str]) -> DataFrame:
    """j, forgetting: last row minus diagonal, for all but the last task."""
    rows = r.withColumn("k", F.max("t").over(Window.partitionBy(*by)))
    cells = rows.groupBy(*by, "j").agg(F.max(F.when(F.col("t") == F.col("k"), F.col("v"))).alias("end"), F.max(F.when(F.col("t") == F.col("j"), F.col("v"))).alias("own"), F.max("k").alias("k"))
    return cells.where("j < k").select(*by, "j", (F.col("end") - F.col("own")).alias("forgetting"), (F.col("end") < F.col("own")).alias("forgot"))


def bwt(r: DataFrame, by: list[str]) -> DataFrame:
    """Mean forgetting; null for a single task."""
    keys = r.select(*by).distinct()
    f = forgetting(r, by).groupBy(*by).agg(F.avg("forgetting").alias("bwt"))
    return keys.join(f, by, "left")


def acc_after(r: DataFrame, by: list[str]) -> DataFrame:
    return r.groupBy(*by, "t").agg(F.avg("v").alias("acc"))


def observed_accuracy(pred: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all rows of the tasks seen at each stage."""
    return accuracy(pred.where("task <= stage"), [*by, "stage"])


def bwt_degenerate(r: DataFrame, by: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Whether BWT is just minus the mean diagonal of the earlier tasks (all of them forgotten to zero)."""
    rows = r.withColumn("k", F.max("t").over(Window.partitionBy(*by)))
    diag = rows.where("t = j AND j < k").groupBy(*by).agg(F.avg("v").alias("mean_diag"))
    return bwt(r, by).join(diag, by, "left").withColumn("degenerate", F.abs(F.col("bwt") + F.col("mean_diag")) <= tolerance)


def diagonal_warnings(r: DataFrame, joint: DataFrame, by: list[str], margin: float = schema.DIAGONAL_WARNING) -> DataFrame:
    return r.where("t = j").join(joint, by).where(F.col("v") < F.col("joint") - margin)


def r_problems(r: DataFrame, by: list[str], k: int) -> DataFrame:
    """Cells above the diagonal, out of [0, 1] or missing: by, t, j, problem."""
    bad = r.where("j > t").select(*by, "t", "j", F.lit("above the diagonal").alias("problem")).union(r.where("v < 0 OR v > 1").select(*by, "t", "j", F.lit("out of range").alias("problem")))
    cells = r.sparkSession.createDataFrame([(t, j) for t in range(k) for j in range(t + 1)], "t int, j int")
    lost = r.select(*by).distinct().crossJoin(F.broadcast(cells)).join(r, [*by, "t", "j"], "left_anti")  # K*(K+1)/2 cells a run
    return bad.union(lost.select(*by, "t", "j", F.lit("missing").alias("problem")))


def broad_class(rows: DataFrame) -> DataFrame:
    """The label with the largest ratio of teacher to gold rows (smaller label on ties)."""
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("t")), F.struct(F.col("teacher").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("t"))))
    n = rows.select(sides.alias("x")).groupBy("x.label").agg(F.sum("x.g").alias("gold_n"), F.sum("x.t").alias("teacher_n")).where("gold_n > 0")
    return n.withColumn("ratio", F.col("teacher_n") / F.col("gold_n")).orderBy(F.desc("ratio"), "label").limit(1)


def share_of(pred: DataFrame, label, by: list[str], guess: str = "pred") -> DataFrame:
    return pred.groupBy(*by).agg(F.avg((F.col(guess) == label).cast("double")).alias("share"))


def buffer_purity(memory: DataFrame, by: list[str]) -> DataFrame:
    """(task, class, gold, label) memory rows -> per class: rows, impure, purity, cumulative purity by task."""
    out = memory.groupBy(*by, "task").agg(F.count("*").alias("rows"), F.count_if(F.col("gold") != F.col("label")).alias("impure"))
    w = Window.partitionBy(*by).orderBy("task").rowsBetween(Window.unboundedPreceding, 0) if by else Window.partitionBy(F.lit(1)).orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("purity", 1.0 - F.col("impure") / F.col("rows")).withColumn("cum_purity", 1.0 - F.sum("impure").over(w) / F.sum("rows").over(w))


def spread(values: DataFrame, by: list[str], v: str) -> DataFrame:
    return values.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("spread"))


def paired_difference(values: DataFrame, keys: list[str], regime: str, a: str, b: str, v: str) -> DataFrame:
    """v of regime a minus v of regime b for each key, in one aggregation."""
    one = lambda x: F.max(F.when(F.col(regime) == x, F.col(v)))
    return values.groupBy(*keys).agg(one(a).alias("a"), one(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))


def real_sign(d: DataFrame, by: list[str], replicate: str = "replicate", v: str = "d", least: float = schema.REAL_DIFFERENCE) -> DataFrame:
    """+1 / -1 if replicate 0 exceeds ``least`` and all replicates share one strict sign, else 0."""
    first = F.max(F.when(F.col(replicate) == 0, F.abs(v)))
    sign = F.when(first <= least, 0).when(F.min(v) > 0, 1).when(F.max(v) < 0, -1).otherwise(0)
    return d.groupBy(*by).agg(F.coalesce(sign, F.lit(0)).alias("sign"))


def direction(signs: DataFrame, by: list[str], needed: int = 2) -> DataFrame:
    """real-positive / real-negative if at least ``needed`` seeds agree, else none."""
    up, down = F.count_if(F.col("sign") == 1), F.count_if(F.col("sign") == -1)
    return signs.groupBy(*by).agg(F.when(up >= needed, "real-positive").when(down >= needed, "real-negative").otherwise("none").alias("direction"))


def class_drops(f1: DataFrame, by: list[str]) -> DataFrame:
    """(label, task, stage, f1) -> F1 at the stage a class is learnt, at the end, and the drop."""
    end = F.max("stage").over(Window.partitionBy(*by)) if by else F.max("stage").over(Window.partitionBy(F.lit(1)))
    rows = f1.withColumn("end", end)
    out = rows.groupBy(*by, "label", "task").agg(F.max(F.when(F.col("stage") == F.col("task"), F.col("f1"))).alias("first_f1"), F.max(F.when(F.col("stage") == F.col("end"), F.col("f1"))).alias("final_f1"))
    return out.withColumn("drop", F.col("first_f1") - F.col("final_f1"))


def noise_breakdown(rows: DataFrame, kept: list[int]) -> DataFrame:
    """Counts of rows kept in both, one or no track, and agreement rates, in one row."""
    g, t, same = F.col("gold").isin(kept), F.col("teacher").isin(kept), F.col("gold") == F.col("teacher")
    return rows.agg(F.count_if(g & t).alias("both"), F.count_if(g & ~t).alias("gold_only"), F.count_if(~g & t).alias("teacher_only"), F.count_if(~g & ~t).alias("neither"), F.avg(F.when(g & t, same.cast("double"))).alias("agree_both"), F.avg(same.cast("double")).alias("agree_all"))


def condition_stats(rows: DataFrame, by: list[str], broad: int, least: int = schema.MIN_EXAMPLES) -> DataFrame:
    """rows, noise rate, rows of the broad class, and classes below ``least`` as a list."""
    per = rows.groupBy(*by, "label").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("gold")).alias("noisy"))
    thin = F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") < least, F.col("label")))).cast("array<string>"), ",")
    return per.groupBy(*by).agg(F.sum("n").alias("rows"), (F.sum("noisy") / F.sum("n")).alias("noise_rate"), F.coalesce(F.sum(F.when(F.col("label") == broad, F.col("n"))), F.lit(0)).alias("broad_rows"), thin.alias("thin_classes"))
