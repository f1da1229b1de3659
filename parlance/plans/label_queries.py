"""Queries over labels, vectors, predictions and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx
from ..operators import labels, metrics, trainer, vectors, windows
from . import base
from .base import LABELS, query, table

KEPT = [0, 1, 2, 3, 4, 5, 6]
_KEPT = "(0, 1, 2, 3, 4, 5, 6)"
INTER = LABELS + f", i AS (SELECT * FROM l WHERE gold IN {_KEPT} AND teacher IN {_KEPT})"
PRED = LABELS + ", p AS (SELECT gold, teacher AS pred, task FROM l)"
_F1 = """f AS (SELECT label, support, CASE WHEN said = 0 THEN 0.0 ELSE tp / said END::DOUBLE AS precision, (tp / support)::DOUBLE AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (support + said) END::DOUBLE AS f1 FROM (
  SELECT g.label, g.support, coalesce(s.said, 0) AS said, coalesce(x.tp, 0) AS tp FROM (SELECT gold AS label, count(*) AS support FROM p GROUP BY 1) g
  LEFT JOIN (SELECT pred AS label, count(*) AS said FROM p GROUP BY 1) s USING (label) LEFT JOIN (SELECT gold AS label, count(*) AS tp FROM p WHERE gold = pred GROUP BY 1) x USING (label)))"""
#: Predictions of the nearest class mean, at each stage among the classes of the tasks so far.
STAGED = LABELS + """,
v AS (SELECT vec_id AS row_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL),
pm AS (SELECT label, d, avg(e) AS m FROM (SELECT label, unnest(x) AS e, generate_subscripts(x, 1) AS d FROM v) GROUP BY 1, 2),
pr AS (SELECT label, list(m ORDER BY d) AS p FROM pm GROUP BY 1),
cs AS (SELECT v.row_id, pr.label AS proto, CASE WHEN pr.label <= 2 THEN 0 WHEN pr.label <= 5 THEN 1 ELSE 2 END AS ptask, round(list_dot_product(v.x, pr.p) / sqrt(list_dot_product(v.x, v.x)) / sqrt(list_dot_product(pr.p, pr.p)), 9) AS cos FROM v, pr),
sp AS (SELECT row_id, stage, proto AS pred FROM (SELECT row_id, CAST(g.s AS INT) AS stage, proto, row_number() OVER (PARTITION BY row_id, g.s ORDER BY cos DESC, proto) AS rn FROM cs JOIN range(0, 3) g(s) ON ptask <= g.s) WHERE rn = 1),
ps AS (SELECT sp.row_id, sp.stage, sp.pred, l.gold, l.task FROM sp JOIN l USING (row_id)),
r AS (SELECT stage AS t, task AS j, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS v FROM ps WHERE task <= stage GROUP BY 1, 2)"""


def _pred(spark, sf_dir):
    return base.labels(spark, sf_dir).select("gold", F.col("teacher").alias("pred"), "task")


def _inter(spark, sf_dir):
    return labels.intersection(base.labels(spark, sf_dir), KEPT)


def _staged(spark, sf_dir):
    v = base.vectors(spark, sf_dir)
    tasks = spark.createDataFrame([(c, 0 if c <= 2 else 1 if c <= 5 else 2) for c in range(10)], "label int, task int")
    p = vectors.staged_predictions(v, vectors.prototypes(v), tasks, ["row_id"])
    return p.join(base.labels(spark, sf_dir).select("row_id", "gold", "task"), "row_id")


def _r(spark, sf_dir):
    return metrics.r_matrix(_staged(spark, sf_dir), []).withColumn("run", F.lit("a"))


# --- conditions and splits

@query("SELECT row_id, gold, teacher FROM i", INTER)
def intersection_rows(spark, sf_dir):
    return _inter(spark, sf_dir).select("row_id", "gold", "teacher")


@query(f"SELECT row_id, CASE WHEN gold IN {_KEPT} THEN gold + 10 ELSE -1 END AS head_gold, gold = teacher AS teacher_correct FROM l", LABELS)
def label_recode(spark, sf_dir):
    head = spark.createDataFrame([(k, k + 10) for k in KEPT], "relation int, head_index int")
    return labels.recode(base.labels(spark, sf_dir), "gold", head, "head_gold").select("row_id", "head_gold", (F.col("gold") == F.col("teacher")).alias("teacher_correct"))


@query("SELECT row_id, gold AS first_gold FROM l WHERE row_id % 3 <> 0", LABELS)
def multilabel_drop(spark, sf_dir):
    rows = base.labels(spark, sf_dir).withColumn("golds", F.array_distinct(F.array(F.col("gold").cast("string"), F.col("teacher").cast("string"))))
    return rows.where(~fx.is_multilabel("golds")).select("row_id", fx.gold_label("golds").cast("int").alias("first_gold"))


@query("""SELECT a.row_id, a.gold, b.teacher AS label FROM (SELECT row_id, gold, row_number() OVER (PARTITION BY gold ORDER BY row_id) AS rn FROM i) a
JOIN (SELECT gold, teacher, row_number() OVER (PARTITION BY gold ORDER BY md5('1234|' || row_id), row_id) AS rn FROM i) b USING (gold, rn)""", INTER)
def perm_within_class(spark, sf_dir):
    return labels.permute_within_class(_inter(spark, sf_dir), 1234)


@query("""SELECT row_id, gold, CAST(CASE WHEN rn <= (SELECT round_even(count(*) * (1 - avg(CASE WHEN gold = teacher THEN 1.0 ELSE 0.0 END)), 0) FROM i)
  THEN (gold + 1 + CAST('0x' || substr(md5('1235|' || row_id), 1, 8) AS BIGINT) % 6) % 7 ELSE gold END AS INT) AS label FROM (SELECT *, row_number() OVER (ORDER BY md5('1234|' || row_id), row_id) AS rn FROM i)""", INTER)
def random_flip(spark, sf_dir):
    return labels.random_flip(_inter(spark, sf_dir), 1234, 7)


@query("SELECT row_id, gold FROM (SELECT *, row_number() OVER (ORDER BY md5('7|' || row_id), row_id) AS rn FROM l) WHERE rn <= 100", LABELS)
def uniform_subset(spark, sf_dir):
    return labels.uniform_subset(base.labels(spark, sf_dir).select("row_id", "gold"), 100, 7)


@query("""SELECT label, CAST(sum(g) AS BIGINT) AS gold_n, CAST(sum(t) AS BIGINT) AS teacher_n, CASE WHEN label = 9 THEN 'excluded' WHEN sum(g) < 50 AND sum(t) < 50 THEN 'rare in both' WHEN sum(g) < 50 THEN 'rare in gold' WHEN sum(t) < 50 THEN 'rare in teacher' END AS reason
FROM (SELECT gold AS label, 1 AS g, 0 AS t FROM l UNION ALL SELECT teacher, 0, 1 FROM l) GROUP BY label""", LABELS)
def viable_classes(spark, sf_dir):
    return labels.viable_classes(base.labels(spark, sf_dir).select("gold", "teacher"), 50, (9,))


@query("SELECT task, count(*) AS rows, count(DISTINCT gold) AS classes FROM l GROUP BY task", LABELS)
def task_slices(spark, sf_dir):
    return base.labels(spark, sf_dir).groupBy("task").agg(F.count("*").alias("rows"), F.count_distinct("gold").alias("classes"))


@query("SELECT CAST(g.s AS INT) AS stage, string_agg(DISTINCT CAST(gold AS VARCHAR), ',' ORDER BY CAST(gold AS VARCHAR)) AS seen FROM l JOIN range(0, 3) g(s) ON task <= g.s GROUP BY 1", LABELS)
def seen_classes(spark, sf_dir):
    c = base.labels(spark, sf_dir).select("task", "gold").distinct()
    rows = c.select(F.explode(F.sequence(F.col("task"), F.lit(2))).alias("stage"), F.col("gold").cast("string").alias("gold"))
    return rows.groupBy("stage").agg(F.array_join(F.array_sort(F.collect_set("gold")), ",").alias("seen"))


@query("SELECT gold AS head_index, CAST(2 - task AS INT) AS task, task AS new_task FROM (SELECT DISTINCT gold, task FROM l)", LABELS)
def task_renumber(spark, sf_dir):
    split = base.labels(spark, sf_dir).select(F.col("gold").alias("head_index"), (2 - F.col("task")).cast("int").alias("task")).distinct()
    return labels.renumber(split).select("head_index", "task", "new_task")


_SPLIT = LABELS + ", s AS (SELECT CAST(gold AS VARCHAR) AS relation, task FROM l WHERE gold <> 5 UNION SELECT CAST(teacher AS VARCHAR), task FROM l WHERE row_id % 97 = 0 AND teacher <> 5), c AS (SELECT DISTINCT CAST(gold AS VARCHAR) AS relation FROM l WHERE gold <> 8)"


@query("SELECT 'in two tasks' AS problem, relation FROM s GROUP BY relation HAVING count(DISTINCT task) > 1 UNION ALL SELECT 'in no task', relation FROM c ANTI JOIN s USING (relation) UNION ALL SELECT DISTINCT 'unknown', relation FROM s ANTI JOIN c USING (relation)", _SPLIT)
def split_check(spark, sf_dir):
    """A split made of gold classes but one, and of teacher classes that stray into other tasks, against the classes but one."""
    rows = base.labels(spark, sf_dir)
    pick = lambda c, df: df.where(F.col(c) != 5).select(F.col(c).cast("string").alias("relation"), "task")
    split = pick("gold", rows).union(pick("teacher", rows.where("row_id % 97 = 0"))).distinct()
    return labels.check_split(split, rows.where("gold <> 8").select(F.col("gold").cast("string").alias("relation")).distinct())


@query("""SELECT stratum, size, low + CASE WHEN row_number() OVER (ORDER BY round(quota - low, 9) DESC, stratum) <= 50 - sum(low) OVER () THEN 1 ELSE 0 END AS seats FROM (
  SELECT stratum, size, size * 50.0::DOUBLE / sum(size) OVER () AS quota, CAST(floor(size * 50.0::DOUBLE / sum(size) OVER ()) AS BIGINT) AS low FROM (SELECT quality * 2 + toxic AS stratum, count(*) AS size FROM labels GROUP BY 1))""")
def largest_remainder_allocation(spark, sf_dir):
    strata = table(spark, sf_dir, "labels").groupBy((F.col("quality") * 2 + F.col("toxic")).alias("stratum")).agg(F.count("*").alias("size"))
    return labels.largest_remainder(strata, 50)


@query("""SELECT row_id, stratum FROM (SELECT doc_id AS row_id, quality * 2 + toxic AS stratum, row_number() OVER (PARTITION BY quality * 2 + toxic ORDER BY md5('3|' || doc_id), doc_id) AS rn FROM labels)
JOIN (SELECT stratum, low + CASE WHEN row_number() OVER (ORDER BY round(quota - low, 9) DESC, stratum) <= 50 - sum(low) OVER () THEN 1 ELSE 0 END AS seats FROM (
  SELECT stratum, size * 50.0::DOUBLE / sum(size) OVER () AS quota, CAST(floor(size * 50.0::DOUBLE / sum(size) OVER ()) AS BIGINT) AS low FROM (SELECT quality * 2 + toxic AS stratum, count(*) AS size FROM labels GROUP BY 1))) USING (stratum) WHERE rn <= seats""")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("quality") * 2 + F.col("toxic")).alias("stratum"))
    return labels.stratified_sample(rows, 50, 3)


@query("""SELECT draw, row_id, label FROM (SELECT d.draw, k.label, d.u % k.size AS place FROM (SELECT i AS draw, CAST('0x' || substr(md5('5-label|' || i), 1, 12) AS BIGINT) % (SELECT count(DISTINCT gold) FROM l) AS k, CAST('0x' || substr(md5('5-row|' || i), 1, 12) AS BIGINT) AS u FROM range(0, 1000) r(i)) d
  JOIN (SELECT gold AS label, count(*) AS size, row_number() OVER (ORDER BY gold) - 1 AS k FROM l GROUP BY 1) k USING (k)) JOIN (SELECT row_id, gold AS label, row_number() OVER (PARTITION BY gold ORDER BY row_id) - 1 AS place FROM l) USING (label, place)""", LABELS)
def balanced_sampler(spark, sf_dir):
    return labels.balanced_draws(base.labels(spark, sf_dir).select("row_id", F.col("gold").alias("label")), 1000, 5)


@query("SELECT 'drawn' AS side, row_id, teacher AS label FROM l WHERE teacher <> gold UNION ALL SELECT 'saved', row_id, gold FROM l WHERE teacher <> gold", LABELS)
def condition_replay(spark, sf_dir):
    from ..sources.runs import condition_difference

    rows = base.labels(spark, sf_dir)
    return condition_difference(rows.select("row_id", F.col("teacher").alias("label")), rows.select("row_id", F.col("gold").alias("label")))


# --- classification metrics

@query("SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL", PRED)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_pred(spark, sf_dir), [])


@query("SELECT gold, pred, n, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share FROM (SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL)", PRED)
def row_normalised_confusion(spark, sf_dir):
    return metrics.row_normalised(metrics.confusion(_pred(spark, sf_dir), []), []).withColumn("share", F.round("share", 6))


@query("""SELECT gold, coalesce(max(n) FILTER (WHERE gold = pred), 0) AS diagonal, max(n) FILTER (WHERE gold <> pred) AS off_n, CAST(max(n * 100 + pred) FILTER (WHERE gold <> pred) % 100 AS INT) AS off_label,
  coalesce(max(n) FILTER (WHERE gold = pred), 0) >= coalesce(max(n) FILTER (WHERE gold <> pred), 0) AS dominant FROM (SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL) GROUP BY gold""", PRED)
def diag_vs_rowmax(spark, sf_dir):
    return metrics.diagonal_check(metrics.confusion(_pred(spark, sf_dir), []), [])


@query("SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f", PRED + ", " + _F1)
def per_class_f1(spark, sf_dir):
    f = metrics.class_f1(_pred(spark, sf_dir), [])
    return f.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT round(avg(f1), 6) AS macro_f1 FROM f", PRED + ", " + _F1)
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(_pred(spark, sf_dir), []).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("SELECT task, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM p GROUP BY task", PRED)
def accuracy(spark, sf_dir):
    return metrics.accuracy(_pred(spark, sf_dir), ["task"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT round(max(n) / sum(n), 6) AS majority_accuracy FROM (SELECT count(*) AS n FROM labels GROUP BY quality)")
def majority_accuracy(spark, sf_dir):
    return metrics.majority_accuracy(table(spark, sf_dir, "labels"), "quality").select(F.round("majority_accuracy", 6).alias("majority_accuracy"))


@query("SELECT label, CAST(d - 1 AS INT) AS d, round(m, 6) AS m FROM pm", STAGED)
def prototypes(spark, sf_dir):
    p = vectors.prototypes(base.vectors(spark, sf_dir))
    return p.select("label", F.posexplode("p").alias("d", "m")).withColumn("m", F.round("m", 6))


@query("SELECT row_id, proto, round(cos, 6) AS cos, round(exp(c / 0.5) / sum(exp(c / 0.5)) OVER (PARTITION BY row_id), 6) AS weight FROM (SELECT v.row_id, pr.label AS proto, list_dot_product(v.x, pr.p) / sqrt(list_dot_product(v.x, v.x)) / sqrt(list_dot_product(pr.p, pr.p)) AS c, round(c, 6) AS cos FROM v, pr)", STAGED)
def proto_similarity(spark, sf_dir):
    v = base.vectors(spark, sf_dir)
    out = vectors.similarities(v, vectors.prototypes(v), ["row_id"], 0.5)
    return out.select("row_id", "proto", F.round("cos", 6).alias("cos"), F.round("weight", 6).alias("weight"))


@query("SELECT row_id, pred FROM sp WHERE stage = 2", STAGED)
def nearest_proto_predict(spark, sf_dir):
    v = base.vectors(spark, sf_dir)
    return vectors.nearest(v, vectors.prototypes(v), ["row_id"])


# --- continual learning

@query("SELECT t, j, v FROM r", STAGED)
def r_matrix(spark, sf_dir):
    return _r(spark, sf_dir).select("t", "j", "v")


@query("SELECT round(avg(v) FILTER (WHERE t = 2), 6) AS acc, round((SELECT avg(a.v - b.v) FROM r a JOIN r b ON a.t = 2 AND b.t = b.j AND a.j = b.j AND a.j < 2), 6) AS bwt FROM r", STAGED)
def acc_bwt(spark, sf_dir):
    r = _r(spark, sf_dir)
    return metrics.acc(r, ["run"]).join(metrics.bwt(r, ["run"]), "run").select(F.round("acc", 6).alias("acc"), F.round("bwt", 6).alias("bwt"))


@query("SELECT a.j, round(a.v - b.v, 6) AS forgetting, a.v < b.v AS forgot FROM r a JOIN r b ON a.t = 2 AND b.t = b.j AND a.j = b.j AND a.j < 2", STAGED)
def forgetting(spark, sf_dir):
    return metrics.forgetting(_r(spark, sf_dir), ["run"]).select("j", F.round("forgetting", 6).alias("forgetting"), "forgot")


@query("SELECT t, round(avg(v), 6) AS acc FROM r GROUP BY t", STAGED)
def acc_after_task(spark, sf_dir):
    return metrics.acc_after(_r(spark, sf_dir), ["run"]).select("t", F.round("acc", 6).alias("acc"))


@query("SELECT stage, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM ps WHERE task <= stage GROUP BY stage", STAGED)
def observed_accuracy(spark, sf_dir):
    return metrics.observed_accuracy(_staged(spark, sf_dir), []).withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT round(b, 6) AS bwt, round(d, 6) AS mean_diag, abs(b + d) <= 0.001 AS degenerate FROM (SELECT (SELECT avg(a.v - c.v) FROM r a JOIN r c ON a.t = 2 AND c.t = c.j AND a.j = c.j AND a.j < 2) AS b, (SELECT avg(v) FROM r WHERE t = j AND j < 2) AS d)""", STAGED)
def bwt_degeneracy(spark, sf_dir):
    return metrics.bwt_degenerate(_r(spark, sf_dir), ["run"]).select(F.round("bwt", 6).alias("bwt"), F.round("mean_diag", 6).alias("mean_diag"), "degenerate")


@query("SELECT t, j, v FROM r WHERE t = j AND v < 0.99 - 0.15", STAGED)
def diagonal_warnings(spark, sf_dir):
    return metrics.diagonal_warnings(_r(spark, sf_dir), spark.createDataFrame([("a", 0.99)], "run string, joint double"), ["run"]).select("t", "j", "v")


_CELLS = "c AS (SELECT event_type AS run, CAST(day(ts) % 3 AS INT) AS t, CAST(hour(ts) % 3 AS INT) AS j, avg(value) / 50 AS v FROM events WHERE NOT (event_type IN ('click', 'view') AND day(ts) % 3 = 2 AND hour(ts) % 3 = 0) GROUP BY ALL)"


@query("""SELECT run, t, j, 'above the diagonal' AS problem FROM c WHERE j > t UNION ALL SELECT run, t, j, 'out of range' FROM c WHERE v < 0 OR v > 1
UNION ALL SELECT run, t, j, 'missing' FROM (SELECT run, t, j FROM (SELECT DISTINCT run FROM c), (SELECT CAST(unnest([0, 1, 1, 2, 2, 2]) AS INT) AS t, CAST(unnest([0, 0, 1, 0, 1, 2]) AS INT) AS j)) ANTI JOIN c USING (run, t, j)""", _CELLS)
def r_matrix_validation(spark, sf_dir):
    e, t, j = table(spark, sf_dir, "events"), F.dayofmonth("ts") % 3, F.hour("ts") % 3
    cells = e.where(~(F.col("event_type").isin("click", "view") & (t == 2) & (j == 0))).groupBy(F.col("event_type").alias("run"), t.cast("int").alias("t"), j.cast("int").alias("j")).agg((F.avg("value") / 50).alias("v"))
    return metrics.r_problems(cells, ["run"], 3)


@query("SELECT label, gold_n, teacher_n, round(teacher_n / gold_n, 6) AS ratio FROM (SELECT label, CAST(sum(g) AS BIGINT) AS gold_n, CAST(sum(t) AS BIGINT) AS teacher_n FROM (SELECT gold AS label, 1 AS g, 0 AS t FROM l UNION ALL SELECT teacher, 0, 1 FROM l) GROUP BY 1) WHERE gold_n > 0 ORDER BY teacher_n / gold_n DESC, label LIMIT 1", LABELS)
def broad_class(spark, sf_dir):
    return metrics.broad_class(base.labels(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT task, round(avg(CASE WHEN pred = 4 THEN 1.0 ELSE 0.0 END), 6) AS share FROM p GROUP BY task", PRED)
def broad_class_share(spark, sf_dir):
    return metrics.share_of(_pred(spark, sf_dir), 4, ["task"]).withColumn("share", F.round("share", 6))


@query("""SELECT task, rows, impure, round(1 - impure / rows, 6) AS purity, round(1 - sum(impure) OVER w / sum(rows) OVER w, 6) AS cum_purity FROM (SELECT task, count(*) AS rows, CAST(count(*) FILTER (WHERE gold <> teacher) AS BIGINT) AS impure FROM l GROUP BY 1) WINDOW w AS (ORDER BY task)""", LABELS)
def buffer_purity(spark, sf_dir):
    m = metrics.buffer_purity(base.labels(spark, sf_dir).withColumn("label", F.col("teacher")), [])
    return m.withColumn("purity", F.round("purity", 6)).withColumn("cum_purity", F.round("cum_purity", 6))


@query(f"""SELECT CAST(count(*) FILTER (WHERE g AND t) AS BIGINT) AS both, CAST(count(*) FILTER (WHERE g AND NOT t) AS BIGINT) AS gold_only, CAST(count(*) FILTER (WHERE NOT g AND t) AS BIGINT) AS teacher_only, CAST(count(*) FILTER (WHERE NOT g AND NOT t) AS BIGINT) AS neither,
  round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) FILTER (WHERE g AND t), 6) AS agree_both, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS agree_all FROM (SELECT gold IN {_KEPT} AS g, teacher IN {_KEPT} AS t, gold = teacher AS same FROM l)""", LABELS)
def noise_breakdown(spark, sf_dir):
    out = metrics.noise_breakdown(base.labels(spark, sf_dir), KEPT)
    return out.withColumn("agree_both", F.round("agree_both", 6)).withColumn("agree_all", F.round("agree_all", 6))


@query("""SELECT task, CAST(sum(n) AS BIGINT) AS rows, round(sum(x) / sum(n), 6) AS noise_rate, CAST(coalesce(sum(n) FILTER (WHERE label = 4), 0) AS BIGINT) AS broad_rows, coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FILTER (WHERE n < 20), '') AS thin_classes
FROM (SELECT task, teacher AS label, count(*) AS n, count(*) FILTER (WHERE teacher <> gold) AS x FROM l GROUP BY 1, 2) GROUP BY task""", LABELS)
def condition_stats(spark, sf_dir):
    out = metrics.condition_stats(base.labels(spark, sf_dir).withColumn("label", F.col("teacher")), ["task"], 4, 20)
    return out.withColumn("noise_rate", F.round("noise_rate", 6))


_GRID = """g AS (SELECT event_type AS condition, CAST(user_id % 3 AS INT) AS seed, CAST(day(ts) % 3 AS INT) AS replicate, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS regime, round(avg(value) / 10, 6) AS v FROM events GROUP BY ALL),
d AS (SELECT condition, seed, replicate, round(max(v) FILTER (WHERE regime = 'a') - max(v) FILTER (WHERE regime = 'b'), 6) AS d FROM g GROUP BY 1, 2, 3)"""


def _grid(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    regime = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    return e.groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 3).cast("int").alias("seed"), (F.dayofmonth("ts") % 3).cast("int").alias("replicate"), regime.alias("regime")).agg(F.round(F.avg("value") / 10, 6).alias("v"))


def _pairs(spark, sf_dir):
    return metrics.paired_difference(_grid(spark, sf_dir), ["condition", "seed", "replicate"], "regime", "a", "b", "v").withColumn("d", F.round("d", 6))


@query("SELECT condition, seed, replicate, d FROM d WHERE d IS NOT NULL", _GRID)
def paired_difference(spark, sf_dir):
    return _pairs(spark, sf_dir).select("condition", "seed", "replicate", "d")


@query("SELECT condition, regime, min(v) AS low, max(v) AS high, round(max(v) - min(v), 6) AS spread FROM g GROUP BY ALL", _GRID)
def replicate_spread(spark, sf_dir):
    return metrics.spread(_grid(spark, sf_dir), ["condition", "regime"], "v").withColumn("spread", F.round("spread", 6))


@query("""SELECT condition, CASE WHEN count(*) FILTER (WHERE sign = 1) >= 2 THEN 'real-positive' WHEN count(*) FILTER (WHERE sign = -1) >= 2 THEN 'real-negative' ELSE 'none' END AS direction FROM (
  SELECT condition, seed, CASE WHEN max(abs(d)) FILTER (WHERE replicate = 0) <= 0.03 THEN 0 WHEN min(d) > 0 THEN 1 WHEN max(d) < 0 THEN -1 ELSE 0 END AS sign FROM d GROUP BY 1, 2) GROUP BY condition""", _GRID)
def replicate_direction(spark, sf_dir):
    return metrics.direction(metrics.real_sign(_pairs(spark, sf_dir), ["condition", "seed"]), ["condition"])


@query("""SELECT label, task, round(max(f) FILTER (WHERE stage = task), 6) AS first_f1, round(max(f) FILTER (WHERE stage = 2), 6) AS final_f1, round(max(f) FILTER (WHERE stage = task) - max(f) FILTER (WHERE stage = 2), 6) AS drop FROM (
  SELECT a.stage, a.label, a.task, CASE WHEN a.tp = 0 THEN 0.0 ELSE 2.0 * a.tp / (a.n + coalesce(b.said, 0)) END AS f FROM (SELECT stage, gold AS label, task, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS tp FROM ps WHERE task <= stage GROUP BY 1, 2, 3) a
  LEFT JOIN (SELECT stage, pred AS label, count(*) AS said FROM ps WHERE task <= stage GROUP BY 1, 2) b ON a.stage = b.stage AND a.label = b.label) GROUP BY 1, 2""", STAGED)
def class_drops(spark, sf_dir):
    s = _staged(spark, sf_dir).where("task <= stage")
    f = metrics.class_f1(s, ["stage"]).join(F.broadcast(s.select(F.col("gold").alias("label"), "task").distinct()), "label")
    out = metrics.class_drops(f, [])
    return out.select("label", "task", *[F.round(c, 6).alias(c) for c in ("first_f1", "final_f1", "drop")])


@query("""SELECT user_id, CAST(max(epoch) FILTER (WHERE epoch = best_ep) AS BIGINT) AS best_epoch, max(best_v) AS best_score, max(epoch) AS stop_epoch FROM (
  SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY user_id) AS best_ep, max(value) OVER (PARTITION BY user_id) AS best_v FROM (
    SELECT *, coalesce(min(CASE WHEN epoch - lastb >= 5 THEN epoch END) OVER (PARTITION BY user_id), 1000000) AS stop FROM (
      SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS lastb FROM (
        SELECT *, before IS NULL OR value > before AS better FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events))))) WHERE epoch <= stop) GROUP BY user_id""")
def best_epoch_early_stop(spark, sf_dir):
    from pyspark.sql import Window

    log = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("epoch"))
    return windows.early_stop(log, ["user_id"], "epoch", "value")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def latest_run(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


# --- iterative operators: no SQL counterpart

@query()
def kmeans_memory(spark, sf_dir):
    return vectors.kmeans_memory(base.vectors(spark, sf_dir), 10, 1234)


def _training(spark, sf_dir):
    v = base.vectors(spark, sf_dir)
    k = F.pmod(F.xxhash64("row_id", F.lit(5)), F.lit(10))
    part = F.when(k < 6, "train").when(k < 8, "dev").otherwise("test")
    return v.select("row_id", part.alias("part"), F.col("x"), F.col("label").alias("y"))


@query()
def student_train(spark, sf_dir):
    """Joint training of the student on all classes at once; accuracy on the test part."""
    grid = spark.createDataFrame([(f"joint-{s}", "naive", s) for s in schema.TRAINING["seeds"]], "run_id string, regime string, seed int")
    pred = trainer.train_runs(_training(spark, sf_dir), grid, [list(range(10))])
    return metrics.accuracy(pred, ["run_id", "stage"])


@query()
def replay_regime(spark, sf_dir):
    """Naive, replay and distillation runs over three tasks; accuracy after each on the test part."""
    grid = spark.createDataFrame([(f"{r}-{s}", r, s) for r in ("naive", "replay", "fkd", "kd") for s in schema.TRAINING["seeds"]], "run_id string, regime string, seed int")
    pred = trainer.train_runs(_training(spark, sf_dir), grid, [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]])
    return metrics.accuracy(pred, ["run_id", "stage"])


@query()
def task_split_search(spark, sf_dir):
    """Hill climbing over class-to-task maps on the label counts of both tracks."""
    rows = base.labels(spark, sf_dir)
    counts = [{int(r[0]): int(r[1]) for r in rows.groupBy(c).count().collect()} for c in ("gold", "teacher")]  # a row a class
    split = labels.search_split(counts)
    return spark.createDataFrame(sorted(split.items()), "label int, task int")
