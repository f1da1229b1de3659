"""Queries of label conditions, teacher labelling, run payloads and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import conditions, graph, metrics, resolve, stats, trainer, triples, vectors
from . import base, reports
from .base import LABELS, TRIPLES, query, table
from .graph_queries import ENDS, _edges
from .label_queries import INTER, KEPT, STAGED, _training
from .report_queries import _RUNS, _runs

@query("""SELECT condition, CAST(seed AS INT) AS seed, CAST(replicate AS INT) AS replicate, CAST(CASE WHEN replicate <> 0 THEN seed + 100 * replicate END AS INT) AS init_seed, CAST(CASE WHEN condition IN ('perm_I', 'rand_I', 'gold_sub') THEN seed + 100 * replicate END AS INT) AS draw_seed, condition || '/seed' || seed || '/r' || replicate AS path
FROM (SELECT r_regionkey AS seed FROM region) s, (VALUES ('gold_I'), ('teacher_I'), ('perm_I'), ('rand_I'), ('gold_sub')) c(condition), range(3) r(replicate) WHERE replicate = 0 OR condition NOT IN ('gold_I', 'teacher_I')""")
def condition_grid(spark, sf_dir):
    """The seeds are the keys of a table."""
    return conditions.condition_grid(spark, [int(r.r_regionkey) for r in table(spark, sf_dir, "region").select("r_regionkey").collect()])  # a sweep's few seeds


@query("SELECT 'gold' AS condition, row_id, gold, gold AS label FROM l WHERE gold IN (0, 1, 2, 3, 4, 5, 6) UNION ALL SELECT 'teacher', row_id, gold, teacher FROM l WHERE teacher IN (0, 1, 2, 3, 4, 5, 6) UNION ALL SELECT 'gold_I', row_id, gold, gold FROM i UNION ALL SELECT 'teacher_I', row_id, gold, teacher FROM i", INTER)
def condition_train_rows(spark, sf_dir):
    rows = base.labels(spark, sf_dir)
    out = None
    for c in ("gold", "teacher", "gold_I", "teacher_I"):
        one = conditions.train_rows(rows, c, KEPT).select(F.lit(c).alias("condition"), "row_id", "gold", "label")
        out = one if out is None else out.union(one)
    return out


@query("SELECT c.condition, (SELECT count(*) FROM i) AS n, CASE WHEN c.condition = 'rand_I' THEN CAST(round_even((SELECT count(*) - count(*) FILTER (WHERE gold = teacher) FROM i), 0) AS BIGINT) WHEN c.condition = 'perm_I' THEN (SELECT count(*) FILTER (WHERE gold <> teacher) FROM i) ELSE 0 END AS changed_or_noisy FROM (VALUES ('perm_I'), ('rand_I'), ('gold_sub')) c(condition) WHERE c.condition <> 'perm_I'", INTER)
def condition_draw_sizes(spark, sf_dir):
    """Rows and changed labels of the drawn conditions: rand_I flips exactly as many as the tracks differ in."""
    rows, out = base.labels(spark, sf_dir), None
    for c in ("rand_I", "gold_sub"):
        d = conditions.train_rows(rows, c, KEPT, 1234)
        one = d.agg(F.lit(c).alias("condition"), F.count("*").alias("n"), F.count_if(F.col("label") != F.col("gold")).alias("changed_or_noisy"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT dialogue, index, relation, teacher_correct FROM (SELECT p.dialogue, p.index, a.relation, p.gold = a.relation AS teacher_correct, p.k FROM p JOIN (SELECT dialogue, index, max_by(relation, pos) AS relation FROM a WHERE relation IN ('click', 'view', 'purchase') GROUP BY ALL) a USING (dialogue, index)) WHERE k <> 0",
       "p AS (SELECT DISTINCT CAST(ts AS DATE) AS dialogue, user_id % 10 AS index, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END AS gold, user_id % 10 AS k FROM events), a AS (SELECT CAST(ts AS DATE) AS dialogue, event_id AS pos, user_id % 10 AS index, event_type AS relation FROM events)")
def teacher_labelling(spark, sf_dir):
    """Pairs of index 0 have two gold labels, so they go after the teacher has answered."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("dialogue"), F.col("event_id").alias("pos"), (F.col("user_id") % 10).alias("index"), F.col("event_type").alias("relation"), (F.col("user_id") % 2).alias("odd"))
    gold = F.when(F.col("index") == 0, F.array(F.lit("click"), F.lit("view"))).when(F.col("odd") == 0, F.array(F.lit("click"))).otherwise(F.array(F.lit("view")))
    pairs = e.select("dialogue", "index", gold.alias("gold_relations")).distinct()
    return conditions.teacher_rows(pairs, e, ["click", "view", "purchase"])[0].select("dialogue", "index", "relation", "teacher_correct")


@query("SELECT relation, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'absent' WHEN n < 20 THEN 'thin' ELSE 'used' END AS state FROM (SELECT unnest(['discussed', 'reports_to', 'approved', 'assigned_to', 'heads', 'teaches']) AS relation) LEFT JOIN (SELECT relation, count(*) AS n FROM t WHERE source_meeting LIKE '%01' OR relation <> 'assigned_to' GROUP BY 1) USING (relation)", TRIPLES)
def label_distribution(spark, sf_dir):
    legal = spark.createDataFrame([(x,) for x in ("discussed", "reports_to", "approved", "assigned_to", "heads", "teaches")], "relation string")
    t = base.triples(spark, sf_dir).where("source_meeting LIKE '%01' OR relation <> 'assigned_to'")
    return conditions.label_distribution(t, "relation", legal)


@query("""SELECT track, seed, round(avg(e), 6) AS s_entropy_frac, round(avg(m), 6) AS s_max_over_uniform, round(avg(r0), 6) AS loss_ratio_first, round(avg(r1), 6) AS loss_ratio_last, round(avg(f0), 6) AS focal_first, round(avg(f1), 6) AS focal_last FROM (
  SELECT track, seed, task, max(entropy / 2.5) AS e, max(row_max / 0.25) AS m, min_by(fkd / cls, epoch) AS r0, max_by(fkd / cls, epoch) AS r1, min_by(focal, epoch) AS f0, max_by(focal, epoch) AS f1 FROM d GROUP BY ALL) GROUP BY ALL""",
       "d AS (SELECT event_type AS track, CAST(user_id % 3 AS INT) AS seed, CAST(day(ts) % 3 AS INT) AS task, event_id AS epoch, value / 100 AS focal, value AS fkd, value + event_id AS cls, (user_id % 7) / 7.0::DOUBLE AS entropy, (user_id % 5) / 5.0::DOUBLE AS row_max FROM events)")
def fkd_diagnostics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    d = e.select(F.col("event_type").alias("track"), (user % 3).cast("int").alias("seed"), (F.dayofmonth("ts") % 3).cast("int").alias("task"), F.col("event_id").alias("epoch"), (F.col("value") / 100).alias("focal"), F.col("value").alias("fkd"), (F.col("value") + F.col("event_id")).alias("cls"), ((user % 7) / 7.0).alias("entropy"), F.lit(2.5).alias("uniform_entropy"), ((user % 5) / 5.0).alias("row_max"), F.lit(0.25).alias("uniform_max"))
    out = conditions.diagnostics_summary(d, ["track", "seed"])
    return out.select("track", "seed", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("SELECT track, regime, seed, round(avg(v) FILTER (WHERE t = 2), 6) AS acc, round((SELECT avg(f) FROM fg WHERE fg.track = q.track AND fg.regime = q.regime AND fg.seed = q.seed), 6) AS bwt, list(v ORDER BY t, j) AS cells FROM q GROUP BY ALL", _RUNS)
def run_payload(spark, sf_dir):
    r = _runs(spark, sf_dir).withColumn("metric", F.lit("f1"))
    p = conditions.run_payload(r, ["track", "regime", "seed"])
    return p.select("track", "regime", "seed", F.round("ACC_f1", 6).alias("acc"), F.round("BWT_f1", 6).alias("bwt"), F.flatten("R_f1").alias("cells"))


@query("SELECT track AS condition, regime, max(acc) FILTER (WHERE seed = 1) AS acc_1, max(acc) FILTER (WHERE seed = 2) AS acc_2, max(m) FILTER (WHERE seed = 1) AS forgetting_1, max(m) FILTER (WHERE seed = 2) AS forgetting_2, max(last) FILTER (WHERE seed = 1) AS final_1, max(last) FILTER (WHERE seed = 2) AS final_2 FROM (SELECT am.track, am.regime, am.seed, round(acc, 6) AS acc, round(f, 6) AS m, round(v, 6) AS last FROM am JOIN fg ON am.track = fg.track AND am.regime = fg.regime AND am.seed = fg.seed AND fg.j = 1 JOIN q ON am.track = q.track AND am.regime = q.regime AND am.seed = q.seed AND q.t = 2 AND q.j = 2) GROUP BY ALL", _RUNS)
def continual_runs_report(spark, sf_dir):
    """ACC, forgetting of the one old task that is not degenerate (task 1), and the final score, by seed."""
    r, keys = _runs(spark, sf_dir), ["track", "regime", "seed"]
    f = metrics.forgetting(r, keys).where("j <> 0").groupBy(*keys).agg(F.avg("forgetting").alias("forgetting"))
    last = r.where("t = 2 AND j = 2").select(*keys, F.col("v").alias("final"))
    values = metrics.acc(r, keys).join(f, keys).join(last, keys).select(F.col("track").alias("condition"), "regime", "seed", *[F.round(c, 6).alias(c) for c in ("acc", "forgetting", "final")])
    return reports.continual_table(values)


@query("""SELECT round(avg(CASE WHEN proto = label THEN 1.0 ELSE 0.0 END) FILTER (WHERE rn = 1), 6) AS agreement, round(avg(w) FILTER (WHERE proto = label), 6) AS mean_p, round(median(w) FILTER (WHERE proto = label), 6) AS median_p, round((SELECT avg(h) FROM (SELECT row_id, -sum(w * ln(w)) / ln(count(*)) AS h FROM ww GROUP BY 1)), 6) AS entropy_frac
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(w, 9) DESC, proto) AS rn FROM ww)""",
       STAGED + ", ww AS (SELECT row_id, label, proto, exp(c / 0.5) / sum(exp(c / 0.5)) OVER (PARTITION BY row_id) AS w FROM (SELECT v.row_id, v.label, pr.label AS proto, list_dot_product(v.x, pr.p) / sqrt(list_dot_product(v.x, v.x)) / sqrt(list_dot_product(pr.p, pr.p)) AS c FROM v, pr))")
def target_agreement(spark, sf_dir):
    v = base.vectors(spark, sf_dir)
    s = vectors.similarities(v, vectors.prototypes(v), ["row_id", "label"], 0.5)
    out = conditions.target_agreement(s, ["row_id"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT row_id, gold, 'first' AS side FROM i WHERE row_id % 2 = 1 UNION ALL SELECT row_id, gold, 'second' FROM l WHERE gold IN (0, 1, 2, 3, 4, 5, 6) AND teacher NOT IN (0, 1, 2, 3, 4, 5, 6) AND row_id % 2 = 0", INTER)
def memory_equality(spark, sf_dir):
    """What two memories do not share: all common rows against the even rows of the gold track."""
    rows = base.labels(spark, sf_dir)
    a = conditions.train_rows(rows, "gold_I", KEPT).select("row_id", "gold")
    b = conditions.train_rows(rows, "gold", KEPT).where("row_id % 2 = 0").select("row_id", "gold")
    return conditions.difference(a, b)


@query("SELECT a.source_meeting AS a, b.source_meeting AS b, na.n AS n_a, nb.n AS n_b, (SELECT count(*) FROM ends x JOIN ends y USING (entity) WHERE x.source_meeting = a.source_meeting AND y.source_meeting = b.source_meeting) AS both FROM m a JOIN m b ON a.source_meeting <= b.source_meeting JOIN m na ON na.source_meeting = a.source_meeting JOIN m nb ON nb.source_meeting = b.source_meeting", ENDS + ", m AS (SELECT source_meeting, count(*) AS n FROM ends GROUP BY 1)")
def meeting_overlap_matrix(spark, sf_dir):
    """The matrix of meetings by common entities: its diagonal, and every pair, those without a common entity too."""
    return graph.meeting_overlap(_edges(spark, sf_dir), diagonal=True, every=True).select("a", "b", "n_a", "n_b", "both")


@query("SELECT source_meeting, kind, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY source_meeting, kind), 6) AS pct FROM (SELECT source_meeting, 'relation' AS kind, relation AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT source_meeting, 'type', ty, count(*) FROM (SELECT source_meeting, subject_type AS ty FROM t UNION ALL SELECT source_meeting, object_type FROM t) GROUP BY ALL)", TRIPLES)
def meeting_distributions(spark, sf_dir):
    return stats.meeting_distributions(base.triples(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query("SELECT count(*) AS total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS correct, count(*) FILTER (WHERE crossing) AS cross_total, CAST(count(*) FILTER (WHERE crossing AND ok) AS BIGINT) AS cross_correct FROM (SELECT contains(lower(text), 'th') AS ok, source IN ('src0', 'src1') AS crossing FROM documents)")
def qa_cross_score(spark, sf_dir):
    from ..functions import scalar as fx

    d = table(spark, sf_dir, "documents").select(fx.grade("text", [["th"]]).alias("ok"), F.col("source").isin("src0", "src1").alias("crossing"))
    return stats.qa_score(d, "ok", "crossing")


@query("SELECT row_id, 'm' || lpad(CAST(row_id % 7 AS VARCHAR), 2, '0') AS meeting, name, CASE WHEN name = 'skip' THEN NULL ELSE name || '!' END AS label FROM (SELECT row_id, CASE WHEN gold % 3 = 0 THEN 'skip' ELSE 'c' || gold END AS name FROM l)", LABELS)
def extractor_protocol(spark, sf_dir):
    """A plugged-in extractor runs over windows as a DataFrame function; failures become nulls."""
    rows = base.labels(spark, sf_dir).select("row_id", F.concat(F.lit("m"), F.lpad((F.col("row_id") % 7).cast("string"), 2, "0")).alias("meeting"), F.when(F.col("gold") % 3 == 0, "skip").otherwise(F.concat(F.lit("c"), F.col("gold").cast("string"))).alias("name"))

    def shout(name: str) -> str:
        if name == "skip":
            raise ValueError("no answer")
        return name + "!"

    return triples.extract_with(rows, shout, "name", "label")


@query("SELECT lower(p_name) AS name, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS spellings FROM part GROUP BY 1")
def canonical_by_key(spark, sf_dir):
    """Names meet their canonical whatever their case: how many spellings (one or more) a key has."""
    p = table(spark, sf_dir, "part")
    canon = p.select(F.lower("p_name").alias("canonical")).distinct()
    met = resolve.resolve_canonical(p.select(F.upper("p_name").alias("name")), canon)
    return met.groupBy(F.col("canonical").alias("name")).agg(F.when(F.count("*") > 1, 2).otherwise(1).alias("spellings"))


@query()
def joint_balanced(spark, sf_dir):
    """Joint training in which every epoch draws all classes alike; accuracy on the test part."""
    grid = spark.createDataFrame([(f"joint_balanced-{s}", "naive", s) for s in schema.TRAINING["seeds"]], "run_id string, regime string, seed int")
    pred = trainer.train_runs(_training(spark, sf_dir), grid, [list(range(10))], balanced=True)
    return metrics.accuracy(pred, ["run_id", "stage"])


@query("""SELECT am.track, am.regime, am.seed, round(acc, 6) AS acc, round(bwt, 6) AS bwt, forgotten, verdict, abs(bwt + diag) <= 0.001 AS degenerate FROM am
JOIN (SELECT track, regime, seed, avg(f) AS bwt, coalesce(string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) FILTER (WHERE f < 0), '') AS forgotten, CASE WHEN bool_and(f < 0) THEN 'all' WHEN bool_or(f < 0) THEN 'some' ELSE 'none' END AS verdict FROM fg GROUP BY track, regime, seed) USING (track, regime, seed)
JOIN (SELECT track, regime, seed, avg(v) AS diag FROM q WHERE t = j AND j < 2 GROUP BY ALL) USING (track, regime, seed)""", _RUNS)
def naive_report(spark, sf_dir):
    out = reports.naive_report(_runs(spark, sf_dir), ["track", "regime", "seed"])
    return out.withColumn("acc", F.round("acc", 6)).withColumn("bwt", F.round("bwt", 6))
