"""Queries of parsers, array expressions and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx
from ..operators import metrics, resolve, tagger, triples, vectors
from ..sources import transcripts
from . import base, reports
from .base import LABELS, TRIPLES, UTTERANCES, query, table, utterances
from .label_queries import STAGED, _r, _staged

_FIRST = "first AS (SELECT *, string_split(text, chr(10))[1] AS line FROM u)"
#: The lines of a whole turn, joined as the parsers join them.
_WHOLE = "whole AS (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS said, len(string_split(text, chr(10))) AS n FROM u)"


def _files(spark, sf_dir, block):
    parts = utterances(spark, sf_dir).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("bs"))
    return parts.select(F.col("meeting_id").cast("string").alias("stem"), F.array_join(F.transform("bs", lambda b: b["b"]), "\n").alias("content"))


@query("SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, seq, 'SPEAKER_' || (seq % 3) AS speaker_id, said AS text, 4.0::DOUBLE * seq AS start_time, 4.0::DOUBLE * seq + 0.5 AS end_time FROM whole", UTTERANCES + ", " + _WHOLE)
def parse_srt(spark, sf_dir):
    n = F.col("seq") * 4
    block = F.format_string("%d\r\n00:00:%02d,000 --> 00:00:%02d,500\r\n[SPEAKER_%d]: %s\r\n", F.col("seq") + 1, n, n, F.col("seq") % 3, F.col("text"))
    return transcripts.parse_srt(_files(spark, sf_dir, block), strict=False)


@query("""SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, seq, 'SPEAKER_0' || (seq % 3) AS speaker_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text, start_time, end_time FROM u""", UTTERANCES)
def parse_plain_transcript(spark, sf_dir):
    files = _files(spark, sf_dir, F.format_string("speaker_%d : %s", F.col("seq") % 3, F.col("text")))
    return transcripts.parse_text(files, strict=False)


@query("SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, seq, 'SPEAKER_0' || (seq % 3) AS speaker_id, trim(line) AS text, 3600.0::DOUBLE + seq AS start_time, 3601.5::DOUBLE + seq AS end_time FROM first", UTTERANCES + ", " + _FIRST)
def parse_legacy_transcript(spark, sf_dir):
    block = F.format_string("Speaker 0%d (1:00:%02d - 60:%02d.5): %s\nstray line", F.col("seq") % 3, F.col("seq"), F.col("seq") + 1, F.col("text"))
    return transcripts.parse_text(_files(spark, sf_dir, block), strict=False)


@query("SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, seq, CASE seq % 3 WHEN 0 THEN 'SPEAKER_A' WHEN 1 THEN 'SPEAKER_PM' ELSE 'SPEAKER_ID1' END AS speaker_id, said || ' Right: so' AS text, start_time, end_time FROM whole", UTTERANCES + ", " + _WHOLE)
def parse_ami_dialogue(spark, sf_dir):
    who = F.when(F.col("seq") % 3 == 0, "speaker a").when(F.col("seq") % 3 == 1, "PM").otherwise("ID1")
    files = _files(spark, sf_dir, F.concat(who, F.lit(": "), F.col("text"), F.lit("\nRight: so")))
    return transcripts.parse_ami(transcripts.lines_of(files))


@query("SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, CAST(coalesce(sum(n + 2) OVER (PARTITION BY meeting_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos, 'NAME ' || (seq % 3) AS speaker, said || ' more' AS text FROM whole", UTTERANCES + ", " + _WHOLE)
def parse_script(spark, sf_dir):
    out = transcripts.parse_script(_files(spark, sf_dir, F.format_string("NAME %d: %s\nmore\n---", F.col("seq") % 3, F.col("text"))))
    return out.withColumn("pos", F.col("pos").cast("int"))


@query("SELECT conv_id || '_' || lpad(CAST(0 AS VARCHAR), 4, '0') AS dialogue_id, CAST(turn AS INT) AS pair_index, role AS x, 'PER' AS x_type, CASE WHEN turn % 2 = 0 THEN 'per:friends' ELSE 'unanswerable' END AS gold FROM conversations WHERE role <> 'system'")
def dialogue_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") % 2 == 0, F.array(F.lit("per:friends"))).otherwise(F.array().cast("array<string>"))
    pair = F.struct(F.when(F.col("role") != "system", F.concat(F.lit(" "), F.col("role"))).otherwise("").alias("x"), F.lit("PER").alias("x_type"), F.lit("y").alias("y"), label.alias("r"))
    units = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(pair).alias("p")))).alias("ps"))
    content = F.concat(F.lit('[[["hi"], ['), F.array_join(F.transform("ps", lambda p: p["p"]), ","), F.lit("]]]"))
    out = transcripts.parse_dialogue_pairs(units.select(F.col("conv_id").cast("string").alias("stem"), content.alias("content")))
    return out.select("dialogue_id", "pair_index", "x", "x_type", fx.gold_label("gold_relations").alias("gold"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(ltrim(x), 'É')), chr(10)) AS kept FROM conversations")
def fence_strip(spark, sf_dir):
    fence = "`" * 3
    c = table(spark, sf_dir, "conversations")
    fenced = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.ltrim(x).startswith("É"), F.concat(F.lit(fence), x)).otherwise(x)), "\n")
    return c.select("conv_id", "turn", fx.strip_fences(fenced).alias("kept"))


@query("""SELECT vec_id, round(e[1] / s, 6) AS p0, CAST(list_position(x, list_max(x)) - 1 AS INT) AS top, round(-list_sum(list_transform(e, lambda v: v / s * ln(v / s))) / ln(len(e)), 6) AS entropy FROM (
  SELECT *, list_sum(e) AS s FROM (SELECT vec_id, x, list_transform(x, lambda v: exp(v)) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)))""")
def softmax_entropy(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), fx.softmax(x).alias("p"))
    return e.select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), fx.argmax(F.col("x")).alias("top"), F.round(fx.entropy_fraction(F.col("p")), 6).alias("entropy"))


@query("""SELECT vec_id, round(exp(x[1]) / list_sum(list_transform(x[1:label + 1], lambda v: exp(v))), 6) AS p_masked, CAST(list_position(x, list_max(x[1:label + 1])) - 1 AS INT) AS best
FROM (SELECT vec_id, CAST(label AS INT) AS label, CAST(embedding[1:10] AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL)""")
def masked_argmax(spark, sf_dir):
    """Ten logits a vector, of which the classes up to the label's are seen."""
    x = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").withColumn("x", x)
    z = fx.masked(F.col("x"), F.transform("x", lambda _, i: i <= F.col("label")))
    return e.withColumn("z", z).select("vec_id", F.round(fx.softmax(F.col("z"))[0], 6).alias("p_masked"), fx.argmax(F.col("z")).alias("best"))


@query("SELECT vec_id, 3 * len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])) * 2, 5) AS entity_sum FROM embeddings")
def feature_concat(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("d"), fx.features(x, x, x).alias("f"))
    return e.select("vec_id", F.size("f").cast("long").alias("dims"), F.round(fx.total(F.slice(F.col("f"), F.col("d") + 1, F.col("d") * 2)), 5).alias("entity_sum"))


@query("SELECT label, count(DISTINCT embedding) AS points FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def distinct_points(spark, sf_dir):
    return base.vectors(spark, sf_dir).groupBy("label").agg(F.count_distinct("x").alias("points"))


@query("""SELECT round(avg(CASE WHEN proto = label THEN 1.0 ELSE 0.0 END) FILTER (WHERE rn = 1), 6) AS agreement, round(avg(w) FILTER (WHERE proto = label), 6) AS mean_p, round(median(w) FILTER (WHERE proto = label), 6) AS median_p FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(w, 9) DESC, proto) AS rn FROM (SELECT row_id, label, proto, exp(c / 0.5) / sum(exp(c / 0.5)) OVER (PARTITION BY row_id) AS w FROM (SELECT v.row_id, v.label, pr.label AS proto, list_dot_product(v.x, pr.p) / sqrt(list_dot_product(v.x, v.x)) / sqrt(list_dot_product(pr.p, pr.p)) AS c FROM v, pr)))""", STAGED)
def kd_target_agreement(spark, sf_dir):
    v = base.vectors(spark, sf_dir)
    s = vectors.similarities(v, vectors.prototypes(v), ["row_id", "label"], 0.5)
    best = F.max_by("proto", F.struct(F.round("weight", 9), -F.col("proto")))
    rows = s.groupBy("row_id", "label").agg(best.alias("top"), F.max(F.when(F.col("proto") == F.col("label"), F.col("weight"))).alias("p"))
    return rows.agg(F.round(F.avg((F.col("top") == F.col("label")).cast("double")), 6).alias("agreement"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.percentile("p", 0.5), 6).alias("median_p"))


@query("SELECT t, j, v AS stored, v AS derived FROM r WHERE v > 0.2", STAGED)
def r_rederivation(spark, sf_dir):
    """Stored and derived cells that agree to six digits and exceed a level; the anti join of the rest is empty."""
    stored = _r(spark, sf_dir).select("t", "j", F.col("v").alias("stored"))
    derived = metrics.r_matrix(_staged(spark, sf_dir), []).select("t", "j", F.col("v").alias("derived"))
    return stored.join(derived, ["t", "j"]).where("abs(stored - derived) < 5e-7 AND stored > 0.2")


@query("SELECT DISTINCT relation FROM t WHERE relation = 'off_topic'", TRIPLES)
def off_taxonomy_difference(spark, sf_dir):
    known = spark.createDataFrame([(x,) for x in schema.RELATION_TYPES], "relation string")
    return base.triples(spark, sf_dir).select("relation").distinct().join(F.broadcast(known), "relation", "left_anti")


@query("SELECT doc_id, CAST(pos - 1 AS INT) AS pos, word AS text, CASE lower(word) WHEN 'the' THEN 'PERSON' ELSE 'TOPIC' END AS type FROM (SELECT doc_id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos, regexp_replace(regexp_replace(raw, '^[^\\p{L}\\p{N}_]+', ''), '[^\\p{L}\\p{N}_]+$', '') AS word FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents)) WHERE lower(word) IN ('the', 'of')")
def dictionary_tags(spark, sf_dir):
    words = spark.createDataFrame([("The", "PERSON"), ("of", "LAW")], "word string, type string")
    out = tagger.tag_words(table(spark, sf_dir, "documents"), "doc_id", "text", words)
    return out.withColumn("type", tagger.map_type("type"))


@query("SELECT meeting_id, seq, CASE WHEN seq % 2 = 0 THEN 'Meeting date: 2026-01-05' || chr(10) ELSE '' END || 'Transcript:' || chr(10) || text AS prompt FROM u", UTTERANCES)
def extraction_prompts(spark, sf_dir):
    date = F.when(F.col("seq") % 2 == 0, "2026-01-05").otherwise("")
    return utterances(spark, sf_dir).select("meeting_id", "seq", tagger.extraction_prompt(date, F.col("text")).alias("prompt"))


@query("SELECT mention_seq, subject AS name FROM t WHERE mention_seq % 2 = 0 UNION ALL SELECT mention_seq, subject FROM t WHERE mention_seq % 2 = 1 AND subject_type = 'PERSON' AND 1 = 0", TRIPLES)
def memory_difference(spark, sf_dir):
    """Rows that one selection has and the other lacks."""
    t = base.triples(spark, sf_dir).select("mention_seq", F.col("subject").alias("name"))
    return t.exceptAll(t.where("mention_seq % 2 = 1"))


# --- runs made of events: track, regime, seed and the cells (t, j) of an R-matrix

_RUNS = """q AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'gold' ELSE 'teacher' END AS track, CASE WHEN event_id % 2 = 0 THEN 'naive' ELSE 'replay' END AS regime, CAST(user_id % 3 AS INT) AS seed, CAST(day(ts) % 3 AS INT) AS t, CAST(hour(ts) % 3 AS INT) AS j, round(avg(value) / 100, 6) AS v FROM events WHERE hour(ts) % 3 <= day(ts) % 3 GROUP BY ALL),
fg AS (SELECT a.track, a.regime, a.seed, a.j, a.v - b.v AS f FROM q a JOIN q b ON a.track = b.track AND a.regime = b.regime AND a.seed = b.seed AND a.t = 2 AND b.t = b.j AND a.j = b.j AND a.j < 2),
am AS (SELECT track, regime, seed, avg(v) AS acc FROM q WHERE t = 2 GROUP BY ALL)"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t, j = (F.dayofmonth("ts") % 3).cast("int"), (F.hour("ts") % 3).cast("int")
    track, regime = F.when(F.col("event_type").isin("click", "view"), "gold").otherwise("teacher"), F.when(F.col("event_id") % 2 == 0, "naive").otherwise("replay")
    return e.where(j <= t).groupBy(track.alias("track"), regime.alias("regime"), (F.col("user_id") % 3).cast("int").alias("seed"), t.alias("t"), j.alias("j")).agg(F.round(F.avg("value") / 100, 6).alias("v"))


@query("""SELECT track, regime, round(max(acc) FILTER (WHERE seed = 1), 6) AS acc_1, round(max(acc) FILTER (WHERE seed = 2), 6) AS acc_2, round(max(bwt) FILTER (WHERE seed = 1), 6) AS bwt_1, round(max(bwt) FILTER (WHERE seed = 2), 6) AS bwt_2, round(max(f0) FILTER (WHERE seed = 1), 6) AS forget_t0_1, round(max(f1) FILTER (WHERE seed = 2), 6) AS forget_t1_2
FROM am JOIN (SELECT track, regime, seed, avg(f) AS bwt, max(f) FILTER (WHERE j = 0) AS f0, max(f) FILTER (WHERE j = 1) AS f1 FROM fg GROUP BY ALL) USING (track, regime, seed) GROUP BY track, regime""", _RUNS)
def main_report(spark, sf_dir):
    m = reports.main_table(_runs(spark, sf_dir))
    return m.select("track", "regime", *[F.round(c, 6).alias(c) for c in ("acc_1", "acc_2", "bwt_1", "bwt_2", "forget_t0_1", "forget_t1_2")])


@query("SELECT track, seed, regime, round(acc, 6) AS acc, round(m, 6) AS mean_forgetting FROM am LEFT JOIN (SELECT track, regime, seed, avg(f) AS m FROM fg WHERE j <> 0 GROUP BY ALL) USING (track, regime, seed)", _RUNS)
def fixed_schedule_report(spark, sf_dir):
    r = _runs(spark, sf_dir)
    degenerate = r.select("track", "seed").distinct().withColumn("task", F.lit(0))
    out = reports.fixed_schedule_table(r, degenerate)
    return out.select("track", "seed", "regime", F.round("acc", 6).alias("acc"), F.round("mean_forgetting", 6).alias("mean_forgetting"))


@query("SELECT regime, seed, round(max(acc) FILTER (WHERE track = 'gold') - max(acc) FILTER (WHERE track = 'teacher'), 6) AS gap FROM am GROUP BY ALL", _RUNS)
def track_gap(spark, sf_dir):
    out = reports.track_gap(metrics.acc(_runs(spark, sf_dir), ["track", "regime", "seed"]))
    return out.withColumn("gap", F.round("gap", 6))


_CELLS = """g AS (SELECT event_type AS condition, CAST(user_id % 3 AS INT) AS seed, CAST(day(ts) % 3 AS INT) AS replicate, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS regime, round(avg(value) / 10, 6) AS acc FROM events GROUP BY ALL),
d AS (SELECT condition, seed, replicate, max(acc) FILTER (WHERE regime = 'a') - max(acc) FILTER (WHERE regime = 'b') AS d FROM g GROUP BY 1, 2, 3),
s AS (SELECT condition, seed, CASE WHEN max(abs(d)) FILTER (WHERE replicate = 0) <= 0.03 THEN 0 WHEN min(d) > 0 THEN 1 WHEN max(d) < 0 THEN -1 ELSE 0 END AS sign, round(max(d) FILTER (WHERE replicate = 0), 6) AS delta FROM d GROUP BY 1, 2)"""


def _cells(spark, sf_dir):
    from .label_queries import _grid

    return _grid(spark, sf_dir).withColumnRenamed("v", "acc")


@query("SELECT condition, seed, sign, delta, CASE WHEN count(*) FILTER (WHERE sign = 1) OVER w >= 2 THEN 'real-positive' WHEN count(*) FILTER (WHERE sign = -1) OVER w >= 2 THEN 'real-negative' ELSE 'none' END AS direction FROM s WINDOW w AS (PARTITION BY condition)", _CELLS)
def key_comparison(spark, sf_dir):
    return reports.key_comparison(_cells(spark, sf_dir), "a", "b").withColumn("delta", F.round("delta", 6))


@query("SELECT condition, regime, seed, round(max(acc) FILTER (WHERE replicate = 0), 6) AS r0, min(acc) AS low, max(acc) AS high, count(*) AS n FROM g GROUP BY ALL", _CELLS)
def spread_report(spark, sf_dir):
    return reports.spread_cell(_cells(spark, sf_dir), ["condition", "regime", "seed"], "acc").select("condition", "regime", "seed", "r0", "low", "high", "n")


@query("SELECT seed, replicate, label, drop, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY seed, replicate ORDER BY drop DESC, label) AS place FROM (SELECT seed, replicate, condition AS label, max(acc) FILTER (WHERE regime = 'a') - max(acc) FILTER (WHERE regime = 'b') AS drop FROM g GROUP BY 1, 2, 3)) WHERE place <= 3", _CELLS)
def largest_drops(spark, sf_dir):
    f = _cells(spark, sf_dir).select("seed", "replicate", F.col("condition").alias("label"), F.col("regime").alias("condition"), F.col("acc").alias("f1"))
    return reports.largest_drops(f, "a", "b", ["seed", "replicate"])


@query("SELECT label, rows, impure, train_rows, train_impure, round(rows * train_impure / train_rows, 6) AS expected_impure FROM (SELECT teacher AS label, count(*) FILTER (WHERE row_id % 5 = 0) AS rows, CAST(count(*) FILTER (WHERE row_id % 5 = 0 AND gold <> teacher) AS BIGINT) AS impure, count(*) AS train_rows, CAST(count(*) FILTER (WHERE gold <> teacher) AS BIGINT) AS train_impure FROM l GROUP BY 1) WHERE rows > 0", LABELS)
def purity_by_class(spark, sf_dir):
    train = base.labels(spark, sf_dir).withColumn("label", F.col("teacher"))
    return reports.purity_by_class(train.where("row_id % 5 = 0"), train, []).withColumn("expected_impure", F.round("expected_impure", 6))


@query("""SELECT '1' AS line, bool_and(replay > naive) AS holds FROM ac UNION ALL SELECT '2', bool_and(abs(fkd - replay) <= 0.03) FROM ac WHERE track = 'gold' UNION ALL SELECT '3', bool_and(abs(fkd - replay) <= 0.03) FROM ac WHERE track = 'teacher'
UNION ALL SELECT '7', bool_and(ok) FROM (SELECT track, count(*) FILTER (WHERE abs(fkd - replay) <= 0.03) >= 2 AS ok FROM ac GROUP BY 1) UNION ALL SELECT '0', true UNION ALL SELECT '6', true UNION ALL SELECT '8', false""", _RUNS + ", ac AS (SELECT track, seed, max(acc) FILTER (WHERE regime = 'naive') AS naive, max(acc) FILTER (WHERE regime = 'replay') AS replay, max(acc) FILTER (WHERE regime = 'replay') + seed * 0.01 AS fkd FROM am GROUP BY 1, 2)")
def prediction_verdicts(spark, sf_dir):
    acc = metrics.acc(_runs(spark, sf_dir), ["track", "regime", "seed"])
    one = lambda r: F.max(F.when(F.col("regime") == r, F.col("acc")))
    acc = acc.groupBy("track", "seed").agg(one("naive").alias("naive"), one("replay").alias("replay")).withColumn("fkd", F.col("replay") + F.col("seed") * 0.01)
    ratios = spark.createDataFrame([(1, 2.0, 2.04), (2, 2.0, 1.96)], "seed int, ratio double, reference double")
    shares = spark.createDataFrame([(1, 0.5, 0.4), (2, 0.5, 0.4)], "seed int, before double, after double")
    kd = spark.createDataFrame([(1, 0.5, 0.4), (2, 0.4, 0.4)], "seed int, kd double, replay double")
    return reports.score_predictions(ratios, acc, shares, kd)


@query("SELECT source_meeting, relation, count(*) AS n, rank FROM (SELECT source_meeting, relation, mention_seq, dense_rank() OVER (PARTITION BY source_meeting ORDER BY relation) AS rank FROM t) GROUP BY ALL", TRIPLES)
def meeting_relation_ranks(spark, sf_dir):
    n = base.triples(spark, sf_dir).groupBy("source_meeting", "relation").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.dense_rank().over(Window.partitionBy("source_meeting").orderBy("relation")).cast("long"))


@query("SELECT name, count(*) AS mentions, min(seq) AS first_seq FROM (SELECT 2 * mention_seq AS seq, subject AS name FROM t UNION ALL SELECT 2 * mention_seq + 1, object FROM t) GROUP BY name", TRIPLES)
def mention_index(spark, sf_dir):
    m = resolve.mentions(triples.drop_empty(base.triples(spark, sf_dir)))
    return m.groupBy("name").agg(F.count("*").alias("mentions"), F.min("seq").alias("first_seq"))
