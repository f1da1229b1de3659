"""Queries over transcripts, text expressions, windows and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx
from ..operators import speakers, triples, windows
from ..sources import sinks
from . import base
from .base import UTTERANCES, query, table, utterances

WINDOWED = UTTERANCES + """,
n AS (SELECT *, count(*) OVER (PARTITION BY meeting_id) AS n FROM u),
w AS (SELECT n.*, s.w AS window_id FROM n JOIN range(0, 100000) s(w) ON s.w * 3 <= n.seq AND n.seq < s.w * 3 + 4 AND (s.w = 0 OR s.w * 3 - 3 + 4 < n.n))"""


@query("""SELECT meeting_id, CAST(window_id AS INT) AS window_id, count(*) AS n_utterances, min(seq) AS first_seq, max(seq) AS last_seq,
  array_to_string(list_sort(list_distinct(list(speaker_id))), ',') AS speakers,
  string_agg('[' || speaker_id || '] (' || printf('%.1f', start_time) || 's): ' || text, chr(10) ORDER BY seq) AS text
FROM w GROUP BY ALL""", WINDOWED)
def chunk_windows(spark, sf_dir):
    w = windows.sliding_windows(utterances(spark, sf_dir), 4, 1)
    return w.select("meeting_id", "window_id", F.size("utterances").cast("long").alias("n_utterances"), F.col("utterances")[0]["seq"].alias("first_seq"), F.element_at("utterances", -1)["seq"].alias("last_seq"), F.array_join(fx.speaker_set("utterances"), ",").alias("speakers"), fx.render_window("utterances").alias("text"))


@query("SELECT meeting_id, CAST(window_id AS INT) AS window_id, count(DISTINCT speaker_id) AS n_speakers FROM w GROUP BY ALL", WINDOWED)
def window_speaker_sets(spark, sf_dir):
    w = windows.sliding_windows(utterances(spark, sf_dir), 4, 1)
    return w.select("meeting_id", "window_id", F.size(fx.speaker_set("utterances")).cast("long").alias("n_speakers"))


@query("SELECT conv_id, turn, 4.0::DOUBLE * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS start_time, 4.0::DOUBLE * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS end_time FROM conversations")
def synthetic_clock(spark, sf_dir):
    return windows.synthetic_clock(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("SELECT meeting_id, max(end_time) AS duration, count(*) AS utterances FROM u GROUP BY ALL", UTTERANCES)
def transcript_duration(spark, sf_dir):
    return utterances(spark, sf_dir).groupBy("meeting_id").agg(F.coalesce(F.max("end_time"), F.lit(0.0)).alias("duration"), F.count("*").alias("utterances"))


@query("""SELECT doc_id, CAST(turn_no AS BIGINT) AS turn_no, count(*) AS n_lines, string_agg(line, ' ' ORDER BY pos) AS text FROM (
  SELECT doc_id, pos, line, sum(CASE WHEN lower(left(line, 1)) IN ('t', 'a', 'd', 'e', 'l') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS turn_no
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE line <> '')
WHERE turn_no > 0 GROUP BY ALL""")
def turn_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x != ""))
    turns = windows.turns_of(F.col("lines"), lambda x: F.lower(F.left(x, F.lit(1))).isin("t", "a", "d", "e", "l"))
    return d.select("doc_id", F.inline(turns)).withColumn("n_lines", F.col("n_lines").cast("long"))


@query("""SELECT user_id, session_no, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL""")
def gap_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    s = windows.gap_sessions(e, ["user_id"], "us", "us", 3_600_000_000, "event_id")
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS hms, CAST(minute(ts) * 60 + second(ts) AS DOUBLE) AS ms, CAST(second(ts) AS DOUBLE) AS s, NULL::DOUBLE AS bad FROM events")
def parse_timestamp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", fx.parse_timestamp(F.date_format("ts", "HH:mm:ss")).alias("hms"), fx.parse_timestamp(F.date_format("ts", "mm:ss")).alias("ms"), fx.parse_timestamp(F.date_format("ts", "ss")).alias("s"), fx.parse_timestamp(F.lit("x:y")).alias("bad"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS relation, left(p_name, 5) AS preview FROM part")
def normalize_relation(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fx.normalize_relation(F.concat(F.lit("  "), F.upper(F.regexp_replace("p_name", " ", "  ")), F.lit(" \n"))).alias("relation"), fx.preview("p_name", 5).alias("preview"))


@query("SELECT p_partkey, p_name AS person, 'Dr. ' || p_name AS topic FROM part")
def normalize_entity(spark, sf_dir):
    titled = F.concat(F.lit(" Dr.  "), F.regexp_replace("p_name", " ", "  "))
    return table(spark, sf_dir, "part").select("p_partkey", fx.normalize_entity(titled, F.lit("PERSON")).alias("person"), fx.normalize_entity(titled, F.lit("TOPIC")).alias("topic"))


_SOUNDEX = """s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS x FROM part),
d AS (SELECT *, list_aggregate(list_transform(regexp_extract_all(translate(regexp_replace(x, '(.)[hw]+', '\\1', 'g'),
  'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000'), '(0+|1+|2+|3+|4+|5+|6+)'), lambda z: left(z, 1)), 'string_agg', '') AS code FROM s)"""


@query("SELECT p_partkey, CASE WHEN x = '' THEN '' ELSE upper(left(x, 1)) || left(replace(substr(code, 2), '0', '') || '000', 3) END AS code FROM d", _SOUNDEX)
def soundex_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fx.soundex_code("p_name").alias("code"))


@query("""SELECT a.p_name AS a, b.p_name AS b, round(CASE WHEN abs(length(a.p_name) - length(b.p_name)) * 2 > greatest(length(a.p_name), length(b.p_name)) THEN 0.0
  ELSE 1.0 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END, 6) AS ratio
FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON left(a.p_name, 3) = left(b.p_name, 3) AND a.p_name < b.p_name""")
def levenshtein_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("p3", F.left("p_name", F.lit(3)))
    met = n.select("p3", F.col("p_name").alias("a")).join(n.select("p3", F.col("p_name").alias("b")), "p3").where("a < b")
    return met.select("a", "b", F.round(fx.levenshtein_ratio("a", "b"), 6).alias("ratio"))


@query("SELECT mention_seq, meeting_date::TIMESTAMP + to_seconds(CAST(timestamp AS BIGINT)) AS stated_at, NULL::TIMESTAMP AS blank FROM t", base.TRIPLES)
def stated_at(spark, sf_dir):
    t = base.triples(spark, sf_dir)
    return t.select("mention_seq", fx.stated_at(F.col("meeting_date").cast("string"), "timestamp").alias("stated_at"), fx.stated_at(F.lit("soonish"), "timestamp").alias("blank"))


@query("""SELECT mention_seq, CASE WHEN timestamp BETWEEN 20000 AND 60001 THEN timestamp ELSE 20000.0 END AS clamped, 20000.0::DOUBLE AS fallback FROM t""", base.TRIPLES)
def cited_time_clamp(spark, sf_dir):
    t = base.triples(spark, sf_dir)
    return t.select("mention_seq", fx.cited_time(F.col("timestamp").cast("string"), F.lit(20000.0), F.lit(60000.0)).alias("clamped"), fx.cited_time(F.lit("soon"), F.lit(20000.0), F.lit(60000.0)).alias("fallback"))


@query("SELECT mention_seq, CASE WHEN regexp_full_match(deadline_date, '\\d{4}-\\d{2}-\\d{2}') THEN deadline_date ELSE '' END AS due FROM t", base.TRIPLES)
def iso_date_validate(spark, sf_dir):
    return base.triples(spark, sf_dir).select("mention_seq", fx.iso_date("deadline_date").alias("due"))


@query("SELECT n_name, regexp_matches(n_name, '^[A-Z][A-Z_]{0,30}$') AS ok, regexp_matches(regexp_replace(n_name, '[0-9]', '', 'g'), '^[A-Z][A-Z_]{0,30}$') AS letters_ok FROM nation")
def label_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", fx.node_label_ok("n_name").alias("ok"), fx.node_label_ok(F.regexp_replace("n_name", "[0-9]", "")).alias("letters_ok"))


@query("""SELECT event_id, 0 AS item_pos, 'user ' || user_id AS subject, 'PERSON' AS subject_type, 'item_' || regexp_extract(props, '[0-9]+') AS relation, 'UNKNOWN' AS object_type, CASE WHEN event_id % 3 = 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence
FROM events WHERE event_id % 3 <> 2""")
def json_payload_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k, fence = F.regexp_extract("props", "[0-9]+", 0), "`" * 3
    conf = F.when(F.col("event_id") % 3 == 0, ', "confidence": 0.5').when(F.col("event_id") % 3 == 1, "").otherwise(', "confidence": "high"')
    raw = F.concat(F.lit(fence + 'json\nHere: {"triples": [{"subject": " user '), F.col("user_id").cast("string"), F.lit('", "subject_type": "person", "relation": "Item  '), k, F.lit('", "object": "x"'), conf, F.lit("},]}\n" + fence))
    parsed = triples.parse_responses(e.select("event_id", raw.alias("raw")))
    return triples.triples_from_items(parsed, ["event_id"]).select("event_id", "item_pos", "subject", "subject_type", "relation", "object_type", "confidence")


_NON = " OR ".join("contains(a, '" + p.replace("'", "''") + "')" for p in schema.NON_ANSWERS)


@query(f"""SELECT doc_id, NOT ({_NON}) AND contains(a, 'th') AND (contains(a, 'zzz') OR contains(a, 'er')) AS ok FROM (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS a FROM documents)""")
def qa_grade(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.grade("text", [["TH"], ["zzz", "er"]]).alias("ok"))


@query("""SELECT lang, count(*) AS total, CAST(count(*) FILTER (WHERE contains(lower(text), 'th')) AS BIGINT) AS correct FROM documents GROUP BY ALL""")
def qa_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("total"), F.count_if(fx.grade("text", [["th"]])).alias("correct"))


@query("SELECT doc_id, sha256(lang || chr(10) || source || '::' || lang || '|' || lang || '::' || source || chr(10) || 'm' || chr(10) || 'v2') AS key FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def teacher_cache_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    pairs = F.array(F.struct(F.col("source").alias("x"), F.col("lang").alias("y")), F.struct(F.col("lang").alias("x"), F.col("source").alias("y")))
    return d.select("doc_id", fx.cache_key(F.col("lang"), pairs, F.lit("m"), F.lit("v2")).alias("key"))


@query("SELECT CASE WHEN doc_id % 2 = 0 AND text IS NOT NULL THEN 'hit' ELSE 'miss' END AS kind, count(*) AS n FROM documents GROUP BY ALL")
def cache_hit_split(spark, sf_dir):
    """Every document asks; the cache has the even ones twice, those without a text as empty answers."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), "doc_id", "text")
    cache = d.where("doc_id % 2 = 0").select("key", F.col("text").alias("answer"))
    hits, misses = sinks.split_by_cache(d.select("key", "doc_id"), cache.union(cache))
    count = lambda rows, kind: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n").where("n > 0")
    return count(hits, "hit").union(count(misses, "miss"))


# --- speakers: conversations 0, 3, 6 ... name their roles

_NAMES = UTTERANCES + """, names AS (SELECT DISTINCT meeting_id, speaker_id, upper(speaker_id) AS name FROM u WHERE meeting_id % 3 = 0 AND speaker_id <> 'system')"""


@query("SELECT u.meeting_id, u.seq, coalesce(names.name, u.speaker_id) AS speaker_id FROM u LEFT JOIN names USING (meeting_id, speaker_id)", _NAMES)
def speaker_map_apply(spark, sf_dir):
    u = utterances(spark, sf_dir)
    names = u.where("meeting_id % 3 = 0 AND speaker_id <> 'system'").select("meeting_id", "speaker_id", F.upper("speaker_id").alias("name")).distinct()
    return speakers.apply_speaker_map(u, names).select("meeting_id", "seq", "speaker_id")


_LABELS = UTTERANCES + """, lab AS (SELECT meeting_id, speaker_id, count(*) AS n_utterances FROM u GROUP BY ALL)"""


@query("SELECT meeting_id, speaker_id, 'Ann' AS name FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n_utterances DESC, speaker_id) AS rn FROM lab) WHERE rn = 1", _LABELS)
def speaker_dedupe(spark, sf_dir):
    labels = utterances(spark, sf_dir).groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n_utterances"))
    return speakers.one_label_a_name(labels.select("meeting_id", "speaker_id", F.lit("Ann").alias("name")), labels)


@query("""SELECT meeting_id, speaker_id, 'Ann' AS name FROM lab WHERE speaker_id = 'user'
UNION ALL SELECT lab.meeting_id, lab.speaker_id, 'Bob' FROM lab JOIN (SELECT meeting_id FROM lab GROUP BY 1 HAVING count(*) = 2 AND bool_or(speaker_id = 'user')) two USING (meeting_id) WHERE lab.speaker_id <> 'user'""", _LABELS)
def speaker_elimination(spark, sf_dir):
    u = utterances(spark, sf_dir)
    meetings = u.select("meeting_id").distinct()
    roster = meetings.select("meeting_id", F.posexplode(F.array(F.lit("Ann"), F.lit("Bob"))).alias("pos", "name"))
    answers = meetings.select("meeting_id", F.explode(F.array(F.struct(F.lit("user").alias("s"), F.lit(" ann ").alias("n")), F.struct(F.lit("assistant").alias("s"), F.lit("Zed").alias("n")), F.struct(F.lit("ghost").alias("s"), F.lit("Bob").alias("n")))).alias("a")).select("meeting_id", F.col("a.s").alias("speaker_id"), F.col("a.n").alias("name"))
    return speakers.name_speakers(answers, u, roster)


@query("""SELECT meeting_id, CAST(window_id AS INT) AS window_id, list_sort(list_distinct(list(speaker_id)))[1] AS subject, 'discussed_with' AS relation, list_sort(list_distinct(list(speaker_id)))[2] AS object, 0.9::DOUBLE AS confidence, min(start_time) AS "timestamp"
FROM w GROUP BY ALL HAVING count(DISTINCT speaker_id) >= 2""", WINDOWED)
def mock_extraction(spark, sf_dir):
    out = triples.mock_extract(windows.sliding_windows(utterances(spark, sf_dir), 4, 1))
    return out.select("meeting_id", "window_id", "subject", "relation", "object", "confidence", "timestamp")


@query("""SELECT count(*) AS windows_total, CAST(count(*) FILTER (WHERE NOT failed) AS BIGINT) AS windows_extracted, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS windows_failed,
  CAST(count(*) FILTER (WHERE NOT failed AND n = 0) AS BIGINT) AS windows_empty, 0::BIGINT AS windows_unparsed, round(100.0 * count(*) FILTER (WHERE NOT failed) / count(*), 1) AS coverage_pct
FROM (SELECT meeting_id, window_id, meeting_id % 7 = 0 AS failed, count(*) FILTER (WHERE speaker_id = 'system') AS n FROM w GROUP BY ALL)""", WINDOWED)
def coverage_report(spark, sf_dir):
    w = windows.sliding_windows(utterances(spark, sf_dir), 4, 1)
    n = F.size(F.filter("utterances", lambda u: u["speaker_id"] == "system"))
    return triples.coverage_report(w.select((F.col("meeting_id") % 7 == 0).alias("failed"), F.lit(False).alias("unparsed"), n.alias("n_triples")))


@query("""SELECT a.meeting_id, a.speaker_id AS subject, p.relation, b.speaker_id AS object FROM lab a JOIN lab b ON a.meeting_id = b.meeting_id AND a.speaker_id <> b.speaker_id
JOIN (VALUES ('user', 'assistant', 'teaches'), ('user', 'system', 'participates_in')) p(x, y, relation) ON a.speaker_id = p.x AND b.speaker_id = p.y""", _LABELS)
def pair_type_lookup(spark, sf_dir):
    u = utterances(spark, sf_dir)
    e = u.groupBy("meeting_id", "speaker_id").agg(F.min("seq").alias("pos"))
    kind = F.when(F.col("speaker_id") == "user", "PERSON").when(F.col("speaker_id") == "assistant", "COURSE").otherwise("EVENT")
    out = triples.type_pair_extract(e.select("meeting_id", "pos", F.col("speaker_id").alias("text"), kind.alias("type")), ["meeting_id"])
    return out.select("meeting_id", "subject", "relation", "object")
