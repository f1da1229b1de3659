"""Queries over triples and the graph that they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, labels, resolve, stats, triples
from . import base
from .base import TRIPLES, query, table

_OK = "(relation IN ('discussed', 'reports_to', 'approved', 'assigned_to'))"
EDGES = TRIPLES + """,
x AS (SELECT mention_seq AS edge_id, subject AS src, object AS dst, relation AS type, confidence, source_meeting, meeting_date, meeting_date::TIMESTAMP + to_seconds(CAST(timestamp AS BIGINT)) AS stated_at, timestamp AS utterance_time FROM t)"""
ENDS = EDGES + """,
ends AS (SELECT DISTINCT source_meeting, unnest([lower(src), lower(dst)]) AS entity FROM x)"""


def _edges(spark, sf_dir):
    return graph.build_edges(base.triples(spark, sf_dir))


@query("SELECT mention_seq, subject, object FROM t WHERE NOT regexp_matches(subject, '^SPEAKER[_ ]?\\d+$', 'i')", TRIPLES)
def drop_placeholders(spark, sf_dir):
    return triples.drop_placeholders(base.triples(spark, sf_dir)).select("mention_seq", "subject", "object")


@query(f"SELECT mention_seq, relation FROM t WHERE {_OK}", TRIPLES)
def taxonomy_filter(spark, sf_dir):
    return base.triples(spark, sf_dir).where(triples.in_taxonomy()).select("mention_seq", "relation")


@query("SELECT mention_seq FROM t WHERE deadline_date <> ''", TRIPLES)
def empty_filter(spark, sf_dir):
    t = base.triples(spark, sf_dir).withColumn("object", F.col("deadline_date"))
    return triples.drop_empty(t).select("mention_seq")


@query(f"""SELECT count(*) AS triples_seen, CAST(count(*) FILTER (WHERE NOT {_OK}) AS BIGINT) AS off_taxonomy_count, round(100.0 * count(*) FILTER (WHERE {_OK}) / count(*), 1) AS adherence_pct,
  string_agg(DISTINCT CASE WHEN NOT {_OK} THEN relation END, ',') AS off_taxonomy_labels FROM t""", TRIPLES)
def adherence_report(spark, sf_dir):
    return triples.adherence_report(base.triples(spark, sf_dir))


@query("""SELECT mention_seq, subject, relation, object, coalesce(due, '') AS deadline_date FROM (
  SELECT *, row_number() OVER w AS rn, first_value(nullif(deadline_date, '') IGNORE NULLS) OVER (PARTITION BY source_meeting, lower(subject), lower(relation), lower(object) ORDER BY mention_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS due
  FROM t WINDOW w AS (PARTITION BY source_meeting, lower(subject), lower(relation), lower(object) ORDER BY mention_seq)) WHERE rn = 1""", TRIPLES)
def dedup_triples(spark, sf_dir):
    return triples.dedup_triples(base.triples(spark, sf_dir)).select("mention_seq", "subject", "relation", "object", "deadline_date")


_MENTIONS = """m AS (SELECT 2 * mention_seq AS seq, subject AS name, subject_type AS type, meeting_date, source_meeting, NULL AS due FROM t
  UNION ALL SELECT 2 * mention_seq + 1, object, object_type, meeting_date, source_meeting, CASE WHEN regexp_full_match(deadline_date, '\\d{4}-\\d{2}-\\d{2}') THEN deadline_date END FROM t)"""


@query("""SELECT name, min_by(type, seq) AS type, min_by(meeting_date, seq) AS first_seen, max_by(meeting_date, seq) AS last_seen, min_by(source_meeting, seq) AS first_meeting, max_by(source_meeting, seq) AS last_meeting,
  CAST(max_by(due, seq) FILTER (WHERE due IS NOT NULL) AS DATE) AS resolved_date FROM m GROUP BY name""", TRIPLES + ", " + _MENTIONS)
def node_upsert_first_last(spark, sf_dir):
    return graph.build_nodes(base.triples(spark, sf_dir))


@query("""SELECT edge_id, src, dst, x.type, a.type AS src_type, b.type AS dst_type, stated_at FROM x
JOIN (SELECT name, min_by(type, seq) AS type FROM m GROUP BY name) a ON src = a.name JOIN (SELECT name, min_by(type, seq) AS type FROM m GROUP BY name) b ON dst = b.name""", EDGES + ", " + _MENTIONS)
def edges_join_nodes(spark, sf_dir):
    t = base.triples(spark, sf_dir)
    return graph.edges_with_types(graph.build_edges(t), graph.build_nodes(t)).select("edge_id", "src", "dst", "type", "src_type", "dst_type", "stated_at")


@query("SELECT edge_id, type AS relation, CASE WHEN src = 'User 8' THEN dst ELSE src END AS other, src = 'User 8' AS is_outgoing, confidence, source_meeting, stated_at FROM x WHERE src = 'User 8' OR dst = 'User 8'", EDGES)
def entity_history(spark, sf_dir):
    return graph.entity_history(_edges(spark, sf_dir), "User 8")


@query("SELECT edge_id, src, dst, type, stated_at FROM x WHERE source_meeting = 'm20240105' AND type IN ('approved', 'assigned_to')", EDGES)
def decisions_for_meeting(spark, sf_dir):
    return graph.decisions(_edges(spark, sf_dir), "m20240105").select("edge_id", "src", "dst", "type", "stated_at")


@query("SELECT edge_id, src, dst, type, stated_at FROM x WHERE contains(lower(src), 'user 4') OR contains(lower(dst), 'item 7') OR contains(lower(dst), 'user 4') OR contains(lower(src), 'item 7') ORDER BY stated_at, utterance_time, edge_id LIMIT 200", EDGES)
def keyword_edges_capped(spark, sf_dir):
    return graph.ask(_edges(spark, sf_dir), ["User 4", "ITEM 7"], ["no_such_relation"])[0].select("edge_id", "src", "dst", "type", "stated_at")


@query("""SELECT source_meeting, edge_id, type AS relation, src AS entity, dst AS other, 'out' AS direction, confidence FROM x WHERE contains(src, 'User 4')
UNION ALL SELECT source_meeting, edge_id, type, dst, src, 'in', confidence FROM x WHERE contains(dst, 'User 4')""", EDGES)
def cross_meeting_evolution(spark, sf_dir):
    return graph.evolution(_edges(spark, sf_dir), "User 4")


@query("""SELECT 'node' AS kind, coalesce(type, '*') AS type, count(*) AS n FROM (SELECT name, min_by(type, seq) AS type FROM m GROUP BY name) GROUP BY ROLLUP (type)
UNION ALL SELECT 'edge', coalesce(type, '*'), count(*) FROM x GROUP BY ROLLUP (type)""", EDGES + ", " + _MENTIONS)
def graph_stats(spark, sf_dir):
    t = base.triples(spark, sf_dir)
    return graph.graph_stats(graph.build_nodes(t), graph.build_edges(t))


@query("SELECT type, count(*) AS n, min(seq) AS first_pos FROM m GROUP BY type", TRIPLES + ", " + _MENTIONS)
def endpoint_type_counts(spark, sf_dir):
    return stats.endpoint_types(base.triples(spark, sf_dir))


@query("SELECT relation, count(*) AS n, min(mention_seq) AS first_pos FROM t GROUP BY relation ORDER BY n DESC, first_pos LIMIT 3", TRIPLES)
def relation_topk(spark, sf_dir):
    return stats.most_common(base.triples(spark, sf_dir), "relation", 3)


@query("SELECT entity, count(*) AS meetings FROM ends GROUP BY entity HAVING count(*) >= 2", ENDS)
def bridging_entities(spark, sf_dir):
    return graph.bridging(_edges(spark, sf_dir))


@query("SELECT meetings, count(*) AS entities FROM (SELECT entity, count(*) AS meetings FROM ends GROUP BY entity) GROUP BY meetings", ENDS)
def bridging_histogram(spark, sf_dir):
    return graph.bridging(_edges(spark, sf_dir), 1).groupBy("meetings").agg(F.count("*").alias("entities"))


@query("SELECT entity, count(*) AS meetings FROM ends GROUP BY entity HAVING count(*) >= 2 ORDER BY meetings DESC, entity LIMIT 10", ENDS)
def recurring_entities(spark, sf_dir):
    return graph.bridging(_edges(spark, sf_dir)).orderBy(F.desc("meetings"), "entity").limit(10)


@query("""SELECT a.source_meeting AS a, b.source_meeting AS b, any_value(na.n) AS n_a, any_value(nb.n) AS n_b, count(*) AS both, round(count(*)::DOUBLE / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard
FROM ends a JOIN ends b ON a.entity = b.entity AND a.source_meeting < b.source_meeting JOIN (SELECT source_meeting, count(*) AS n FROM ends GROUP BY 1) na ON na.source_meeting = a.source_meeting
JOIN (SELECT source_meeting, count(*) AS n FROM ends GROUP BY 1) nb ON nb.source_meeting = b.source_meeting GROUP BY ALL""".replace("any_value(na.n)", "max(na.n)").replace("any_value(nb.n)", "max(nb.n)").replace("GROUP BY ALL", "GROUP BY a.source_meeting, b.source_meeting"), ENDS)
def meeting_jaccard(spark, sf_dir):
    return graph.meeting_overlap(_edges(spark, sf_dir)).select("a", "b", "n_a", "n_b", "both", F.round("jaccard", 6).alias("jaccard"))


@query("""SELECT source_meeting, any_value(triples) AS triples, round(any_value(conf), 6) AS avg_confidence, CAST(sum(s) AS BIGINT) AS subjects, CAST(sum(o) AS BIGINT) AS objects, count(*) AS entities, CAST(count(*) FILTER (WHERE s = 1 AND o = 1) AS BIGINT) AS both_roles FROM (
  SELECT source_meeting, e, max(s) AS s, max(o) AS o FROM (SELECT source_meeting, lower(subject) AS e, 1 AS s, 0 AS o FROM t UNION ALL SELECT source_meeting, lower(object), 0, 1 FROM t) GROUP BY ALL)
JOIN (SELECT source_meeting, count(*) AS triples, avg(confidence) AS conf FROM t GROUP BY 1) USING (source_meeting) GROUP BY source_meeting""", TRIPLES)
def meeting_summary(spark, sf_dir):
    return stats.meeting_summary(base.triples(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("""SELECT bucket, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT CASE WHEN confidence >= 0.9 THEN 'high (≥0.9)' WHEN confidence >= 0.7 THEN 'medium (0.7-0.9)' WHEN confidence >= 0.5 THEN 'low (0.5-0.7)' ELSE 'very low (<0.5)' END AS bucket, count(*) AS n FROM t GROUP BY 1)""", TRIPLES)
def confidence_histogram(spark, sf_dir):
    return stats.confidence_histogram(base.triples(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query("""SELECT n AS triples, meetings, round(n / meetings, 6) AS per_meeting, types, round(100.0 * top / al, 6) AS dominant_pct, round(100.0 * unknown / al, 6) AS unknown_pct, round(conf, 6) AS avg_confidence, very_low, self_references, speaker_leaks,
  CASE WHEN n / meetings < 5 THEN 'LOW' WHEN n / meetings > 100 THEN 'HIGH' ELSE 'OK' END AS volume_flag, CASE WHEN types < 3 THEN 'LOW' WHEN 100.0 * top / al > 80 THEN 'DOMINATED' ELSE 'OK' END AS diversity_flag,
  CASE WHEN conf < 0.6 THEN 'LOW' WHEN very_low / n > 0.3 THEN 'MANY_LOW' ELSE 'OK' END AS confidence_flag
FROM (SELECT count(*) AS n, count(DISTINCT source_meeting) AS meetings, avg(confidence) AS conf, CAST(count(*) FILTER (WHERE confidence < 0.5) AS BIGINT) AS very_low, CAST(count(*) FILTER (WHERE lower(subject) = lower(object)) AS BIGINT) AS self_references,
  CAST(count(*) FILTER (WHERE contains(subject, 'SPEAKER_') OR contains(object, 'SPEAKER_')) AS BIGINT) AS speaker_leaks FROM t),
(SELECT count(*) AS types, max(c) AS top, sum(c) AS al, coalesce(sum(c) FILTER (WHERE type = 'UNKNOWN'), 0) AS unknown FROM (SELECT type, count(*) AS c FROM m GROUP BY type))""", TRIPLES + ", " + _MENTIONS)
def health_flags(spark, sf_dir):
    h = stats.health(base.triples(spark, sf_dir))
    for c in ("per_meeting", "dominant_pct", "unknown_pct", "avg_confidence"):
        h = h.withColumn(c, F.round(c, 6))
    return h


@query("SELECT mention_seq, subject, object FROM t WHERE lower(subject) = lower(object)", TRIPLES)
def self_reference(spark, sf_dir):
    return base.triples(spark, sf_dir).where("lower(subject) = lower(object)").select("mention_seq", "subject", "object")


@query("SELECT name, resolved_date FROM (SELECT name, min_by(type, seq) AS type, CAST(max_by(due, seq) FILTER (WHERE due IS NOT NULL) AS DATE) AS resolved_date FROM m GROUP BY name) WHERE type = 'DEADLINE' AND resolved_date IS NOT NULL", TRIPLES + ", " + _MENTIONS)
def deadline_ordering(spark, sf_dir):
    return graph.deadlines(graph.build_nodes(base.triples(spark, sf_dir))).select("name", "resolved_date")


@query("SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')")
def roster_anti_join(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().join(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_name").alias("name"))
    return graph.roster_missing(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), nodes)


@query("""SELECT 'entity types are known' AS check, n = 0 AS ok, n AS extra FROM (SELECT count(*) AS n FROM nd WHERE type = 'UNKNOWN')
UNION ALL SELECT 'relation types are known', n = 0, n FROM (SELECT count(*) AS n FROM x WHERE type = 'off_topic')
UNION ALL SELECT 'node labels are safe', true, 0 UNION ALL SELECT 'no speaker label is a node', n = 0, n FROM (SELECT count(*) AS n FROM nd WHERE name LIKE 'SPEAKER%')
UNION ALL SELECT 'every edge has a time', true, 0 UNION ALL SELECT 'every endpoint is a node', true, 0 UNION ALL SELECT 'every attendee is a node', n = 0, n FROM (SELECT count(*) AS n FROM customer) UNION ALL SELECT 'the graph has edges', true, 0""", EDGES + ", " + _MENTIONS + ", nd AS (SELECT name, min_by(type, seq) AS type FROM m GROUP BY name)")
def graph_checklist(spark, sf_dir):
    t = base.triples(spark, sf_dir)
    return graph.checklist(graph.build_nodes(t), graph.build_edges(t), table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


@query("""SELECT DISTINCT o_custkey AS cust, l_partkey AS part, l_suppkey AS supp, n_name AS nation FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'""")
def order_graph_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("cust"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return o.join(li, o.o_orderkey == li.l_orderkey).join(c, "cust").join(n, "n_nationkey").select("cust", "part", "supp", "nation").distinct()


# --- entity resolution on part, nation and region names

@query("SELECT r_name AS name, CASE r_name WHEN 'ASIA' THEN 'Asia and Pacific' WHEN 'EUROPE' THEN 'European Union' ELSE r_name END AS resolved FROM region")
def alias_resolve(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("TOPIC").alias("type"))
    return resolve.resolve_aliases(names, resolve.aliases(spark, {"asia": "Asia and Pacific", "europe": "European Union"})).select("name", "resolved")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE NULL END AS canonical FROM nation")
def exact_canonical(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    canon = n.where("n_nationkey % 2 = 0").select(F.col("name").alias("canonical"))
    return resolve.resolve_canonical(n, canon).select("name", "canonical")


@query("""SELECT name, max_by(canonical, ratio * 1000000 - pos) AS canonical, round(max(ratio), 6) AS ratio FROM (
  SELECT name, canonical, pos, 1.0 - levenshtein(name, canonical)::DOUBLE / greatest(length(name), length(canonical)) AS ratio
  FROM (SELECT DISTINCT replace(p_name, 'e', 'a') AS name FROM part), (SELECT p_name AS canonical, min(p_partkey) AS pos FROM part GROUP BY 1)) WHERE ratio >= 0.85 GROUP BY name""")
def fuzzy_best_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    left = p.select(F.regexp_replace("p_name", "e", "a").alias("name")).distinct()
    right = p.groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_partkey").alias("pos"))
    return resolve.fuzzy_best(left, right).select("name", "canonical", F.round("ratio", 6).alias("ratio"))


_ROSTER = """w AS (SELECT split_part(p_name, ' ', 1) AS name, min(p_partkey) AS pos FROM part GROUP BY 1), n AS (SELECT DISTINCT replace(name, 'e', 'ee') AS name FROM w),
s AS (SELECT name, regexp_replace(lower(name), '[^a-z]', '', 'g') AS x FROM (SELECT name FROM w UNION SELECT name FROM n)),
d AS (SELECT *, list_aggregate(list_transform(regexp_extract_all(translate(regexp_replace(x, '(.)[hw]+', '\\1', 'g'),
  'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000'), '(0+|1+|2+|3+|4+|5+|6+)'), lambda z: left(z, 1)), 'string_agg', '') AS code FROM s),
c AS (SELECT name, CASE WHEN x = '' THEN '' ELSE upper(left(x, 1)) || left(replace(substr(code, 2), '0', '') || '000', 3) END AS code FROM d),
f AS (SELECT code, min_by(name, pos) AS heard FROM w JOIN c USING (name) WHERE length(name) > 4 AND code <> '' GROUP BY 1)"""


@query("SELECT n.name, CASE WHEN lower(heard) <> lower(n.name) THEN heard ELSE n.name END AS resolved FROM n JOIN c USING (name) LEFT JOIN f USING (code)", _ROSTER)
def soundex_roster(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name"), F.col("p_partkey").alias("pos"))
    roster = p.groupBy("name").agg(F.min("pos").alias("pos")).where("length(name) > 4")
    names = p.select(F.regexp_replace("name", "e", "ee").alias("name"), F.lit("PERSON").alias("type")).distinct()
    return resolve.resolve_soundex(names, roster).select("name", "resolved")


@query()
def entity_resolver_exact(spark, sf_dir):
    """The ordered resolver over the names of parts, regions and nations, a scope a brand."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "PERSON").otherwise("TOPIC").alias("type"), F.col("p_brand").alias("scope"))
    one = p.select("seq", F.when(F.col("type") == "PERSON", F.split("name", " ")[0]).otherwise(F.col("name")).alias("name"), "type", "scope")  # persons have one word
    return resolve.resolve_exact(one, roster=["Priya", "Meera", "Grean", "Blew"], scope=["scope"]).select("scope", "seq", "name", "resolved", "resolved_type")


@query("SELECT type, count(*) AS entities, CAST(sum(spellings) AS BIGINT) AS spellings FROM (SELECT lower(name) AS r, max_by(type, seq) AS type, count(DISTINCT name) AS spellings FROM m GROUP BY 1) GROUP BY type", TRIPLES + ", " + _MENTIONS)
def resolver_stats(spark, sf_dir):
    m = resolve.mentions(base.triples(spark, sf_dir))
    return resolve.resolver_stats(m.withColumn("resolved", F.lower("name")).withColumn("resolved_type", F.col("type")))


@query("""SELECT a.dialogue, a.x, a.y, a.label, max_by(b.label, b.pos) AS reverse_label FROM p a LEFT JOIN p b ON a.dialogue = b.dialogue AND a.x = b.y AND a.y = b.x GROUP BY a.dialogue, a.pos, a.x, a.y, a.label""",
       "p AS (SELECT CAST(ts AS DATE) AS dialogue, event_id AS pos, user_id % 5 AS x, event_id % 5 AS y, event_type AS label FROM events)")
def reverse_pair_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("dialogue"), F.col("event_id").alias("pos"), (F.col("user_id") % 5).alias("x"), (F.col("event_id") % 5).alias("y"), F.col("event_type").alias("label"))
    return labels.reverse_pairs(p).select("dialogue", "x", "y", "label", "reverse_label")


@query("SELECT dialogue, index, max_by(relation, pos) AS relation FROM p WHERE index < 8 AND relation IN ('click', 'view') GROUP BY ALL", "p AS (SELECT CAST(ts AS DATE) AS dialogue, event_id AS pos, user_id % 10 AS index, event_type AS relation FROM events)")
def last_answer_wins(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("dialogue"), F.col("event_id").alias("pos"), (F.col("user_id") % 10).alias("index"), F.col("event_type").alias("relation"))
    return labels.last_answer(p, 8, ["click", "view"])


