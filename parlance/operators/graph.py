"""The temporal property graph: nodes and edges as tables, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx


#: Meetings of an entity up to which its pairs of meetings are one task's.
HOT = 256


def build_edges(triples: DataFrame) -> DataFrame:
    """One edge a triple (a multigraph): edge_id, src, dst, type, confidence, source_meeting, meeting_date, stated_at, utterance_time."""
    day = F.col("meeting_date").cast("string")
    return triples.select(F.col("mention_seq").alias("edge_id"), F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("relation").alias("type"), "confidence", "source_meeting", F.col("meeting_date"), fx.stated_at(day, "timestamp").alias("stated_at"), F.col("timestamp").alias("utterance_time"))


def build_nodes(triples: DataFrame, type_policy: str = "first") -> DataFrame:
    """Node upsert: subjects before objects of a triple, first or last writer's type, last non-null resolved date."""
    subject = F.struct((F.col("mention_seq") * 2).alias("seq"), F.col("subject").alias("name"), F.col("subject_type").alias("type"), F.lit(None).cast("string").alias("resolved"))
    object_ = F.struct((F.col("mention_seq") * 2 + 1).alias("seq"), F.col("object").alias("name"), F.col("object_type").alias("type"), F.nullif(fx.iso_date("deadline_date"), F.lit("")).alias("resolved"))
    rows = triples.select("source_meeting", "meeting_date", F.explode(F.array(subject, object_)).alias("e")).select("source_meeting", "meeting_date", "e.*")
    kind = F.min_by("type", "seq") if type_policy == "first" else F.max_by("type", "seq")
    dated = F.when(F.col("resolved").isNotNull(), F.col("seq"))
    return rows.groupBy("name").agg(kind.alias("type"), F.min_by("meeting_date", "seq").alias("first_seen"), F.max_by("meeting_date", "seq").alias("last_seen"), F.min_by("source_meeting", "seq").alias("first_meeting"), F.max_by("source_meeting", "seq").alias("last_meeting"), F.max_by("resolved", dated).try_cast("date").alias("resolved_date"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge a later batch's nodes into the stored ones."""
    rows = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    dated = F.when(F.col("resolved_date").isNotNull(), F.col("_v"))
    return rows.groupBy("name").agg(F.min_by("type", "_v").alias("type"), F.min_by("first_seen", "_v").alias("first_seen"), F.max_by("last_seen", "_v").alias("last_seen"), F.min_by("first_meeting", "_v").alias("first_meeting"), F.max_by("last_meeting", "_v").alias("last_meeting"), F.max_by("resolved_date", dated).alias("resolved_date"))


def edges_with_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    kinds = nodes.select("name", "type")
    s = kinds.select(F.col("name").alias("src"), F.col("type").alias("src_type"))
    d = kinds.select(F.col("name").alias("dst"), F.col("type").alias("dst_type"))
    return edges.join(s, "src").join(d, "dst")


def entity_history(edges: DataFrame, name: str) -> DataFrame:
    """Edges at an entity in either direction, a self-loop once: edge_id, relation, other, is_outgoing, stated_at."""
    rows = edges.where((F.col("src") == name) | (F.col("dst") == name))
    out = F.col("src") == name
    return rows.select("edge_id", F.col("type").alias("relation"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), out.alias("is_outgoing"), "confidence", "source_meeting", "stated_at")


def decisions(edges: DataFrame, meeting: str) -> DataFrame:
    return edges.where((F.col("source_meeting") == meeting) & F.col("type").isin(schema.DECISION_RELATIONS))


def mentions_any(words: list[str]) -> Column:
    """Either endpoint contains a word, cases aside."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower("src").contains(w.lower()) | F.lower("dst").contains(w.lower())
    return out


def in_time(edges: DataFrame, cap: int | None = schema.ROW_CAP) -> DataFrame:
    out = edges.orderBy(F.col("stated_at").asc_nulls_last(), "utterance_time", "edge_id")
    return out if cap is None else out.limit(cap)


def ask(edges: DataFrame, keywords: list[str], relations: list[str] | None = None, meetings: list[str] | None = None, cap: int = schema.ROW_CAP, attempts: int = schema.MAX_ATTEMPTS) -> tuple[DataFrame, dict]:
    """Template question: keyword search, broadened step by step until it has rows.

    The ladder drops the relation filter, then the meetings, and asks for single words of the keywords.
    Returns the rows in time order and {attempt, truncated}; exactly ``cap`` rows count as truncated."""
    words = [w for k in keywords for w in k.split()]
    ladder = [(keywords, relations, meetings), (keywords, None, meetings), (words, None, None)][:attempts]
    rows, n, step = edges.limit(0), 0, 0
    for step, (keys, rel, meet) in enumerate(ladder, 1):
        found = edges.where(mentions_any(keys))
        found = found.where(F.col("type").isin(rel)) if rel else found
        rows = in_time(found.where(F.col("source_meeting").isin(meet)) if meet else found, cap)
        n = rows.count()
        if n:
            break
    return rows, {"attempt": step, "truncated": n >= cap}


def deadlines(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'DEADLINE' AND resolved_date IS NOT NULL").orderBy("resolved_date", "name")


def evolution(edges: DataFrame, part: str) -> DataFrame:
    """Per meeting, what is said of entities whose name contains ``part`` (cases count), once an orientation."""
    one = lambda near, far, way: edges.where(F.col(near).contains(part)).select("source_meeting", "edge_id", F.col("type").alias("relation"), F.col(near).alias("entity"), F.col(far).alias("other"), F.lit(way).alias("direction"), "confidence")
    return one("src", "dst", "out").union(one("dst", "src", "in"))


def endpoint_meetings(edges: DataFrame) -> DataFrame:
    """Distinct (meeting, lower-cased entity) of both ends."""
    ends = F.explode(F.array(F.lower("src"), F.lower("dst")))
    return edges.select("source_meeting", ends.alias("entity")).distinct()


def bridging(edges: DataFrame, least: int = 2) -> DataFrame:
    return endpoint_meetings(edges).groupBy("entity").agg(F.count("*").alias("meetings")).where(F.col("meetings") >= least)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, type, n: totals and counts by type, of nodes and edges."""
    by = lambda df, kind: df.rollup("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.coalesce("type", F.lit("*")).alias("type"), "n")
    return by(nodes, "node").union(by(edges, "edge"))


def meeting_overlap(edges: DataFrame, diagonal: bool = False, every: bool = False) -> DataFrame:
    """a, b, n_a, n_b, both, jaccard of every pair of meetings with a common entity; other pairs share nothing.

    Pairs meet in a join on the entity.  An entity of up to HOT meetings is one key; a hotter one is dealt in
    shares of about HOT meetings, each of which meets all of its meetings, so its pairs are spread over many
    tasks.  ``diagonal`` adds each meeting with itself, ``every`` the pairs without a common entity (0 in both
    and jaccard): as many rows as pairs of meetings, dealt in the same shares."""
    ends = endpoint_meetings(edges)
    size = ends.groupBy("source_meeting").agg(F.count("*").alias("n"))
    shares = ends.groupBy("entity").agg(F.ceil(F.count("*") / HOT).cast("int").alias("shares"))
    dealt = ends.join(shares, "entity")
    left = dealt.select("entity", F.col("source_meeting").alias("a"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = dealt.select("entity", F.col("source_meeting").alias("b"), F.pmod(F.xxhash64("source_meeting"), "shares").cast("int").alias("share"))
    order = "a <= b" if diagonal else "a < b"
    both = left.join(right, ["entity", "share"]).where(order).groupBy("a", "b").agg(F.count("*").alias("both"))
    one = lambda m: size.select(F.col("source_meeting").alias(m), F.col("n").alias(f"n_{m}"))
    if every:
        k = size.agg(F.greatest(F.ceil(F.count("*") / HOT), F.lit(1)).cast("int").alias("shares"))  # one row
        left = one("a").crossJoin(F.broadcast(k)).select("a", "n_a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        right = one("b").crossJoin(F.broadcast(k)).select("b", "n_b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"))
        met = left.join(right, "share").where(order).join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    else:
        met = both.join(one("a"), "a").join(one("b"), "b")
    return met.select("a", "b", "both", "n_a", "n_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def roster_missing(roster: DataFrame, nodes: DataFrame) -> DataFrame:
    return roster.join(nodes.select("name"), "name", "left_anti")


def checklist(nodes: DataFrame, edges: DataFrame, roster: DataFrame) -> DataFrame:
    """check, ok, extra: nodes and edges exist, types and relations are known, dates parse, endpoints exist, roster complete."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    names = nodes.select(F.col("name").alias("_n"))
    dangling = edges.select(F.explode(F.array("src", "dst")).alias("_n")).join(names, "_n", "left_anti")
    bad = [
        count(nodes.where(~F.col("type").isin(schema.ENTITY_TYPES)), "entity types are known"),
        count(edges.where(~F.col("type").isin(schema.RELATION_TYPES)), "relation types are known"),
        count(nodes.where(~fx.node_label_ok("type")), "node labels are safe"),
        count(nodes.where(fx.is_placeholder("name")), "no speaker label is a node"),
        count(edges.where("stated_at IS NULL"), "every edge has a time"),
        count(dangling, "every endpoint is a node"),
        count(roster_missing(roster, nodes), "every attendee is a node"),
    ]
    rows = bad[0]
    for b in bad[1:]:
        rows = rows.union(b)
    have = edges.agg(F.count("*").alias("n")).select(F.lit("the graph has edges").alias("check"), F.when(F.col("n") > 0, 0).otherwise(1).alias("n"))
    return rows.union(have).select("check", (F.col("n") == 0).alias("ok"), F.col("n").cast("long").alias("extra"))
