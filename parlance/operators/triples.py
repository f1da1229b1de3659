"""Triples: parsing of raw responses, filters, deduplication, extraction reports, simple extractors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Tolerant JSON: fences go, the first object or array counts, trailing commas are forgiven.

    Adds ``items`` (array of triple structs, null if unparsable)."""
    text = fx.strip_fences(raw)
    object_ = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    array = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    tidy = lambda c: F.regexp_replace(c, r",\s*([}\]])", "$1")
    item = "array<struct<subject: string, subject_type: string, relation: string, object: string, object_type: string, confidence: string, utterance_time: string, deadline_date: string>>"

    def from_object(c):
        return F.from_json(F.when(c != "", c), f"struct<triples: {item}>")["triples"]

    def from_array(c):
        return F.from_json(F.when(c != "", c), item)

    first_array = (F.instr(text, "[") > 0) & ((F.instr(text, "{") == 0) | (F.instr(text, "[") < F.instr(text, "{")))
    tries_a = [from_array(array), from_array(tidy(array)), from_object(object_), from_object(tidy(object_))]
    tries_o = [*tries_a[2:], *tries_a[:2]]
    return responses.withColumn("items", F.when(first_array, F.coalesce(*tries_a)).otherwise(F.coalesce(*tries_o)))


def triples_from_items(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """A row an item, with defaults; items whose confidence is no number go."""
    rows = parsed.select(*keys, F.posexplode("items").alias("item_pos", "i"))
    text = lambda c: fx.strip(F.coalesce(F.col(c), F.lit("")))
    kind = lambda c: F.upper(F.when(text(c) == "", "UNKNOWN").otherwise(text(c)))
    confidence = F.when(F.col("i.confidence").isNull(), 0.8).otherwise(F.col("i.confidence").try_cast("double"))
    out = rows.select(*keys, "item_pos", text("i.subject").alias("subject"), kind("i.subject_type").alias("subject_type"), fx.normalize_relation(text("i.relation")).alias("relation"), text("i.object").alias("object"), kind("i.object_type").alias("object_type"), confidence.alias("confidence"), F.col("i.utterance_time").alias("utterance_time"), fx.iso_date(F.coalesce("i.deadline_date", F.lit(""))).alias("deadline_date"))
    return out.where("confidence IS NOT NULL")


def in_taxonomy(relation="relation"):
    return F.col(relation).isin(schema.RELATION_TYPES)


def drop_placeholders(triples: DataFrame) -> DataFrame:
    return triples.where(~fx.is_placeholder("subject") & ~fx.is_placeholder("object"))


def drop_empty(triples: DataFrame) -> DataFrame:
    return triples.where("subject <> '' AND relation <> '' AND object <> ''")


def in_order(triples: DataFrame, order: list[str], seq: str = "mention_seq") -> DataFrame:
    """Number the triples from 0 in the order of ``order``.

    A range sort deals them; a task numbers its own rows from the totals of the ones before it (a row a
    meeting), so no task sees all rows.  ``order`` begins with the meeting."""
    meeting = order[0]
    before = Window.orderBy(meeting).rowsBetween(Window.unboundedPreceding, -1)
    base = triples.groupBy(meeting).agg(F.count("*").alias("_n")).select(meeting, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(meeting).orderBy(*order[1:])) - 1
    return triples.withColumn("_own", own).join(base, meeting).withColumn(seq, F.col("_base") + F.col("_own")).drop("_own", "_base")


def dedup_triples(triples: DataFrame, order: str = "mention_seq") -> DataFrame:
    """First of equal (subject, relation, object) of a meeting, cases aside; a later date fills a missing one.

    One aggregation with map-side combine: nothing is sorted, and a triple said a million times moves as a
    row a task."""
    key = [F.col("source_meeting").alias("_meeting"), *(F.lower(c).alias(f"_{c}") for c in ("subject", "relation", "object"))]
    date = F.nullif(F.col("deadline_date"), F.lit(""))
    first = F.min_by(F.struct(*triples.columns), order).alias("_first")
    dated = F.min_by(date, F.when(date.isNotNull(), F.col(order))).alias("_date")
    rows = triples.groupBy(*key).agg(first, dated)
    return rows.select(*[F.coalesce("_date", F.lit("")).alias(c) if c == "deadline_date" else F.col(f"_first.{c}").alias(c) for c in triples.columns])


def coverage_report(windows: DataFrame) -> DataFrame:
    """windows (failed, unparsed, n_triples booleans and counts) -> one row."""
    total, failed = F.count("*"), F.count_if("failed")
    empty = F.count_if(~F.col("failed") & (F.col("n_triples") == 0))
    pct = F.when(total > 0, F.round(100.0 * (total - failed) / total, 1)).otherwise(0.0)
    return windows.agg(total.alias("windows_total"), (total - failed).alias("windows_extracted"), failed.alias("windows_failed"), empty.alias("windows_empty"), F.count_if("unparsed").alias("windows_unparsed"), pct.alias("coverage_pct"))


def adherence_report(triples: DataFrame) -> DataFrame:
    seen, off = F.count("*"), F.count_if(~in_taxonomy())
    labels = F.array_join(F.array_sort(F.collect_set(F.when(~in_taxonomy(), F.col("relation")))), ",")
    pct = F.when(seen > 0, F.round(100.0 * (seen - off) / seen, 1)).otherwise(0.0)
    return triples.agg(seen.alias("triples_seen"), off.alias("off_taxonomy_count"), pct.alias("adherence_pct"), labels.alias("off_taxonomy_labels"))


def extract_with(windows: DataFrame, extractor, column: str, out: str = "raw", error: str | None = None) -> DataFrame:
    """Plug in an extractor: any function from a window's text to a raw response, called once a row on the
    executors in Arrow batches.  A call that raises gives null, so one bad window never fails a meeting, and
    what it raised stands in the column ``error``, if one is named; ``parse_responses`` takes it from there.
    It may be called again if an executor is lost, so it should look into its cache first (``teacher.split_cached``)."""

    def one(text):
        try:
            return (None if text is None else extractor(text)), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:200]

    @F.pandas_udf("struct<raw: string, error: string>")
    def call(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["raw", "error"])

    called = windows.withColumn("_call", call.asNondeterministic()(F.col(column))).withColumn(out, F.col("_call.raw"))
    return (called if error is None else called.withColumn(error, F.col("_call.error"))).drop("_call")


def mock_extract(windows: DataFrame) -> DataFrame:
    """One triple for each window of two speakers or more: the first two speakers, sorted."""
    who = fx.speaker_set("utterances")
    rows = windows.withColumn("who", who).where("size(who) >= 2")
    return rows.select("meeting_id", "window_id", F.col("who")[0].alias("subject"), F.lit("PERSON").alias("subject_type"), F.lit("discussed_with").alias("relation"), F.col("who")[1].alias("object"), F.lit("PERSON").alias("object_type"), F.lit(0.9).alias("confidence"), F.col("utterances")[0]["start_time"].alias("timestamp"))


def type_pair_extract(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered pairs of a window's entities (i <> j) whose types name a relation; first pair of equal texts.

    ``entities`` has keys, pos, text, type.  Types are looked up before the pairing, so only entities
    with a partner type meet, and pairs are formed inside the window's own array."""
    pairs = entities.sparkSession.createDataFrame(schema.TYPE_PAIR_RELATIONS, "t1 string, t2 string, relation string")
    left = entities.join(F.broadcast(pairs), entities.type == pairs.t1)
    right = entities.select(*keys, F.col("pos").alias("pos2"), F.col("text").alias("text2"), F.col("type").alias("t2"))
    met = left.join(right, [*keys, "t2"]).where("pos <> pos2")
    w = Window.partitionBy(*keys, F.lower("text"), F.lower("text2")).orderBy("pos", "pos2")
    rows = met.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return rows.select(*keys, F.col("text").alias("subject"), F.col("type").alias("subject_type"), "relation", F.col("text2").alias("object"), F.col("t2").alias("object_type"), F.lit(0.5).alias("confidence"))
