"""A run from transcripts to a graph: names, windows, extraction, resolution, deduplication, nodes and edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx
from ..operators import graph, resolve, speakers, tagger, triples, windows
from ..sources import sinks
from ..sources.scratch import stored


@dataclass
class MeetingRun:
    """What a run made: tables of utterances (named), windows with their responses, triples, nodes, edges and one-row reports."""

    utterances: DataFrame
    windows: DataFrame
    triples: DataFrame
    nodes: DataFrame
    edges: DataFrame
    coverage: DataFrame
    adherence: DataFrame

    def write(self, path: str) -> None:
        """Triples a folder a meeting, the graph, and both reports, under ``path``."""
        sinks.write_triples(self.triples, f"{path}/triples")
        sinks.write_graph(self.nodes, self.edges, f"{path}/graph")
        sinks.write_report(self.coverage, f"{path}/coverage")
        sinks.write_report(self.adherence, f"{path}/adherence")


def mock_response(text: str) -> str:
    """A response without a model: the first two speakers of a window, by name, discussed with each other."""
    import json
    import re

    who = sorted(set(re.findall(r"^\[([^\]]*)\] \(", text, re.M)))
    found = [{"subject": who[0], "subject_type": "PERSON", "relation": "discussed_with", "object": who[1], "object_type": "PERSON", "confidence": 0.9}] if len(who) > 1 else []
    return json.dumps({"triples": found})


def extract_meetings(cut: DataFrame, extractor: Callable[[str], str], dates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows with raw, error, items; triples) of every window of every meeting.

    ``extractor`` gets the prompt of a window: the meeting's date where there is one, then the rendered
    utterances.  A triple carries its meeting, window and place in the response; its time is the cited one if
    that lies in the window, else the window's start.  A window whose call fails has no triples, and an error."""
    dates = cut.sparkSession.createDataFrame([], "meeting_id string, date string") if dates is None else dates
    of = dates.select(F.col("meeting_id").cast("string").alias("of"), F.col("date").alias("meeting_date"))
    asked = cut.join(of, F.col("meeting_id").cast("string") == F.col("of"), "left").drop("of")
    first, last = F.col("utterances")[0]["start_time"], F.array_max(F.transform("utterances", lambda u: u["end_time"]))
    asked = asked.select("meeting_id", "window_id", "meeting_date", first.alias("first"), last.alias("last"), fx.render_window("utterances").alias("window_text"))
    asked = asked.withColumn("prompt", tagger.extraction_prompt(F.col("meeting_date"), F.col("window_text")))
    said = stored(triples.parse_responses(triples.extract_with(asked, extractor, "prompt", "raw", "error")), "responses")
    keys = ["meeting_id", "window_id", "meeting_date", "window_text", "first", "last"]
    found = triples.triples_from_items(said, keys).withColumn("timestamp", fx.cited_time("utterance_time", "first", "last"))
    return said, found.drop("first", "last", "utterance_time")


def resolve_triples(found: DataFrame, roster: list[str] | None = None, alias: dict[str, str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """``found`` (mention_seq, subject, object and their types) with canonical names, by the ordered resolver.

    Subjects come before objects.  Without ``scope`` all mentions are one stream of one task."""
    scope = scope or []
    one = lambda c, k: F.struct((F.col("mention_seq") * 2 + k).alias("seq"), F.col(c).alias("name"), F.col(f"{c}_type").alias("type"))
    rows = found.select(*scope, F.explode(F.array(one("subject", 0), one("object", 1))).alias("m")).select(*scope, "m.*")
    named = resolve.resolve_exact(rows, roster, alias, scope or None).select(F.floor(F.col("seq") / 2).alias("mention_seq"), (F.col("seq") % 2).alias("k"), "resolved")
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("resolved")))
    both = named.groupBy("mention_seq").agg(pick(0).alias("_s"), pick(1).alias("_o"))
    return found.join(both, "mention_seq").withColumns({"subject": F.col("_s"), "object": F.col("_o")}).drop("_s", "_o")


def run_meetings(utterances: DataFrame, extractor: Callable[[str], str] = mock_response, answers: DataFrame | None = None, roster: DataFrame | None = None, dates: DataFrame | None = None, size: int = schema.WINDOW, overlap: int = schema.OVERLAP, keep_placeholders: bool = False, alias: dict[str, str] | None = None, scope: list[str] | None = None) -> MeetingRun:
    """The whole run over ``utterances`` (meeting_id, seq, speaker_id, text, start_time, end_time) of any number of meetings.

    ``answers`` (meeting_id, speaker_id, name) with ``roster`` (meeting_id, pos, name) name the speakers before the
    cut, and the roster's names are what similar-sounding mentions are resolved to (as many names as
    attendees of all meetings).  ``dates``: meeting_id, date.  ``scope``: columns of the triples (say, source_meeting)
    whose values are resolved apart; without them all meetings share their names, in the order of meetings."""
    if answers is not None and roster is not None:
        utterances = speakers.apply_speaker_map(utterances, speakers.name_speakers(answers, utterances, roster))
    utterances = stored(utterances, "utterances")
    cut = windows.sliding_windows(utterances, size, overlap)
    said, found = extract_meetings(cut, extractor, dates)
    found = found.withColumn("source_meeting", F.col("meeting_id").cast("string"))
    adherence = triples.adherence_report(found)
    found = triples.drop_empty(found if keep_placeholders else triples.drop_placeholders(found))
    found = stored(triples.in_order(found, ["source_meeting", "window_id", "item_pos"]), "extracted")
    names = sorted({r["name"] for r in roster.select("name").distinct().collect()}) if roster is not None else None  # attendees
    kept = stored(triples.dedup_triples(resolve_triples(found, names, alias, scope)), "triples")
    n_triples = F.coalesce(F.size("items"), F.lit(0))
    coverage = triples.coverage_report(said.select(F.col("raw").isNull().alias("failed"), (F.col("raw").isNotNull() & F.col("items").isNull()).alias("unparsed"), n_triples.alias("n_triples")))
    dated = kept.withColumn("meeting_date", F.col("meeting_date").try_cast("date"))
    return MeetingRun(utterances, said, kept, graph.build_nodes(dated), graph.build_edges(dated), coverage, adherence)
