"""Command line: ``python -m parlance windows|run|stats|ask|build|history|decisions|deadlines|report ...``."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import scalar as fx
from .operators import graph, questions, stats, triples, windows
from .plans import meetings, reports
from .sources import runs, sinks, transcripts


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="parlance")
    sub = parser.add_subparsers(dest="command", required=True)
    w = sub.add_parser("windows", help="cut transcripts into windows")
    w.add_argument("paths", nargs="+")
    w.add_argument("--size", type=int, default=schema.WINDOW)
    w.add_argument("--overlap", type=int, default=schema.OVERLAP)
    w.add_argument("--prefer-text", action="store_true")
    g = sub.add_parser("run", help="from transcripts to a graph")
    g.add_argument("paths", nargs="+")
    g.add_argument("--out", required=True, help="folder of triples, graph and reports")
    g.add_argument("--extractor", help="module:function from a prompt to a response; without it, speakers of a window discussed with each other")
    g.add_argument("--roster", help="JSON file of attendees a meeting")
    g.add_argument("--answers", help="JSON lines of meeting_id, speaker_id, name")
    g.add_argument("--dates", help="JSON file of meeting dates")
    g.add_argument("--size", type=int, default=schema.WINDOW)
    g.add_argument("--overlap", type=int, default=schema.OVERLAP)
    g.add_argument("--keep-placeholders", action="store_true")
    s = sub.add_parser("stats", help="health and summaries of triple files")
    s.add_argument("glob")
    s.add_argument("--compare", action="store_true", help="overlap of meetings as well")
    a = sub.add_parser("ask", help="edges about keywords, in time order")
    a.add_argument("glob")
    a.add_argument("keywords", nargs="+")
    a.add_argument("--relation", action="append")
    a.add_argument("--meeting", action="append")
    a.add_argument("--dates", help="JSON file of meeting dates")
    for name, what in (("build", "write the graph of triple files"), ("history", "edges of one entity"), ("decisions", "decisions of one meeting"), ("deadlines", "dated deadlines in order")):
        c = sub.add_parser(name, help=what)
        c.add_argument("glob")
        if name != "deadlines":
            c.add_argument("what", help={"build": "folder of the graph", "history": "name", "decisions": "meeting"}[name])
        c.add_argument("--dates", help="JSON file of meeting dates")
    r = sub.add_parser("report", help="ACC, BWT and forgetting of run folders")
    r.add_argument("glob", help="R_matrix.json files")
    r.add_argument("--metric", choices=["f1", "acc"], default="f1")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("parlance").getOrCreate()
    if args.command == "windows":
        found = windows.sliding_windows(transcripts.read_transcripts(spark, args.paths, not args.prefer_text), args.size, args.overlap)
        for r in found.orderBy("meeting_id", "window_id").select("meeting_id", "window_id", fx.render_window("utterances").alias("text")).toLocalIterator():
            print(f"--- {r.meeting_id} window {r.window_id}\n{r.text}")
        return
    if args.command == "run":
        read = lambda path, how: how(spark, path) if path else None
        answers = spark.read.schema("meeting_id string, speaker_id string, name string").json(args.answers) if args.answers else None
        module, _, name = (args.extractor or "").partition(":")
        extractor = getattr(importlib.import_module(module), name) if module else meetings.mock_response
        made = meetings.run_meetings(transcripts.read_transcripts(spark, args.paths), extractor, answers, read(args.roster, transcripts.read_rosters), read(args.dates, transcripts.read_meeting_dates), args.size, args.overlap, args.keep_placeholders)
        made.write(args.out)
        print(reports.to_markdown(made.coverage, ["windows_total"]))
        print(reports.to_markdown(made.adherence, ["triples_seen"]))
        return
    if args.command == "report":
        cells = runs.read_r_matrices(spark, args.glob).where(F.col("metric") == args.metric)
        keys = ["track", "regime", "seed"]
        print(reports.to_markdown(reports.naive_report(cells, keys), keys))
        return
    t = triples.in_order(transcripts.read_triples(spark, args.glob), ["source_meeting", "pos"])
    t = triples.dedup_triples(triples.drop_empty(triples.drop_placeholders(t)))
    day = F.lit(None).cast("string")
    if getattr(args, "dates", None):
        dates = transcripts.read_meeting_dates(spark, args.dates).withColumnRenamed("meeting_id", "source_meeting")
        t, day = t.join(dates, "source_meeting", "left"), F.col("date")
    t = t.withColumn("meeting_date", day.try_cast("date"))
    edges = graph.build_edges(t)
    if args.command == "build":
        sinks.write_graph(graph.build_nodes(t), edges, args.what)
        return
    if args.command == "history":
        print(reports.to_markdown(graph.entity_history(edges, args.what).drop("edge_id"), ["stated_at", "relation", "other"]))
        return
    if args.command == "decisions":
        print(reports.to_markdown(graph.decisions(edges, args.what).select("stated_at", "src", "type", "dst", "confidence"), ["stated_at", "src", "type", "dst"]))
        return
    if args.command == "deadlines":
        print(reports.to_markdown(graph.deadlines(graph.build_nodes(t)).select("resolved_date", "name", "last_meeting"), ["resolved_date", "name"]))
        return
    if args.command == "stats":
        print(reports.to_markdown(stats.meeting_summary(t), ["source_meeting"]))
        print(reports.to_markdown(stats.health(t), ["triples"]))
        if args.compare:
            print(reports.to_markdown(graph.meeting_overlap(edges), ["a", "b"]))
        return
    question = spark.createDataFrame([(0, args.keywords, args.relation or [], args.meeting or [])], "question_id int, keywords array<string>, relations array<string>, meetings array<string>")
    _, _, answers = questions.ask_all(edges, question)
    told = answers.first()
    print(told.answer)
    print(f"attempt {told.attempt}" + (", truncated" if told.truncated else "") + (f" ({told.history})" if told.history else ""))



if __name__ == "__main__":
    main()
