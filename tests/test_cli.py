import json

from parlance.__main__ import main
from parlance.sources import runs, sinks


def test_commands(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "m.txt").write_text("Speaker 0: Hi\nSpeaker 1: Yo")
    main(["windows", str(tmp_path / "m.txt")])
    assert "[SPEAKER_01] (4.0s): Yo" in capsys.readouterr().out
    (tmp_path / "triples_m1.json").write_text(json.dumps([{"subject": "Ann", "subject_type": "PERSON", "relation": "heads", "object": "CSE", "object_type": "DEPARTMENT", "timestamp": 60.0, "deadline_date": ""}]))
    (tmp_path / "dates.json").write_text(json.dumps({"m1": {"date": "2026-01-05"}}))
    main(["stats", str(tmp_path / "triples_*.json"), "--compare"])
    assert "| m1 | 1 |" in capsys.readouterr().out
    main(["ask", str(tmp_path / "triples_*.json"), "ann", "--dates", str(tmp_path / "dates.json")])
    out = capsys.readouterr().out
    assert "2026-01-05 00:01:00" in out and "attempt 1" in out
    main(["ask", str(tmp_path / "triples_*.json"), "ann", "--relation", "haeds"])
    out = capsys.readouterr().out
    assert "Ann -[heads]-> CSE" in out and "attempt 2 (attempt 1 failed: unknown relation haeds)" in out


def test_run_command(spark, tmp_path, capsys):
    (tmp_path / "m1.txt").write_text("Speaker 0: Hi\nSpeaker 1: Yo\nSpeaker 0: Bye")
    (tmp_path / "m2.txt").write_text("Speaker 3: Alone")
    (tmp_path / "roster.json").write_text(json.dumps({"m1": ["Ann Roy", "Bob Sen"]}))
    (tmp_path / "answers.jsonl").write_text(json.dumps({"meeting_id": "m1", "speaker_id": "SPEAKER_00", "name": "ann roy"}))
    (tmp_path / "dates.json").write_text(json.dumps({"m1": {"date": "2026-01-05"}}))
    main(["run", str(tmp_path / "m1.txt"), str(tmp_path / "m2.txt"), "--out", str(tmp_path / "out"), "--roster", str(tmp_path / "roster.json"), "--answers", str(tmp_path / "answers.jsonl"), "--dates", str(tmp_path / "dates.json")])
    out = capsys.readouterr().out
    assert "| 2 | 2 | 0 | 1 |" in out  # windows, extracted, failed, empty
    nodes, edges = sinks.read_graph(spark, str(tmp_path / "out/graph"))
    assert {n.name for n in nodes.collect()} == {"Ann Roy", "Bob Sen"}
    e = edges.collect()[0]
    assert (e.src, e.type, e.dst, e.source_meeting, str(e.stated_at)) == ("Ann Roy", "discussed_with", "Bob Sen", "m1", "2026-01-05 00:00:00")


def test_graph_commands(spark, tmp_path, capsys):
    row = {"subject": "Ann", "subject_type": "PERSON", "relation": "approved", "object": "Report", "object_type": "DEADLINE", "timestamp": 60.0, "deadline_date": "2026-02-01"}
    (tmp_path / "triples_m1.json").write_text(json.dumps([row, row | {"relation": "heads", "object": "CSE", "object_type": "DEPARTMENT", "deadline_date": ""}]))
    (tmp_path / "dates.json").write_text(json.dumps({"m1": {"date": "2026-01-05"}}))
    glob, dates = str(tmp_path / "triples_*.json"), ["--dates", str(tmp_path / "dates.json")]
    main(["build", glob, str(tmp_path / "graph"), *dates])
    nodes, edges = sinks.read_graph(spark, str(tmp_path / "graph"))
    assert {n.name for n in nodes.collect()} == {"Ann", "Report", "CSE"} and edges.count() == 2
    lines = [r.line for r in sinks.graph_lines(nodes, edges).orderBy("part", "key").collect()]
    assert lines[0] == "Ann (PERSON)" and lines[3] == "Ann -[approved]-> Report [m1, 2026-01-05 00:01:00]"
    main(["history", glob, "CSE"])
    out = capsys.readouterr().out
    assert "| heads | Ann |" in out and "approved" not in out
    main(["decisions", glob, "m1"])
    out = capsys.readouterr().out
    assert "approved" in out and "heads" not in out
    main(["deadlines", glob])
    assert "| 2026-02-01 | Report | m1 |" in capsys.readouterr().out


def test_report_command(spark, tmp_path, capsys):
    kind = "run_id string, track string, regime string, seed int, R_f1 array<array<double>>, R_acc array<array<double>>"
    make = lambda low: spark.createDataFrame([("a", "gold", "naive", 1, [[0.5, None], [low, 0.75]], [[0.5, None], [0.5, 0.5]]), ("b", "gold", "naive", 2, [[0.5]], [[0.5]])], kind)
    for low in (0.25, 0.0):  # the second writing replaces the first
        runs.write_runs(make(low), str(tmp_path / "runs"))
    runs.write_runs(make(0.0).where("run_id = 'b'"), str(tmp_path / "runs"))
    main(["report", str(tmp_path / "runs/*/*.json")])
    out = capsys.readouterr().out
    assert "| gold | naive | 1 | 0.3750 | -0.5000 | 0 | all | True |" in out
    assert out.count("| gold |") == 2
