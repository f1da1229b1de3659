"""Parsers on small literals."""

import json

import pytest

from parlance.sources import runs
from parlance.sources import transcripts as t


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("meeting_id", "seq").collect()]


def test_legacy_and_plain(spark, tmp_path):
    write(tmp_path / "a.txt", "SPEAKER_00 (0:00:01 - 0:00:05): Good morning.\nnoise\nspeaker 01 (0:00:06 - 0:00:14): Thanks, let's begin.\n")
    write(tmp_path / "b.txt", "intro\nSpeaker 0: Right.\nOkay: so the thing is.\n\nSpeaker 12: Mm.\nSpeaker 0: x", "utf-8-sig")
    got = t.parse_text(t.read_files(spark, str(tmp_path)))
    assert rows(got, "meeting_id", "speaker_id", "text", "start_time", "end_time") == [
        ("a", "SPEAKER_00", "Good morning.", 1.0, 5.0), ("a", "SPEAKER_01", "Thanks, let's begin.", 6.0, 14.0),
        ("b", "SPEAKER_00", "Right. Okay: so the thing is.", 0.0, 4.0), ("b", "SPEAKER_12", "Mm.", 4.0, 8.0), ("b", "SPEAKER_00", "x", 8.0, 12.0),
    ]


def test_bom_and_unparsable(spark, tmp_path):
    (tmp_path / "x").mkdir()
    write(tmp_path / "x" / "c.txt", "Speaker 0: Hi", "utf-8-sig")
    assert rows(t.parse_text(t.read_files(spark, str(tmp_path / "x"))), "speaker_id", "text") == [("SPEAKER_00", "Hi")]
    (tmp_path / "y").mkdir()
    write(tmp_path / "y" / "d.txt", "this file has no speaker lines whatsoever")
    with pytest.raises(ValueError):
        t.parse_text(t.read_files(spark, str(tmp_path / "y")))


def test_srt_and_preference(spark, tmp_path):
    write(tmp_path / "m.txt", "Speaker 0: no times\n")
    write(tmp_path / "m.srt", "1\r\n00:00:07,000 --> 00:00:09,500\r\n[SPEAKER_00]: Hello\r\nthere\r\n\r\n2\n00:00:10.000 --> 00:00:11.000\nno label\n\n3\n00:00:12,000 --> 00:00:13,000\n\n\n", "utf-8-sig")
    write(tmp_path / "j.json", json.dumps({"meeting_id": "jm", "utterances": [{"speaker_id": "A", "text": "x", "start_time": 1.0, "end_time": 2.0}]}))
    got = t.read_transcripts(spark, str(tmp_path))
    assert rows(got, "meeting_id", "speaker_id", "text", "start_time", "end_time") == [("jm", "A", "x", 1.0, 2.0), ("m", "SPEAKER_00", "Hello there", 7.0, 9.5), ("m", "UNKNOWN", "no label", 10.0, 11.0)]
    assert rows(t.read_transcripts(spark, str(tmp_path), prefer_srt=False), "meeting_id", "start_time")[1] == ("m", 0.0)


def test_json_round_trip(spark, tmp_path):
    write(tmp_path / "p.txt", "Speaker 0: a\nSpeaker 1: b")
    u = t.parse_text(t.read_files(spark, str(tmp_path / "p.txt")))
    t.write_json_transcripts(u, str(tmp_path / "out"))
    assert rows(t.read_json_transcripts(spark, str(tmp_path / "out")), "meeting_id", "seq", "speaker_id", "text", "end_time") == rows(u, "meeting_id", "seq", "speaker_id", "text", "end_time")


def test_ami(spark, tmp_path):
    lines = [{"id": "1", "dialogue": "Speaker A: Cool.\nSpeaker B: Um so shall we\nRight: continue\nPM: Yeah okay."}, {"id": "2", "dialogue": "all prose here"}, {"id": "3"}]
    write(tmp_path / "d.jsonl", "\n".join([*map(json.dumps, lines), "{broken", json.dumps({"dialogue": "A: hi"})]))
    got, bad = t.read_ami_jsonl(spark, str(tmp_path / "d.jsonl"))
    assert rows(got, "meeting_id", "speaker_id", "text", "start_time") == [("ami_1", "SPEAKER_A", "Cool.", 0.0), ("ami_1", "SPEAKER_B", "Um so shall we Right: continue", 4.0), ("ami_1", "SPEAKER_PM", "Yeah okay.", 8.0), ("ami_5", "SPEAKER_A", "hi", 0.0)]
    assert [r.no for r in bad.orderBy("no").collect()] == [2, 3, 4]
    assert {r.meeting_id for r in t.read_ami_jsonl(spark, str(tmp_path / "d.jsonl"), limit=1)[0].collect()} == {"ami_1"}


def test_nxt_words(spark, tmp_path):
    xml = '<r>{}</r>'
    write(tmp_path / "ES1.A.words.xml", xml.format('<w starttime="1.0" endtime="1.2">Hello</w><w starttime="1.3" endtime="1.5">there</w><w starttime="1.5" endtime="1.5" punc="true">.</w><vocalsound starttime="2" endtime="3"/><w starttime="9.0" endtime="9.4">Later</w>'))
    write(tmp_path / "ES1.B.words.xml", xml.format('<w starttime="3.0" endtime="3.2">Yes</w>'))
    got = t.read_nxt_words(spark, str(tmp_path))
    assert rows(got, "meeting_id", "speaker_id", "text", "start_time") == [("ES1", "SPEAKER_A", "Hello there.", 1.0), ("ES1", "SPEAKER_B", "Yes", 3.0), ("ES1", "SPEAKER_A", "Later", 9.0)]


def test_dialogue_pairs(spark, tmp_path):
    units = [[["S 1: hi"], [{"x": " A ", "x_type": "PER", "y": "B", "y_type": "PER", "r": ["per:friends", "per:boss"], "t": ["pal", "x"]}, {"x": "", "y": "C", "r": [], "t": []}]], ["bad"], [["S 1: yo"], [{"x": "D", "x_type": "PER", "y": "E", "y_type": "PER", "r": ["unanswerable"], "t": []}]]]
    files = t.read_files(spark, write(tmp_path / "train.json", json.dumps(units)))
    got = t.parse_dialogue_pairs(files).orderBy("dialogue_id").collect()
    assert [(r.dialogue_id, r.x, r.gold_relations, r.trigger) for r in got] == [("train_0000", "A", ["per:friends", "per:boss"], "pal"), ("train_0002", "D", ["unanswerable"], "")]
    assert t.parse_dialogue_pairs(files, drop_unanswerable=True).count() == 1
    assert t.parse_dialogue_pairs(files, limit=1).count() == 1


def test_side_tables(spark, tmp_path):
    r = t.read_rosters(spark, write(tmp_path / "r.json", json.dumps({"m1": [" Ann ", "", "Bob"], "m2": []})))
    assert [(x.meeting_id, x.name) for x in r.orderBy("pos").collect()] == [("m1", "Ann"), ("m1", "Bob")]
    assert t.read_rosters(spark, write(tmp_path / "bad.json", "{oops")).count() == 0
    d = t.read_meeting_dates(spark, write(tmp_path / "d.json", json.dumps({"_comment": "x", "m1": {"date": "2026-01-05", "basis": "b"}})))
    assert [tuple(x) for x in d.collect()] == [("m1", "2026-01-05")]
    write(tmp_path / "triples_m7.json", json.dumps([{"subject": "a", "relation": "r", "object": "b"}]))
    got = t.read_triples(spark, str(tmp_path / "triples_*.json")).collect()
    assert [(x.source_meeting, x.subject, x.confidence) for x in got] == [("m7", "a", 1.0)]


def test_script(spark, tmp_path):
    got = t.parse_script(t.read_files(spark, write(tmp_path / "s.txt", "Title line\nANN: Hello\nmore\n\nstray\nBOB LEE: Yes\n---\ntail\nANN: End")))
    assert [(r.speaker, r.text) for r in got.orderBy("pos").collect()] == [("ANN", "Hello more"), ("BOB LEE", "Yes"), ("ANN", "End")]


def test_runs_and_scoring_block(spark, tmp_path):
    for k, seed in enumerate((1, 2)):
        d = tmp_path / f"run{k}"
        d.mkdir()
        write(d / "metrics.json", json.dumps({"meta": {"track": "gold", "regime": "naive", "seed": seed, "dirty": False, "git_hash": "h"}, "ACC_f1": 0.5}))
        write(d / "R_matrix.json", json.dumps({"run_id": f"run{k}", "track": "gold", "regime": "naive", "seed": seed, "R_f1": [[0.5, None], [0.25, 0.75]], "R_acc": [[0.5, None], [0.2, 0.7]]}))
    m = runs.read_metrics(spark, str(tmp_path / "*/metrics.json"))
    assert runs.select_runs(m, ["track", "regime", "seed"]).count() == 2
    want = spark.createDataFrame([("gold", "naive", 3)], "track string, regime string, seed long")
    with pytest.raises(ValueError):
        runs.select_runs(m, ["track", "regime", "seed"], want)
    with pytest.raises(ValueError):
        runs.select_runs(m, ["track", "regime"])
    r = runs.read_r_matrices(spark, str(tmp_path / "*/R_matrix.json"))
    assert r.where("metric = 'f1'").count() == 6
    block = runs.scoring_block(spark, write(tmp_path / "p.md", "# x\nscores:\n  a = 1\n  b = two words\n  a = 3\n  z = 9\n"), "scores", ["a", "b", "c"])
    assert {x.key: (x.value, x.problem) for x in block.collect()} == {"a": ("1", "duplicate"), "b": ("two words", None), "c": (None, "missing"), "z": ("9", "unknown")}


def test_env_and_mask():
    assert runs.load_env("A=1\n# B=2\nC = 'x y'\n", {"A": "0"}) == {"A": "0", "C": "x y"}
    assert runs.mask_secret("abcdefgh") == "abcd****"


def test_predictions_of_chosen_runs(spark, tmp_path):
    kind = "run_id string, stage int, row_id long, gold int, pred int"
    write_, path = runs.write_predictions, str(tmp_path / "p")
    write_(spark.createDataFrame([("a", 0, 1, 2, 2), ("a", 0, 2, 2, 3), ("b", 0, 1, 2, 2)], kind), path)
    write_(spark.createDataFrame([("a", 0, 1, 2, 9)], kind), path)
    assert {tuple(r) for r in runs.read_predictions(spark, path).select("run_id", "row_id", "pred").collect()} == {("a", 1, 9), ("b", 1, 2)}
    one = spark.createDataFrame([("b",), ("b",)], "run_id string")
    assert [r.run_id for r in runs.read_predictions(spark, path, one).collect()] == ["b"]


def test_split_and_features(spark, tmp_path):
    import numpy as np

    split = write(tmp_path / "split.json", json.dumps({"relation_to_task": {"b": 1, "a": 0}, "seed": 1}))
    assert [tuple(r) for r in runs.read_split(spark, split, ["z", "b", "a"]).orderBy("head_index").collect()] == [("b", 1, 0), ("a", 0, 1)]
    x = np.arange(3000, dtype="float32").reshape(1500, 2)
    np.savez(tmp_path / "c.npz", X=x, y_teacher=np.arange(1500), y_gold=np.arange(1500) % 3)
    np.savez(tmp_path / "none.npz", X=x[:0], y_teacher=np.arange(0), y_gold=np.arange(0))
    rows = runs.read_features(spark, [str(tmp_path / "c.npz"), str(tmp_path / "none.npz")]).orderBy("row_id").collect()
    assert len(rows) == 1500 and tuple(rows[1499])[:2] == ("c", 1499) and rows[1499].x == [2998.0, 2999.0] and rows[1499].gold == 2


def test_runs_of_one_schedule(spark):
    rows = spark.createDataFrame([("g", 1, "fixed", False, "h"), ("g", 1, "early", False, "h")], "track string, seed int, schedule string, dirty boolean, git_hash string")
    assert [r.schedule for r in runs.select_runs(rows, ["track", "seed"], schedule="early").collect()] == ["early"]


def test_labelled_pairs(spark, tmp_path):
    pair = {"window_text": "w", "subject": "s", "object": "o", "relation": "a", "gold_relation": "b"}
    path = write(tmp_path / "c.json", json.dumps([pair, pair | {"relation": "zzz"}, pair | {"gold_relation": None}, pair | {"relation": "b"}]))
    rows = runs.read_labelled(spark, path, ["a", "b"]).orderBy("row_id").collect()
    assert [(r.corpus, r.row_id, r.subject, r.teacher, r.gold) for r in rows] == [("c", 0, "s", 0, 1), ("c", 1, "s", 1, 1)]
