"""Registered queries run over the whole job: the operators' own settings, whole texts."""

import inspect

import pytest

from parlance import schema
from parlance.operators import labels, trainer
from parlance.plans import base, catalog
from parlance.sources import transcripts


@pytest.mark.parametrize("name,regimes", [("student_train", ["naive"]), ("replay_regime", ["naive", "replay", "fkd", "kd"])])
def test_training_runs_in_full(spark, sf_dir, monkeypatch, name, regimes):
    seen = {}

    def record(rows, grid, tasks, m=10, epochs=inspect.signature(trainer.train_runs).parameters["epochs"].default):
        seen.update(epochs=epochs, runs={(r.regime, r.seed) for r in grid.collect()}, ids=grid.select("run_id").distinct().count())
        return spark.createDataFrame([], "run_id string, stage int, row_id long, gold int, pred int")

    monkeypatch.setattr(trainer, "train_runs", record)
    catalog.QUERIES[name](spark, sf_dir)
    assert seen["epochs"] == schema.TRAINING["epochs"]
    assert seen["runs"] == {(r, s) for r in regimes for s in schema.TRAINING["seeds"]} and seen["ids"] == len(seen["runs"])


def test_split_search_takes_all_restarts(spark, sf_dir, monkeypatch):
    default, seen, search = inspect.signature(labels.search_split).parameters["restarts"].default, [], labels.search_split
    monkeypatch.setattr(labels, "search_split", lambda counts, restarts=default: seen.append(restarts) or search(counts, restarts=restarts))
    catalog.QUERIES["task_split_search"](spark, sf_dir).collect()
    assert seen == [200]


def test_legacy_parser_reads_whole_turns(spark, sf_dir, monkeypatch):
    seen, parse = [], transcripts.parse_text
    monkeypatch.setattr(transcripts, "parse_text", lambda files, strict=True: seen.append(files) or parse(files, strict))
    catalog.QUERIES["parse_legacy_transcript"](spark, sf_dir)
    content = {r.stem: r.content for r in seen[0].collect()}
    turns = base.utterances(spark, sf_dir).collect()
    assert any("\n" in r.text for r in turns)
    assert all(f": {r.text}\nstray line" in content[str(r.meeting_id)] for r in turns)


def test_srt_parser_joins_lines_of_whole_turns(spark, sf_dir):
    """Lines join up to a blank one; what follows it has no clock and is left out."""
    turns = [r for r in base.utterances(spark, sf_dir).collect() if "\n" in r.text]
    files = [(str(k), f"1\n00:00:01,000 --> 00:00:02,500\n[SPEAKER_1]: {r.text}\n") for k, r in enumerate(turns)]
    got = {r.meeting_id: r.text for r in transcripts.parse_srt(spark.createDataFrame(files, "stem string, content string"), strict=False).collect()}
    assert len(turns) > 0
    for k, r in enumerate(turns):
        lines = [x.strip() for x in r.text.split("\n")]
        cut = lines.index("", 1) if "" in lines[1:] else len(lines)
        assert got[str(k)] == " ".join(x for x in lines[:cut] if x)
