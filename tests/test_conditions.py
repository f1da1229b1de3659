"""Label conditions, teacher labelling, run payloads, and the pieces that the command line rests on."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import schema
from parlance.operators import conditions, graph, resolve, trainer, triples
from parlance.plans import catalog
from parlance.sources import transcripts


def rows_of(spark, n=200):
    r = random.Random(3)
    return spark.createDataFrame([(i, r.randrange(6), r.randrange(6)) for i in range(n)], "row_id long, gold int, teacher int")


def test_grid_has_every_condition(spark):
    got = {(g.condition, g.seed, g.replicate): g for g in conditions.condition_grid(spark).collect()}
    assert len(got) == 3 * (2 + 3 * 3)
    for (c, s, r), g in got.items():
        assert g.init_seed == (s + 100 * r if r else None) and g.draw_seed == (s + 100 * r if c in conditions.DRAWN else None)


def test_conditions_keep_their_promises(spark):
    rows, kept = rows_of(spark), [0, 1, 2, 3]
    held = {r.row_id: r for r in rows.collect()}
    both = {i for i, r in held.items() if r.gold in kept and r.teacher in kept}
    get = lambda c, seed=None: {r.row_id: r for r in conditions.train_rows(rows, c, kept, seed).collect()}
    assert set(get("gold")) == {i for i, r in held.items() if r.gold in kept}
    assert {i: r.label for i, r in get("teacher").items()} == {i: r.teacher for i, r in held.items() if r.teacher in kept}
    assert set(get("gold_I")) == set(get("teacher_I")) == both
    perm = get("perm_I", 7)
    pairs = lambda x: sorted((held[i].gold, label) for i, label in x)
    assert pairs((i, r.label) for i, r in perm.items()) == pairs((i, held[i].teacher) for i in both)
    flips = sum(held[i].gold != held[i].teacher for i in both)
    flipped = get("rand_I", 7)
    assert set(flipped) == both and sum(r.label != r.gold for r in flipped.values()) == flips and all(r.label in kept for r in flipped.values())
    sub = get("gold_sub", 7)
    assert len(sub) == len(both) and all(r.label == held[i].gold for i, r in sub.items())
    assert get("gold_sub", 7).keys() == sub.keys() != get("gold_sub", 8).keys()
    with pytest.raises(ValueError):
        conditions.train_rows(rows, "perm_I", kept)


def test_conditions_are_written_and_frozen(spark, tmp_path):
    rows = rows_of(spark, 40)
    assert conditions.write_conditions(rows, [0, 1, 2, 3], str(tmp_path / "c"), [1]) == 11
    again = conditions.train_rows(rows, "perm_I", [0, 1, 2, 3], 101)
    assert conditions.difference(spark.read.parquet(str(tmp_path / "c/perm_I/seed1/r1")).select(again.columns), again).isEmpty()
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n)
    assert [conditions.frozen(spark, str(tmp_path / "f"), make(n)).count() for n in (3, 5)] == [3, 3] and made == [3]


def test_teacher_rows(spark):
    pairs = spark.createDataFrame([("d", 0, ["a"]), ("d", 1, ["a", "b"]), ("d", 2, ["b"]), ("d", 3, ["a"])], "dialogue string, index int, gold_relations array<string>")
    answers = spark.createDataFrame([("d", 0, 0, "b"), ("d", 1, 0, "a"), ("d", 2, 0, "zzz"), ("d", 3, 1, "a"), ("d", 4, 2, "a")], "dialogue string, pos int, index int, relation string")
    rows, report = conditions.teacher_rows(pairs, answers, ["a", "b", "c"])
    assert sorted((r["index"], r.relation, r.teacher_correct) for r in rows.collect()) == [(0, "a", True), (2, "a", False)]
    assert tuple(report.first()) == (2, 0.5, 1, 2)


def test_parameter_hash_tells_networks_apart():
    a, b = trainer.Student(4, 3, 1), trainer.Student(4, 3, 2)
    assert conditions.parameter_hash(a.w) == conditions.parameter_hash(trainer.Student(4, 3, 1).w) != conditions.parameter_hash(b.w)
    assert len(conditions.parameter_hash(a.w)) == 16


def test_balanced_epochs_draw_all_classes_alike(monkeypatch):
    y = np.array([0] * 950 + [1] * 50)
    seen = []
    net = trainer.Student(2, 2, 1)
    monkeypatch.setattr(net, "update", lambda x, y, mask, extra=None: seen.extend(y.tolist()) or 0.0)
    trainer.train_stage(net, np.zeros((1000, 2)), y, np.zeros((0, 2)), np.zeros(0, dtype=int), np.ones(2, dtype=bool), epochs=20, patience=None, balanced=True)
    assert abs(np.mean(seen) - 0.5) < 0.02


def test_training_set_beyond_a_run_is_refused(spark, monkeypatch):
    monkeypatch.setattr(trainer, "MOST_BYTES", 10)
    rows = spark.createDataFrame([(1, "train", [1.0, 2.0], 0)], "row_id long, part string, x array<double>, y int")
    with pytest.raises(ValueError):
        trainer.train_runs(rows, spark.createDataFrame([("r", "naive", 1)], "run_id string, regime string, seed int"), [[0]])


def test_each_run_is_a_task_and_holds_single_precision(spark, monkeypatch):
    """Twelve runs are twelve tasks, whatever their names hash to; vectors of floats count four bytes a number."""
    r = np.random.default_rng(1)
    data = [(i, ("train", "dev", "test")[i % 3], r.random(8).tolist(), i % 2) for i in range(60)]
    rows = spark.createDataFrame(data, "row_id long, part string, x array<float>, y int")
    grid = spark.createDataFrame([(f"{g}-{s}", g, s) for g in ("naive", "replay", "fkd", "kd") for s in schema.TRAINING["seeds"]], "run_id string, regime string, seed int")
    monkeypatch.setattr(trainer, "MOST_BYTES", 60 * (8 * 4 + 32))
    pred = trainer.train_runs(rows, grid, [[0], [1]], 3, 2).withColumn("at", F.spark_partition_id()).collect()
    places = {(p.run_id, p["at"]) for p in pred}
    assert len(places) == len({at for _, at in places}) == 12
    got = {k: [p.pred for p in sorted(pred, key=lambda p: (p.stage, p.row_id)) if p.run_id == k] for k in ("naive-1", "fkd-2")}
    x, y, part = (np.array([d[k] for d in data]) for k in (2, 3, 1))
    sets = [(x.astype(np.float32).astype(float)[part == p], y[part == p]) for p in ("train", "dev", "test")]
    for name, regime, seed in (("naive-1", "naive", 1), ("fkd-2", "fkd", 2)):
        assert np.concatenate(trainer.run_sequential(*sets, [[0], [1]], trainer.Regime(regime), seed, 3, 2)["pred"]).tolist() == got[name]


def test_edits_within_a_band():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        for most in range(6):
            d = full(a, b)
            assert resolve.edits_within(a, b, most) == (d if d <= most else None)


def test_resolver_types_and_ties():
    r = resolve.Resolver()
    assert [r.resolve("alpha one", "TOPIC"), r.resolve("alpha two", "TOPIC")] == ["alpha one", "alpha two"]
    r.resolve("Alpha One", "PROJECT")
    assert (r.type_of("alpha one"), r.type_of("alpha two")) == ("PROJECT", "TOPIC")
    near = resolve.Resolver(threshold=0.5)
    assert [near.resolve(x, "TOPIC") for x in ("abcdefgh", "abcdwxyz", "abcdzzzz")] == ["abcdefgh", "abcdefgh", "abcdefgh"]


def test_ami_token_needs_text_and_bounds(spark):
    files = spark.createDataFrame([("m", "A: hi\nB:\nABCDEFGHIJKLMNO: prose\nspeaker abcdefghijkl: yes")], "stem string, content string")
    got = [(u.speaker_id, u.text) for u in transcripts.parse_ami(transcripts.lines_of(files)).orderBy("seq").collect()]
    assert got == [("SPEAKER_A", "hi B: ABCDEFGHIJKLMNO: prose"), ("SPEAKER_ABCDEFGHIJKL", "yes")]


def test_ami_files_do_not_clash(spark, tmp_path):
    for name, text in (("a", "A: one"), ("b", "A: two")):
        (tmp_path / f"{name}.jsonl").write_text('{"dialogue": "%s"}\n{broken\n{"id": "x%s", "dialogue": "%s"}' % (text, name, text))
    got, bad = transcripts.read_ami_jsonl(spark, str(tmp_path / "*.jsonl"), limit=3)
    assert sorted((r.meeting_id, r.text) for r in got.collect()) == [("ami_1", "one"), ("ami_1", "two"), ("ami_xa", "one")]
    assert [(r.path[-7:], r.no) for r in bad.orderBy("path").collect()] == [("a.jsonl", 2), ("b.jsonl", 2)]


def test_first_of_equal_triples_stays(spark):
    rows = [(f"m{m}", p, "Ann" if p else "ann", "heads", "CSE", "" if p != 2 else "2026-01-02", 1.0 * p) for m in range(4) for p in range(5)]
    t = spark.createDataFrame(rows, "source_meeting string, pos int, subject string, relation string, object string, deadline_date string, timestamp double").repartition(7)
    t = triples.in_order(t, ["source_meeting", "pos"])
    assert sorted((r.source_meeting, r.pos, r.mention_seq) for r in t.collect()) == [(f"m{m}", p, 5 * m + p) for m in range(4) for p in range(5)]
    assert sorted((r.source_meeting, r.pos, r.subject, r.deadline_date) for r in triples.dedup_triples(t).collect()) == [(f"m{m}", 0, "ann", "2026-01-02") for m in range(4)]


def test_overlap_with_its_diagonal_and_a_hot_entity(spark, monkeypatch):
    edges = spark.createDataFrame([("m1", "a", "b"), ("m2", "b", "c"), ("m3", "x", "y")], "source_meeting string, src string, dst string")
    got = {(r.a, r.b): (r.both, round(r.jaccard, 6)) for r in graph.meeting_overlap(edges, diagonal=True).collect()}
    assert got == {("m1", "m2"): (1, 0.333333), ("m1", "m1"): (2, 1.0), ("m2", "m2"): (2, 1.0), ("m3", "m3"): (2, 1.0)}
    assert graph.meeting_overlap(edges).count() == 1
    many = spark.range(40).select(F.concat(F.lit("m"), "id").alias("source_meeting"), F.lit("hot").alias("src"), F.concat(F.lit("own"), F.col("id") % 20).alias("dst"))
    want = {(r.a, r.b): r.both for r in graph.meeting_overlap(many).collect()}
    monkeypatch.setattr(graph, "HOT", 3)
    assert {(r.a, r.b): r.both for r in graph.meeting_overlap(many).collect()} == want and len(want) == 780 and sorted(want.values()) == [1] * 760 + [2] * 20


def test_overlap_matrix_has_pairs_without_a_common_entity(spark, tmp_path, monkeypatch):
    """Users and items of each day are its own, so no two meetings share an entity."""
    e = spark.range(30).selectExpr("id * 106 + 1 AS event_id", "timestamp_ntz '2024-01-01 08:00:00' + make_dt_interval(CAST(id % 6 AS INT)) AS ts", "id % 6 AS user_id", "'click' AS event_type", "5.0D AS value", "concat('{\"k\": ', id % 6, '}') AS props")
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = [[tuple(r) for r in catalog.QUERIES["meeting_overlap_matrix"](spark, str(tmp_path)).orderBy("a", "b").collect()]]
    monkeypatch.setattr(graph, "HOT", 2)
    got.append([tuple(r) for r in catalog.QUERIES["meeting_overlap_matrix"](spark, str(tmp_path)).orderBy("a", "b").collect()])
    days = [f"m2024010{k}" for k in range(1, 7)]
    assert got[0] == got[1] == [(a, b, 2, 2, 2 if a == b else 0) for a in days for b in days if a <= b]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert sorted(db.execute(catalog.ORACLE_SQL["meeting_overlap_matrix"]).fetchall()) == got[0]


def test_plugged_in_extractor(spark):
    def answer(text):
        if "bad" in text:
            raise RuntimeError("down")
        return '{"triples": [{"subject": "Ann", "relation": "Heads", "object": "CSE", "confidence": 0.9}]}'

    windows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "window_id int, text string")
    raw = triples.extract_with(windows, answer, "text")
    assert {r.window_id: r.raw is None for r in raw.collect()} == {1: False, 2: True, 3: True}
    got = triples.triples_from_items(triples.parse_responses(raw), ["window_id"]).collect()
    assert [(t.window_id, t.subject, t.relation) for t in got] == [(1, "Ann", "heads")]


def test_run_payload(spark):
    cells = [("r", m, t, j, v) for m in ("f1", "acc") for t, j, v in ((0, 0, 0.8), (1, 0, 0.5), (1, 1, 0.9))]
    p = conditions.run_payload(spark.createDataFrame(cells, "run_id string, metric string, t int, j int, v double"), ["run_id"]).first()
    assert p.R_f1 == [[0.8], [0.5, 0.9]] and (round(p.ACC_f1, 6), round(p.BWT_acc, 6)) == (0.7, -0.3)
    assert schema.TRAINING["seeds"]
