"""Questions, scoring blocks, teacher cache, track data, provenance and line-wise files."""

import hashlib
import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parlance import schema
from parlance.operators import provenance, questions, teacher, tracks, triples
from parlance.plans import base, reports, study_queries
from parlance.sources import blocks, transcripts
from parlance.sources.scratch import new_folder

EDGE = "edge_id long, src string, dst string, type string, source_meeting string, stated_at timestamp_ntz, utterance_time double"


@pytest.fixture(scope="module")
def edges(spark):
    from datetime import datetime

    rows = [(k, "Ann", f"Plan {k % 3}", "approved" if k % 2 else "discussed", f"m{k % 4}", None if k == 5 else datetime(2024, 1, 1, 10, k % 60), float(k)) for k in range(12)]
    return spark.createDataFrame(rows, EDGE)


def ask(spark, edges, *qs, cap=200, attempts=3):
    df = spark.createDataFrame(list(qs), "question_id int, keywords array<string>, relations array<string>, meetings array<string>")
    tried, found, answers = questions.ask_all(edges, df, cap, attempts)
    return [r.asDict() for r in tried.orderBy("question_id", "attempt").collect()], found.orderBy("question_id", "place").collect(), {r.question_id: r for r in answers.collect()}


def test_misspelt_limits_are_mended_one_an_attempt(spark, edges):
    tried, found, answers = ask(spark, edges, (1, ["plan"], ["aproved", "discussed"], ["m1", "M9x"]))
    assert [(r["action"], r["error"], r["rows_found"], r["chosen"]) for r in tried] == [("asked", "unknown relation aproved", None, False), ("repaired", "unknown meeting M9x", None, False), ("repaired", None, 6, True)]
    assert tried[0]["relations"] == ["aproved", "discussed"] and tried[1]["relations"] == ["approved", "discussed"] and tried[2]["meetings"] == ["m1", "m0"]
    assert answers[1].history == "attempt 1 failed: unknown relation aproved; attempt 2 failed: unknown meeting M9x" and answers[1].n_rows == 6


def test_broadening_and_budget(spark, edges):
    tried, found, answers = ask(spark, edges, (1, ["plan 2 zzz"], ["approved"], ["m1"]), (2, ["nobody here"], ["aproved"], None), (3, [], None, []), (4, ["plan"], ["discused"], None))
    by = defaultdict(list)
    for r in tried:
        by[r["question_id"]].append(r)
    assert [(r["action"], r["rows_found"]) for r in by[1]] == [("asked", 0), ("broadened", 0), ("broadened", 12)] and by[1][2]["keywords"] == ["plan", "2", "zzz"] and by[1][1]["relations"] == []
    assert [(r["action"], r["rows_found"], r["chosen"]) for r in by[2]] == [("asked", None, False), ("repaired", 0, False), ("broadened", 0, True)]
    assert answers[2].answer == questions.NO_RESULTS and answers[2].n_rows == 0 and answers[3].answer == questions.NO_RESULTS
    assert [r["rows_found"] for r in by[4]] == [None, 6, None] and [r["chosen"] for r in by[4]] == [False, True, False]


def test_an_error_in_the_last_attempt_is_the_answer(spark, edges):
    _, _, answers = ask(spark, edges, (1, ["plan"], ["aproved"], None), attempts=1)
    assert answers[1].answer == "Query error: unknown relation aproved" and answers[1].history == ""


def test_rows_come_in_time_order_and_a_cut_is_told(spark, edges):
    _, found, answers = ask(spark, edges, (1, ["ANN"], None, None), cap=12)
    assert [r.edge_id for r in found] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 5] and answers[1].truncated  # exactly the cap counts
    _, found, answers = ask(spark, edges, (1, ["ann"], None, None), cap=5)
    assert [r.place for r in found] == [1, 2, 3, 4, 5] and answers[1].answer.splitlines()[-1] == questions.MORE % 5
    assert answers[1].answer.splitlines()[0] == "Ann -[discussed]-> Plan 0 (m0, 2024-01-01 10:00:00)"
    _, _, answers = ask(spark, edges, (1, ["ann"], None, None), cap=13)
    assert not answers[1].truncated and answers[1].answer.splitlines()[-1] == "Ann -[approved]-> Plan 2 (m1)"


def test_questions_of_an_empty_graph(spark, edges):
    tried, found, answers = ask(spark, edges.limit(0), (1, ["x"], ["approved"], ["m1"]))
    assert found == [] and [r["error"] for r in tried] == [None] * 3 and answers[1].answer == questions.NO_RESULTS


# --- scoring blocks

GOOD = {
    "line10_gold_I_minus_gold": "−0.05", "line10_gold_I_real": "yes", "line10_gold_sub_minus_gold": "-0.04", "line10_ratio": "0.75", "line11": "lower", "line12": "same", "line13": "partly: teacher_I, perm_I",
    "line13_controls": "not_real", "line14_pct": "50%", "line14_expect": "fails", "line15_pp": "5", "line15_expect": "holds", "line17_pct": "5e1", "line17_expect": "holds",
}


def block(pairs, head="rq3-scoring:", tail=""):
    return f"# title\nline11 = higher\n{head}\n" + "\n".join(f"  {k} = {v}  " for k, v in pairs) + f"\n{tail}"


def problems(spark, text, spec=None):
    texts = spark.createDataFrame([("d", text)], "doc string, text string")
    return sorted(map(tuple, blocks.read_blocks(texts, spec or blocks.block_spec(spark))[1].select("key", "problem", "value").collect()), key=repr)


def test_a_right_block_is_read_with_its_types(spark):
    texts = spark.createDataFrame([("d", block(GOOD.items(), tail="That was all.\nline99 = 1"))], "doc string, text string")
    values, bad = blocks.read_blocks(texts, blocks.block_spec(spark))
    got = {r.key: r for r in values.collect()}
    assert bad.collect() == [] and set(got) == set(GOOD)
    assert got["line10_gold_I_minus_gold"].number == -0.05 and got["line14_pct"].number == 50.0 and got["line17_pct"].number == 50.0
    assert got["line10_gold_I_real"].flag is True and got["line11"].word == "lower"
    assert got["line13"].word == "partly" and got["line13"].names == ["perm_I", "teacher_I"]


def test_every_kind_of_problem(spark):
    bad = GOOD | {"line10_ratio": "1d", "line10_gold_I_real": "Yes", "line11": "up", "line13": "partly: nobody", "line15_pp": "-", "line18": "1"}
    del bad["line12"]
    pairs = [*bad.items(), ("line14_pct", "60")]
    assert problems(spark, block(pairs)) == sorted([("line10_ratio", "not a number", "1d"), ("line10_gold_I_real", "not yes or no", "Yes"), ("line11", "not allowed", "up"), ("line13", "no such condition", "partly: nobody"), ("line15_pp", "not a number", "-"), ("line18", "unknown", "1"), ("line12", "missing", None), ("line14_pct", "given twice", "50%")], key=repr)
    assert problems(spark, block(GOOD.items(), head="scoring:")) == [(None, "no block", None)] and problems(spark, None) == [(None, "no block", None)]
    assert {p for _, p, _ in problems(spark, "rq3-scoring:\n")} == {"missing"} and len(problems(spark, "rq3-scoring:")) == len(GOOD)
    spec = blocks.block_spec(spark, [("a", "number", None, 0.0, 1.0), ("b", "partly", ["holds"], None, None)])
    assert problems(spark, "rq3-scoring:\na = 1.5\nb = partly:", spec) == [("a", "out of range", "1.5"), ("b", "not allowed", "partly:")]


def test_blanks(spark):
    texts = spark.createDataFrame([("a", "by ____ on YYYY-MM-DD"), ("b", "done"), ("c", None)], "doc string, text string")
    assert sorted(map(tuple, blocks.blanks(texts).collect())) == [("a", "YYYY-MM-DD"), ("a", "____")]


# --- teacher labelling

LEGAL = schema.DIALOGUE_RELATIONS[:4]
DIALOGUES = "dialogue_id string, text string, pairs array<struct<x: string, x_type: string, y: string, y_type: string, gold_relations: array<string>>>"


def dialogues(spark):
    pair = lambda y, *gold: ("A", "PER", y, "PER", list(gold))
    return spark.createDataFrame([("d1", "one", [pair("B", LEGAL[0]), pair("C", LEGAL[1], LEGAL[2])]), ("d2", "two", [pair("B", LEGAL[3])]), ("d3", "bad", [pair("B", LEGAL[0])]), ("d4", "one", [pair("B", LEGAL[0]), pair("C", LEGAL[1], LEGAL[2])]), ("d5", None, [])], DIALOGUES)


def logged(calls):
    def ask(text, pairs):
        with open(calls, "a") as f:
            f.write(f"{text}\n")
        if text == "bad":
            raise RuntimeError("HTTP 429")
        return "```json\nSure: " + json.dumps({"labels": [{"index": i, "relation": r} for i in range(len(pairs)) for r in (LEGAL[1], LEGAL[0], "never heard")] + [{"index": "x"}, {"index": 99, "relation": LEGAL[0]}]}) + "\n```"

    return ask


def test_a_second_run_asks_for_nothing_that_is_cached(spark, tmp_path):
    calls, cache = str(tmp_path / "calls"), new_folder(spark, "cache")
    count = lambda: Counter(open(calls).read().split("\n")[:-1])
    rows, report = teacher.label_corpus(dialogues(spark), logged(calls), cache, "m", legal=LEGAL)
    first = report.collect()[0]
    assert (first.hits, first.new, first.failed) == (0, 3, 1) and count() == {"one": 1, "two": 1, "bad": 1, "None": 1}
    assert (first.labelled, first.multilabel_dropped, first.correct, first.types_used) == (3, 2, 2, 1) and first.absent == ",".join(sorted(LEGAL[1:]))
    assert sorted((r.dialogue_id, r["index"], r.relation, r.teacher_correct) for r in rows.collect()) == [("d1", 0, LEGAL[0], True), ("d2", 0, LEGAL[0], False), ("d4", 0, LEGAL[0], True)]
    _, report = teacher.label_corpus(dialogues(spark), logged(calls), cache, "m", legal=LEGAL)
    again = report.collect()[0]
    assert (again.hits, again.new, again.failed) == (3, 0, 1) and count() == {"one": 1, "two": 1, "bad": 2, "None": 1}  # what failed is asked again
    teacher.label_corpus(dialogues(spark).where("text = 'two'"), logged(calls), cache, "m", version="v3", legal=LEGAL)[1].collect()
    assert count()["two"] == 2  # another prompt, another key


def test_corrupt_and_empty_entries_are_misses(spark, tmp_path):
    calls, cache = str(tmp_path / "calls"), new_folder(spark, "cache")
    asked = teacher.requests(dialogues(spark), "m")
    keys = {r.dialogue_id: r.key for r in asked.collect()}
    spark.createDataFrame([(keys["d1"][:2], '{"key": "' + keys["d1"] + '", "raw": "{cut off'), (keys["d2"][:2], json.dumps({"key": keys["d2"], "raw": None}))], "shard string, value string").write.partitionBy("shard").text(cache)
    hits, misses = teacher.split_cached(asked, cache)
    assert hits.count() == 0 and misses.count() == 5
    report = teacher.label_corpus(dialogues(spark), logged(calls), cache, "m", legal=LEGAL)[1].collect()[0]
    assert (report.hits, report.new, report.failed) == (0, 3, 1)
    assert teacher.read_entries(spark, cache).count() == 3


def test_each_wave_is_kept_when_a_later_one_dies(spark, tmp_path, monkeypatch):
    cache, append, seen = new_folder(spark, "cache"), teacher.append_entries, []

    def fails(entries, path):
        seen.append(path)
        if len(seen) == 2:
            raise KeyboardInterrupt
        append(entries, path)

    many = spark.range(40).select(F.col("id").cast("string").alias("dialogue_id"), F.concat(F.lit("text "), "id").alias("text"), F.array().cast(dialogues(spark).schema["pairs"].dataType).alias("pairs"))
    monkeypatch.setattr(teacher, "append_entries", fails)
    with pytest.raises(KeyboardInterrupt):
        teacher.fill_cache(teacher.requests(many, "m"), lambda t, p: "{}", cache, "m")
    kept = teacher.read_entries(spark, cache).count()
    assert 0 < kept < 40
    states = Counter(r.state for r in teacher.fill_cache(teacher.requests(many, "m"), lambda t, p: "{}", cache, "m").collect())
    assert states == {"hit": kept, "new": 40 - kept}


def test_extractor_errors_are_told(spark):
    def half(text):
        return text[: 10 // len(text)]

    rows = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    got = triples.extract_with(rows, half, "t", "raw", "error").collect()
    assert [(r.raw, r.error and r.error.split(":")[0]) for r in got] == [("ab", None), (None, "ZeroDivisionError"), (None, None)]


def test_teacher_query_against_plain_loops(spark, sf_dir):
    found = study_queries._dialogues(spark, sf_dir).collect()
    got = {r.run: r for r in study_queries.teacher_cache_resume(spark, sf_dir).collect()}
    cache, legal = {}, study_queries._LEGAL
    for run, part in enumerate(([d for d in found if int(d.dialogue_id) % 2 == 0], found)):
        keys = {(d.text, tuple((p.x, p.y) for p in d.pairs)) for d in part}
        hits = {k for k in keys if k in cache}
        for text, pairs in keys - hits:
            if len(text) % 11:
                cache[text, pairs] = {i: legal[(len(text) + i) % 5] for i in range(len(pairs))} | {0: legal[5]}
        done = [(cache[k][i], p.gold_relations) for d in part if (k := (d.text, tuple((p.x, p.y) for p in d.pairs))) in cache for i, p in enumerate(d.pairs)]
        one = [(r, g) for r, g in done if len(g) == 1]
        new = len([k for k in keys if k in cache]) - len(hits)
        r = got[run]
        assert (r.hits, r.new, r.failed) == (len(hits), new, len(keys) - len(hits) - new)
        assert (r.labelled, r.multilabel_dropped, r.correct, r.types_used) == (len(one), len(done) - len(one), sum(r_ in g for r_, g in one), len({r_ for r_, _ in one}))
    assert got[1].hits > 0 and got[1].new > 0


# --- track data and provenance


def test_track_rows_meet_their_vectors_without_a_shuffle(spark):
    store = tracks.TrackStore(spark, buckets=4)
    store.write_vectors(spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") != 7, F.array(F.col("id").cast("float"))).alias("x")))
    rows = spark.range(0, 120, 2).select(F.col("id").alias("row_id"), F.lit(1).alias("gold"), F.lit(2).alias("label"), F.lit("gold_I").alias("condition"))
    store.write_labels(rows.union(rows.where("row_id < 20").withColumn("row_id", F.col("row_id") + 1).withColumn("condition", F.lit("rand_I/seed1/r0"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for condition, n in (("gold_I", 50), ("rand_I/seed1/r0", 9), (None, 59)):  # row 7 has no vector
            track = store.track(condition)
            plan = track._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            got = track.collect()
            assert len(got) == n and all(r.x == [float(r.row_id)] for r in got)
        assert "PartitionFilters: [isnotnull(condition" in store.track("gold_I")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.condition, r.row_id) for r in store.lost().collect()) == [("gold_I", k) for k in range(100, 120, 2)] + [("rand_I/seed1/r0", 7)]


def test_track_query_against_plain_loops(spark, sf_dir):
    rows = base.labels(spark, sf_dir).collect()
    x = {r.row_id: sum(map(float, r.x)) for r in base.vectors(spark, sf_dir).collect()}
    want, kept = defaultdict(lambda: [0, 0.0]), study_queries.KEPT
    for r in rows:
        both = r.gold in kept and r.teacher in kept
        for condition, ok, label in (("gold", r.gold in kept, r.gold), ("teacher", r.teacher in kept, r.teacher), ("gold_I", both, r.gold), ("teacher_I", both, r.teacher)):
            if ok:
                want[condition, label][0] += 1
                want[condition, label][1] += x[r.row_id]
    got = {(r.condition, r.label): (r.rows, r.total) for r in study_queries.track_vectors(spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == n and got[k][1] == pytest.approx(t, abs=1e-3) for k, (n, t) in want.items())


def test_digests_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("a", k, k % 3) for k in range(50)] + [("b", k, k % 3) for k in range(49, -1, -1)] + [("c", k, (k + 1) % 3) for k in range(50)] + [("d", 1, 1), ("d", 1, 1)], "c string, row_id long, label int")
    got = {r.c: (r.rows, r.digest) for r in provenance.condition_digests(rows.repartition(7), ["c"]).collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"][0] == 2


def test_plan_and_provenance(spark):
    runs = provenance.plan_runs(spark)
    assert runs.count() == 54 * 3  # 54 runs a replicate
    digests = spark.createDataFrame([("gold_I", None, 9, "d0"), ("rand_I", 101, 9, "d1")], "track string, draw_seed int, rows long, digest string")
    got = {(r.track, r.regime, r.seed, r.replicate): r for r in provenance.provenance(runs, digests, "abc-dirty").collect()}
    r = got["rand_I", "naive", 1, 1]
    assert (r.run_id, r.init_seed, r.draw_seed, r.condition_digest, r.git_hash, r.dirty) == ("rand_I_naive_1_i101", 101, 101, "d1", "abc", True)
    assert got["gold_I", "naive", 1, 2].condition_digest == "d0" and got["rand_I", "naive", 2, 0].condition_digest is None
    assert json.loads(r.settings)["lr"] == schema.TRAINING["lr"] and r.settings_hash == hashlib.sha256(r.settings.encode()).hexdigest()[:16]


def test_guards(spark):
    digests = spark.createDataFrame([("gold_I", None, 9, "d0"), ("rand_I", 1, 9, "d1")], "track string, draw_seed int, rows long, digest string")
    runs = provenance.plan_runs(spark, [1], [0], {"gold_I": ["joint"], "rand_I": ["naive", "fkd"], "gold": ["replay"]})
    done = lambda *rows: spark.createDataFrame(list(rows), "track string, regime string, seed int, replicate int, schedule string, git_hash string")
    planned = provenance.provenance(runs, digests, "abc")
    tell = lambda p, saved, there: sorted(map(tuple, provenance.guards(p, saved, there).collect()))
    assert tell(planned.where("regime <> 'fkd'"), digests, done()) == []
    provenance.require(provenance.guards(planned.where("regime <> 'fkd'"), digests, done()))
    changed = digests.where("track = 'gold_I'").withColumn("digest", F.lit("other"))
    found = tell(planned, changed, done(("gold", "replay", 1, 0, "primary", "0ld")))
    assert found == [("gold_I_joint_1_i1", "condition differs"), ("gold_replay_1_i1", "run is there"), ("gold_replay_1_i1", "runs of other code"), ("rand_I_fkd_1_i1", "no saved condition"), ("rand_I_fkd_1_i1", "regime not of condition"), ("rand_I_naive_1_i1", "no saved condition")]
    with pytest.raises(ValueError, match="gold_I_joint_1_i1: condition differs"):
        provenance.require(provenance.guards(planned, changed, done()))
    dirty = provenance.provenance(provenance.plan_runs(spark, [1], [2], {"gold": ["naive"]}, "fixed"), digests, "abc-dirty")
    assert [p for _, p in tell(dirty.union(dirty), digests, done())] == ["code has changes", "code has changes", "planned twice", "regime not in schedule", "regime not in schedule", "replicate without condition", "replicate without condition"]


# --- reports


def test_key_table_rules(spark):
    rows = []
    for seed in (1, 2, 3):
        for r in range(3):
            rows += [("up", "joint", seed, r, 0.5, 0.2), ("up", "replay", seed, r, 0.5 + (0.1 if seed < 3 else 0.01), 0.2), ("up", "joint_balanced", seed, r, 0.4, 0.2 + (0.05 if r else -0.05))]
            rows += [("alone", "joint", seed, r, 0.5, 0.2), ("alone", "replay", seed, r, 0.3, 0.1)]
    got = {(r.condition, r.seed): r for r in reports.key_table(spark.createDataFrame(rows, "condition string, regime string, seed int, replicate int, f1 double, share double")).collect()}
    assert len(got) == 8 and got["up", None].rule_replay == "real-positive" and got["up", None].rule_bal == "real-negative" and got["up", None].rule_share_bal == "none"
    assert got["alone", None].rule_replay == "real-negative" and got["alone", None].rule_bal is None and got["alone", 1].sign_bal is None
    assert (got["up", 1].sign_replay, got["up", 3].sign_replay, got["up", 1].sign_share_bal) == (1, 0, 0) and got["up", None].delta_replay is None
    assert got["up", 1].low_share_bal == pytest.approx(-0.05) and got["up", 1].high_share_bal == pytest.approx(0.05)


def test_task_rows_count_absent_classes(spark):
    rows = spark.createDataFrame([("a", 0)] * 20 + [("a", 1)] * 3 + [("b", 2)] * 15 + [("b", 9)], "condition string, label int")
    tasks = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "label int, task int")
    got = {r.condition: r for r in reports.task_rows(rows, tasks, ["condition"]).collect()}
    assert (got["a"].rows, got["a"].per_task, got["a"].min_share, got["a"].thin) == (23, [23, 0], 0.0, "1 3, 2 0, 3 0")
    assert (got["b"].rows, got["b"].per_task, got["b"].task_share, got["b"].thin) == (15, [0, 15], [0.0, 1.0], "0 0, 1 0, 3 0")


# --- line-wise files


def test_lines_are_numbered_over_splits(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 2000), ("b.txt", 3), ("empty.txt", 0)):
        lines = [f"{name} {k} " + "x" * (k % 40) for k in range(n)]
        (tmp_path / name).write_text("".join(line + "\n" for line in lines))
        want |= {(name, k + 1): line for k, line in enumerate(lines)}
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbffirst\r\nsecond")
    want |= {("bom.txt", 1): "first", ("bom.txt", 2): "second"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = transcripts.numbered_lines(spark, str(tmp_path / "*.txt"))
        assert rows.rdd.getNumPartitions() > 1
        got = {(r.path.rpartition("/")[2], r.no): r.line for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_jsonl_query_against_plain_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append(r)
    got = study_queries.ami_jsonl_lines(spark, sf_dir).collect()
    lost = [r for r in got if r.meeting_id == "(rejected)"]
    assert len(lost) == sum(c % 10 in (3, 7) for c in by)
    want = sorted((f"ami_{c}", k, "SPEAKER_" + t.role[0].upper(), " ".join(t.text.split()), 4.0 * k) for c, ts in by.items() if c % 10 not in (3, 7) for k, t in enumerate(sorted(ts, key=lambda t: t.turn)))
    assert sorted((r.meeting_id, r.seq, r.speaker_id, r.text, r.start_time) for r in got if r not in lost) == want


# --- from transcripts to a graph


def test_meeting_run_query_against_plain_loops(spark, sf_dir):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by[r.conv_id].append(r)
    want = []
    for c in sorted(by, key=str):
        turns = [t.role for t in sorted(by[c], key=lambda t: t.turn)]
        labels = sorted(set(turns))
        names = {"user": "Asha Rao"} if "user" in labels else {}
        if len(labels) == 2 and len(names) == 1:
            names[next(x for x in labels if x != "user")] = "Ben Kim"
        said, first = [names.get(t, t) for t in turns], 0
        while True:
            who = sorted(set(said[first : first + 4]))
            if len(who) > 1:
                want.append((who[0], "discussed_with", who[1], str(c), 4.0 * first))
                break
            if first + 4 >= len(said):
                break
            first += 3
    got = study_queries.meeting_graph_run(spark, sf_dir).orderBy("edge_id").collect()
    assert sorted((r.src, r.type, r.dst, r.source_meeting, r.utterance_time) for r in got) == sorted(want) and len(want) > 10
    assert [r.source_meeting for r in got] == sorted(r.source_meeting for r in got)
    assert all((r.stated_at is not None) == (int(r.source_meeting) % 2 == 0) for r in got)


def test_failed_windows_are_told_and_others_stay(spark):
    from parlance.plans import meetings

    u = spark.createDataFrame([("m", k, f"SPEAKER_{k % 2}" if k < 4 else f"P{k % 3}", f"line {k}", 4.0 * k, 4.0 * k + 4) for k in range(10)], "meeting_id string, seq int, speaker_id string, text string, start_time double, end_time double")

    def fussy(prompt):
        if "line 9" in prompt:
            raise TimeoutError("late")
        if "line 4" in prompt:
            return "no json at all"
        return json.dumps({"triples": [{"subject": "SPEAKER_0", "relation": "Discussed", "object": "Plan"}, {"subject": "Dr. Ann", "subject_type": "PERSON", "relation": "approved", "object": "Plan", "utterance_time": "5"}, {"subject": "ann", "subject_type": "PERSON", "relation": "approved", "object": "plan", "deadline_date": "2026-03-01", "utterance_time": "999"}, {"subject": "", "relation": "x", "object": "y"}]})

    made = meetings.run_meetings(u, fussy, size=4, overlap=0)
    c = made.coverage.collect()[0]
    assert (c.windows_total, c.windows_failed, c.windows_unparsed, c.windows_extracted) == (3, 1, 1, 2)
    assert [r.error for r in made.windows.orderBy("window_id").collect()] == [None, None, "TimeoutError: late"]
    t = made.triples.collect()
    assert [(r.subject, r.relation, r.object, r.timestamp, r.deadline_date, r.window_id) for r in t] == [("Dr. Ann", "approved", "Plan", 5.0, "2026-03-01", 0)]
    assert made.adherence.collect()[0].triples_seen == 4
    kept = meetings.run_meetings(u, fussy, size=4, overlap=0, keep_placeholders=True)
    assert {r.subject for r in kept.triples.collect()} == {"SPEAKER_0", "Dr. Ann"}


# --- files there and back


def test_round_trips_keep_everything(spark, sf_dir):
    from parlance.operators import graph
    from parlance.plans.report_queries import _runs

    u = base.utterances(spark, sf_dir).collect()
    got = study_queries.transcript_round_trip(spark, sf_dir).collect()
    assert sorted((r.meeting_id, r.seq, r.speaker_id, r.text, r.start_time, r.end_time) for r in got) == sorted((str(r.meeting_id), r.seq, r.speaker_id, r.text, r.start_time, r.end_time) for r in u)
    t = base.triples(spark, sf_dir)
    nodes, edges = graph.build_nodes(t).collect(), graph.build_edges(t).collect()
    lines = [r.line for r in study_queries.graph_round_trip(spark, sf_dir).orderBy("part", "key").collect()]
    assert lines == [f"{n.name} ({n.type})" for n in sorted(nodes, key=lambda n: n.name)] + [f"{e.src} -[{e.type}]-> {e.dst} [{e.source_meeting}, {spark_time(e.stated_at)}]" for e in sorted(edges, key=lambda e: e.edge_id)]
    cells = {(f"{r.track}-{r.regime}-{r.seed}", r.t, r.j): round(r.v, 6) for r in _runs(spark, sf_dir).collect()}
    got = study_queries.run_round_trip(spark, sf_dir).collect()
    assert {r.metric for r in got} == {"f1"} and {(r.run_id, r.t, r.j): r.v for r in got} == pytest.approx(cells)


def test_transcript_files_and_folders_do_not_grow_with_the_meetings(spark, tmp_path):
    """A line a meeting in few files for the query; a file a meeting in few folders by the writer's default."""
    texts = ["plain", "two\nlines\r\nand a return\r", 'quo"te \\ \u2028 \u00e9', "", None]
    rows = [(c, t, ("user", None)[t % 2], texts[(c + t) % 5]) for c in range(300) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r) for r in base.utterances(spark, str(tmp_path)).selectExpr("CAST(meeting_id AS STRING)", "seq", "speaker_id", "text", "start_time", "end_time").collect()), key=key)
    made = study_queries.transcript_round_trip(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect()), key=key) == want and len(want) == 900
    assert len(made.inputFiles()) <= 8
    u = base.utterances(spark, str(tmp_path)).withColumn("meeting_id", F.col("meeting_id").cast("string"))
    transcripts.write_json_transcripts(u, str(tmp_path / "out"), folders=5)
    single = transcripts.read_json_transcripts(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, single.select(*made.columns).collect()), key=key) == want
    files = list((tmp_path / "out").rglob("*.json"))
    assert len(files) == 300 and len({f.parent for f in files}) == 5


def spark_time(t):
    return str(t).rstrip("0").rstrip(".") if "." in str(t) else str(t)


# --- evaluation sets, logs, strict files


def test_eval_sets_keep_single_gold_labels_of_the_split(spark):
    from parlance.operators import conditions

    pairs = spark.createDataFrame([("dev", "d", 0, ["a"]), ("dev", "d", 1, ["a", "b"]), ("dev", "d", 2, ["z"]), ("dev", "e", 0, []), ("dev", "e", 1, None), ("test", "f", 0, ["b"]), ("test", "f", 1, ["b"])], "part string, dialogue string, index int, gold_relations array<string>")
    split = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("unanswerable", 1, 2)], "relation string, task int, head_index int")
    rows, counts = conditions.eval_sets(pairs, split)
    assert sorted((r.part, r.dialogue, r["index"], r.y, r.task) for r in rows.collect()) == [("dev", "d", 0, 0, 0), ("dev", "e", 0, 2, 1), ("dev", "e", 1, 2, 1), ("test", "f", 0, 1, 1), ("test", "f", 1, 1, 1)]
    got = {r.part: r for r in counts.collect()}
    assert (got["dev"].n_examples, got["dev"].per_task, got["dev"].dropped_multilabel, got["dev"].dropped_class) == (3, [1, 2], 1, 1)
    assert (got["test"].n_examples, got["test"].per_task) == (2, [0, 2])
    at = new_folder(spark, "eval")
    assert conditions.frozen(spark, at, lambda: rows).count() == 5
    assert conditions.frozen(spark, at, lambda: rows.limit(0)).count() == 5  # read, not made again


def test_epoch_logs_and_settings_stand_in_their_runs_folders(spark, tmp_path):
    from parlance.sources import runs

    log = spark.createDataFrame([("a", 0, "task", e, 1.0 / (e + 1), 0.5) for e in (2, 0, 1)] + [("b", 1, "replay", 0, 0.1, None)], "run_id string, t int, stage string, epoch int, loss double, dev_f1 double")
    runs.write_epochs(log, str(tmp_path / "log"))
    runs.write_epochs(log.where("run_id = 'b'"), str(tmp_path / "log"))  # only its own run is replaced
    assert sorted(map(tuple, runs.read_epochs(spark, str(tmp_path / "log")).collect()), key=repr) == sorted(map(tuple, log.collect()), key=repr)
    (file,) = (tmp_path / "log/_run=a").glob("*.json")
    assert [json.loads(x)["epoch"] for x in file.read_text().splitlines()] == [0, 1, 2]
    prov = provenance.provenance(provenance.plan_runs(spark, [1], [0], {"gold": ["naive"]}), spark.createDataFrame([], "track string, draw_seed int, rows long, digest string"), "abc")
    runs.write_settings(prov, str(tmp_path / "config"))
    (file,) = (tmp_path / "config").glob("_run=*/*.json")
    told = json.loads(file.read_text())
    assert (told["run_id"], told["git_hash"], json.loads(told["settings"])["batch"]) == ("gold_naive_1_i1", "abc", 32)


def test_ami_files_without_a_turn_are_an_error(spark):
    files = spark.createDataFrame([("a", "Speaker A: hello"), ("b", "Right: so it goes")], "stem string, content string")
    assert transcripts.parse_ami_files(files, strict=False).count() == 1
    with pytest.raises(Exception, match="b"):
        transcripts.parse_ami_files(files).collect()


def test_turns_of_arrays_are_those_of_rows(spark):
    from parlance.operators import windows

    rows = spark.createDataFrame([(1, ["x", "T one", "two", "T three"]), (2, ["none"]), (3, []), (4, None), (5, ["T", "T"])], "k int, lines array<string>")
    got = [tuple(r) for r in rows.select("k", F.inline(windows.turns_of(F.col("lines"), lambda x: x.startswith("T")))).orderBy("k", "turn_no").collect()]
    assert got == [(1, 1, 2, "T one two"), (1, 2, 1, "T three"), (5, 1, 1, "T"), (5, 2, 1, "T")]
    flat = rows.select("k", F.posexplode("lines").alias("pos", "line"))
    assert got == [tuple(r) for r in windows.merge_turns(flat, "k", "pos", "line", F.col("line").startswith("T")).orderBy("k", "turn_no").collect()]


def test_joint_baselines_of_both_tracks(spark, sf_dir):
    got = study_queries.joint_baseline_tracks(spark, sf_dir).collect()
    assert {(r.track, r.run_id) for r in got} == {(t, f"joint-{s}") for t in ("gold", "teacher") for s in schema.TRAINING["seeds"]}
    assert len({(r.train_rows, r.test_rows, r.majority_accuracy) for r in got}) == 1  # one test part, judged by gold
    test = Counter(r.y for r in study_queries._training(spark, sf_dir).where("part = 'test'").collect())  # the vectors tell little of their labels, so scores are near chance
    assert got[0].test_rows == sum(test.values()) and got[0].majority_accuracy == round(max(test.values()) / sum(test.values()), 4)
    assert all(0 < r.accuracy < 1 and 0 < r.macro_f1 < 1 for r in got)
