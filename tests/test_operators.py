"""Operators on hand-made rows with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions import scalar as fx
from parlance.operators import graph, labels, metrics, resolve, speakers, stats, tagger, trainer, triples, vectors, windows
from parlance.plans import reports


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def utterances(spark, n, meeting="m"):
    return spark.createDataFrame([(meeting, i, f"S{i % 3}", f"t{i}", 4.0 * i, 4.0 * i + 4) for i in range(n)], schema.UTTERANCES)


@pytest.mark.parametrize("n,expected", [(89, 9), (110, 11), (143, 14), (123, 12), (134, 13), (15, 1), (16, 2), (1, 1), (0, 0)])
def test_window_counts(spark, n, expected):
    got = windows.sliding_windows(utterances(spark, n)).orderBy("window_id").collect()
    assert len(got) == expected
    assert not got or got[-1].utterances[-1].seq == n - 1
    assert all(r.utterances[0].seq == 10 * r.window_id for r in got)


def test_scalars(spark):
    lit = F.lit
    assert one(spark, fx.parse_timestamp(lit("1:02:03.5"))) == 3723.5
    assert one(spark, fx.normalize_entity(lit(" Prof.  Dr. Ann  Lee "), lit("PERSON"))) == "Dr. Ann Lee"
    assert [one(spark, fx.soundex_code(lit(x))) for x in ("Jayashree", "Jaishree", "Kumar", "Keshavan", "", "Tymczak", "Pfister", "Honeyman")] == [resolve.soundex(x) for x in ("Jayashree", "Jaishree", "Kumar", "Keshavan", "", "Tymczak", "Pfister", "Honeyman")]
    assert round(one(spark, fx.levenshtein_ratio(lit("jaishree"), lit("jayashree"))), 3) == 0.778
    assert round(one(spark, fx.levenshtein_ratio(lit("mira"), lit("meera"))), 3) == 0.6
    assert str(one(spark, fx.stated_at(lit("2026-01-05"), lit(150.0)))) == "2026-01-05 00:02:30"
    assert one(spark, fx.stated_at(lit(""), lit(1.0))) is None
    assert one(spark, fx.cited_time(lit("40.0"), lit(10.0), lit(60.0))) == 40.0
    assert one(spark, fx.cited_time(lit("999"), lit(10.0), lit(60.0))) == 10.0
    assert [one(spark, fx.node_label_ok(lit(x))) for x in ("PERSON", "A_B", "", "person", "PERSON) DETACH", "P ERSON", "123")] == [True, True] + [False] * 5
    assert [one(spark, fx.is_placeholder(lit(x))) for x in ("SPEAKER_0", "speaker_3", "SPEAKER 12", "Jayashree", "Speaker Committee", "SPEAKER_0 and Ramesh", "")] == [True] * 3 + [False] * 4
    assert one(spark, fx.grade(lit("It is NOT   specified"), [["it"]])) is False
    assert one(spark, fx.grade(lit("Cost rose by 5%"), [["cost"], ["fell", "rose"]])) is True
    assert one(spark, fx.argmax(F.array(lit(1.0), lit(3.0), lit(3.0)))) == 1
    assert abs(one(spark, fx.entropy_fraction(F.array(*[lit(0.25)] * 4))) - 1) < 1e-12
    assert one(spark, fx.base_url(lit("gemini-x"))) == "gemini"


def test_distillation_literals(spark):
    old, tau = [0, 2, 3], 0.5
    protos = {0: np.array([1.0, 0]), 1: np.array([1, 1]) / math.sqrt(2), 2: np.array([0.0, 1]), 3: np.array([-1.0, 0])}
    z, t = np.array([[2.0, -2, 1, 0], [0, 1, -1, 2]]), np.array([[1.0, 5, 0, -1], [-1, 5, 0, 1]])
    s = trainer.fkd_weights(np.eye(2), protos, old, tau)
    loss, grad = trainer.fkd_loss(z, t, s, np.array([0, 1]), old, np.ones(4, bool), 2.0)
    assert abs(loss - 0.2037091481625989) < 1e-12
    assert abs(trainer.fkd_loss(z, t, np.ones((2, 3)), np.array([0, 1]), old, np.ones(4, bool), 0.0)[0] - 0.9582440804506892) < 1e-12
    assert not grad[:, 1].any()
    rows = spark.createDataFrame([(z[i].tolist(), t[i].tolist(), s[i].tolist(), i) for i in range(2)], "z array<double>, t array<double>, s array<double>, y int")
    got = rows.agg(F.avg(fx.distillation_loss(F.col("z"), F.col("t"), F.col("s"), fx.focal_factor(F.col("z"), F.col("y"), 2.0), old)).alias("x")).first().x
    assert abs(got - 0.2037091481625989) < 1e-12


def test_responses(spark):
    fence = "`" * 3
    raw = [fence + 'json\n{"triples": [{"subject": "A", "relation": "Member Of", "object": "B", "confidence": "0.7"},]}\n' + fence, 'text [{"subject": "C", "subject_type": "person", "relation": "heads", "object": "D", "deadline_date": "next Friday"}]', "garbage", '{"triples": [{"subject": "E", "relation": "r", "object": "F", "confidence": "high"}]}']
    parsed = triples.parse_responses(spark.createDataFrame(list(enumerate(raw)), "k int, raw string"))
    assert [r.k for r in parsed.where("items IS NULL").collect()] == [2]
    got = triples.triples_from_items(parsed, ["k"]).orderBy("k").collect()
    assert [(r.k, r.subject, r.subject_type, r.relation, r.confidence, r.deadline_date) for r in got] == [(0, "A", "UNKNOWN", "member_of", 0.7, ""), (1, "C", "PERSON", "heads", 0.8, "")]


def make_triples(spark, rows):
    cols = "mention_seq long, subject string, subject_type string, relation string, object string, object_type string, deadline_date string, source_meeting string, meeting_date string, timestamp double, confidence double"
    return spark.createDataFrame(rows, cols).withColumn("meeting_date", F.to_date("meeting_date"))


def test_dedup_and_nodes(spark):
    t = make_triples(spark, [
        (0, "Ann", "PERSON", "heads", "CSE", "DEPARTMENT", "", "m1", "2026-01-05", 1.0, 0.9), (1, "ann", "PERSON", "Heads", "cse", "DEPARTMENT", "2026-01-10", "m1", "2026-01-05", 2.0, 0.9),
        (2, "Ann", "PERSON", "heads", "CSE", "DEPARTMENT", "", "m2", "2026-01-19", 3.0, 0.4), (3, "SPEAKER_1", "PERSON", "heads", "Ann", "TOPIC", "", "m2", "2026-01-19", 4.0, 0.4),
    ])
    got = triples.dedup_triples(triples.drop_placeholders(t)).orderBy("mention_seq").collect()
    assert [(r.mention_seq, r.deadline_date) for r in got] == [(0, "2026-01-10"), (2, "")]
    nodes = {r.name: r for r in graph.build_nodes(t).collect()}
    assert (nodes["Ann"].type, nodes["Ann"].first_meeting, nodes["Ann"].last_meeting, str(nodes["cse"].resolved_date)) == ("PERSON", "m1", "m2", "2026-01-10")
    assert {r.name: r.type for r in graph.build_nodes(t, "last").collect()}["Ann"] == "TOPIC"
    edges = graph.build_edges(t)
    rows, told = graph.ask(edges, ["ann"], ["no_such"])
    assert rows.count() == 4 and told == {"attempt": 2, "truncated": False}
    assert graph.ask(edges, ["ann"], cap=4)[1]["truncated"]
    assert graph.entity_history(edges, "Ann").count() == 3
    h = stats.health(t).first()
    assert (h.speaker_leaks, h.very_low, h.volume_flag) == (1, 2, "LOW")


def test_coverage(spark):
    w = spark.createDataFrame([(False, False, 2), (True, False, 0), (False, True, 0)], "failed boolean, unparsed boolean, n_triples int")
    r = triples.coverage_report(w).first()
    assert (r.windows_total, r.windows_extracted, r.windows_failed, r.windows_empty, r.windows_unparsed, r.coverage_pct) == (3, 2, 1, 1, 1, 66.7)
    assert triples.coverage_report(w.limit(0)).first().coverage_pct == 0.0


def test_speaker_naming(spark):
    u = spark.createDataFrame([("m", i, f"SPEAKER_{s}", "x", 0.0, 1.0) for i, s in enumerate([0, 0, 0, 1, 2, 2, 3])], schema.UTTERANCES)
    roster = spark.createDataFrame([("m", k, n) for k, n in enumerate(["Priya", "Keshavan", "Jayashree", "Kumar"])], "meeting_id string, pos int, name string")
    ask = lambda *a: {r.speaker_id: r.name for r in speakers.name_speakers(spark.createDataFrame([("m", f"SPEAKER_{k}", n) for k, n in a], "meeting_id string, speaker_id string, name string"), u, roster).collect()}
    assert ask((0, "priya "), (1, "Ramesh"), (2, "Jayashree"), (3, "Kumar"), (9, "Kumar")) == {"SPEAKER_0": "Priya", "SPEAKER_1": "Keshavan", "SPEAKER_2": "Jayashree", "SPEAKER_3": "Kumar"}
    assert ask((0, "Priya"), (1, "SPEAKER_1"), (2, None), (3, "Kumar")) == {"SPEAKER_0": "Priya", "SPEAKER_3": "Kumar"}
    assert ask((0, "Jayashree"), (1, "Jayashree")) == {"SPEAKER_0": "Jayashree"}


def test_exact_resolver(spark):
    r = resolve.Resolver(["Meera", "Jayashree"])
    assert [r.resolve(*x) for x in (("mira", "TOPIC"), ("mira", "PERSON"), ("mira", "TOPIC"), ("Dr. Jaishree", "PERSON"), ("CSE", "DEPARTMENT"), ("Vendor", "PERSON"), ("Ramesh Kumar Committee", "PERSON"))] == ["mira", "Meera", "Meera", "Jayashree", "Computer Science and Engineering", "Vendor", "Ramesh Kumar Committee"]
    rows = [(i, n, "TOPIC", s) for s in ("a", "b") for i, n in enumerate(["project alpha", "Project Alphas", "beta", "project alpha"])]
    got = resolve.resolve_exact(spark.createDataFrame(rows, "seq long, name string, type string, s string"), scope=["s"]).orderBy("s", "seq").collect()
    assert [x.resolved for x in got] == ["project alpha", "project alpha", "beta", "project alpha"] * 2


def test_fuzzy_blocks_lose_no_pair(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(120)]
    names = words[:60] + [w[:k] + r.choice("abc") + w[k + r.randint(0, 1) :] for w in words[:60] for k in [r.randint(0, len(w))]]
    canon = sorted(set(words))
    for threshold in (0.85, 0.7):
        got = {x.name: (x.canonical, round(x.ratio, 9)) for x in resolve.fuzzy_best(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(zip(canon, range(len(canon)))), "canonical string, pos int"), threshold).collect()}
        expected = {}
        for n in set(names):
            best = max(((resolve.ratio(n, c), -k, c) for k, c in enumerate(canon)), default=None)
            if best[0] >= threshold:
                expected[n] = (best[2], round(best[0], 9))
        assert got == expected


def test_label_draws(spark):
    r = random.Random(1)
    rows = [(i, g, g if r.random() < 0.6 else r.randrange(5)) for i in range(400) for g in [r.randrange(5)]]
    df = spark.createDataFrame(rows, "row_id long, gold int, teacher int")
    c = lambda pairs: sorted((g, t) for g, t in pairs)
    perm = labels.permute_within_class(df, 7).collect()
    assert c((x.gold, x.label) for x in perm) == c((g, t) for _, g, t in rows) and [x.label for x in sorted(perm)] != [t for *_, t in rows]
    flip = labels.random_flip(df, 7, 5).collect()
    assert sum(x.gold != x.label for x in flip) == sum(g != t for _, g, t in rows)
    sub = labels.uniform_subset(df, 50, 7).collect()
    assert len({x.row_id for x in sub}) == 50 and sub != labels.uniform_subset(df, 50, 8).collect()
    seats = {x.stratum: x.seats for x in labels.largest_remainder(spark.createDataFrame([("a", 84), ("b", 17), ("c", 25), ("d", 156)], "stratum string, size long"), 50).collect()}
    assert seats == {"a": 15, "b": 3, "c": 4, "d": 28}
    uneven = spark.createDataFrame([(i, lab) for i, lab in enumerate([0] * 500 + [1] * 100 + [2] * 20 + [3] * 5)], "row_id long, label int")
    n = {x.label: x["count"] for x in labels.balanced_draws(uneven, 10_000, 3).groupBy("label").count().collect()}
    assert all(abs(v / 10_000 - 0.25) < 0.02 for v in n.values())
    split = labels.search_split([{k: 30 + k for k in range(9)}, {k: 40 - k for k in range(9)}], restarts=10)
    assert sorted(set(split.values())) == [0, 1, 2] and split[0] == 0 and all(list(split.values()).count(t) >= 3 for t in range(3))


def test_metrics(spark):
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 5)], "gold int, pred int")
    f = {x.label: round(x.f1, 6) for x in metrics.class_f1(pred, []).collect()}
    assert f == {0: 0.666667, 1: 0.666667, 2: 0.0}
    assert trainer.macro_f1(np.array([0, 0, 1, 2]), np.array([0, 1, 1, 5])) == pytest.approx(4 / 9)
    r = spark.createDataFrame([("a", t, j, v) for t, j, v in ((0, 0, 0.8), (1, 0, 0.5), (1, 1, 0.7), (2, 0, 0.3), (2, 1, 0.6), (2, 2, 0.9))] + [("k1", 0, 0, 0.4)], "run string, t int, j int, v double")
    acc = {x.run: x.acc for x in metrics.acc(r, ["run"]).collect()}
    assert acc["a"] == pytest.approx(0.6) and acc["k1"] == 0.4
    bwt = {x.run: x.bwt for x in metrics.bwt(r, ["run"]).collect()}
    assert bwt["a"] == pytest.approx(-0.3) and bwt["k1"] is None
    assert metrics.acc(r.where("NOT (t = 2 AND j = 1)"), ["run"]).where("run = 'a'").first().acc is None
    d = spark.createDataFrame([(k, rep, v) for k, vs in enumerate([[0.05, 0.04, 0.06], [0.05, -0.01, 0.04], [0.03, 0.05, 0.05], [-0.05, -0.04, -0.06]]) for rep, v in enumerate(vs)], "k int, replicate int, d double")
    assert [x.sign for x in metrics.real_sign(d, ["k"]).orderBy("k").collect()] == [1, 0, 0, -1]
    assert metrics.direction(spark.createDataFrame([(1,), (1,), (0,)], "sign int"), []).first().direction == "real-positive"
    log = spark.createDataFrame([("r", e, s) for e, s in enumerate([0.1, 0.3, 0.3, 0.2, 0.25, 0.3, 0.29, 0.9])], "run string, epoch int, score double")
    x = windows.early_stop(log, ["run"], "epoch", "score").first()
    assert (x.best_epoch, x.best_score, x.stop_epoch) == (1, 0.3, 6)


def test_prototypes_and_memory(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 0.0]), (1, 0, [2.0, 0.0]), (2, 0, [4.0, 0.0]), (3, 1, [10.0, 10.0])], "row_id long, label int, x array<double>")
    p = {x.label: x.p for x in vectors.mixed_prototypes(rows, spark.createDataFrame([(2,), (3,)], "row_id long"), 0.2).collect()}
    assert p[0] == pytest.approx([2.4, 0.0])
    points = [[float(k % 8), 1.0] for k in range(11)]
    few = spark.createDataFrame([(i, 0, x) for i, x in enumerate(points)] + [(100 + i, 1, [float(i), 0.0]) for i in range(15)] + [(200 + i, 2, [1.0, 1.0]) for i in range(3)], "row_id long, label int, x array<double>")
    n = {x.label: x["count"] for x in vectors.kmeans_memory(few, 10, 1).groupBy("label").count().collect()}
    assert n == {0: 8, 1: 10, 2: 3}


def test_tagger_trims_no_accented_letters(spark):
    texts = spark.createDataFrame([(1, "«école», of éof (ofé) of! Ünder _of")], "doc_id long, text string")
    known = spark.createDataFrame([("of", "LAW"), ("École", "ORG"), ("ünder", "X")], "word string, type string")
    got = tagger.tag_words(texts, "doc_id", "text", known).orderBy("pos").collect()
    assert [(r.pos, r.text, r.type) for r in got] == [(0, "école", "ORG"), (1, "of", "LAW"), (4, "of", "LAW"), (5, "Ünder", "X")]


def test_memory_centres_come_from_every_row(spark):
    """Rows that are clusters of their own are found in a class far beyond any sample."""
    lone = {11: [0.0, 900.0], 20_011: [900.0, 0.0], 40_011: [-900.0, 0.0], 59_011: [0.0, -900.0]}
    place = F.array((F.col("id") % 6) * 40.0 + F.rand(3), F.rand(4))
    for i, v in lone.items():
        place = F.when(F.col("id") == i, F.array(*map(F.lit, v))).otherwise(place)
    rows = spark.range(60_000).select(F.col("id").alias("row_id"), F.lit(0).alias("label"), place.alias("x"))
    got = {x.row_id for x in vectors.kmeans_memory(rows, 10, 1).collect()}
    assert len(got) == 10 and set(lone) <= got
    assert {i % 6 for i in got - set(lone)} == set(range(6))


def plain_kmeans(x, k, seed, rounds=50):
    """Cluster numbers by Lloyd's rounds from one k-means++ start."""
    r = np.random.default_rng(seed)
    c = [x[r.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - p) ** 2).sum(1) for p in c], axis=0)
        c.append(x[r.choice(len(x), p=d / d.sum())])
    c, at = np.array(c), None
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if at is not None and (new == at).all():
            break
        at = new
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    return at


def test_best_of_several_starts(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((12, 2))[r.integers(12, size=400)] * 10 + r.standard_normal((400, 2))
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "row_id long, label int, x array<double>")
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    one, ten = (cost(vectors.kmeans_centres(rows, [0], 10, 1, n)[0]) for n in (1, 10))
    assert ten <= one
    assert ten <= min(cost(np.array([x[at == j].mean(0) for j in np.unique(at)])) for s in range(10) for at in [plain_kmeans(x, 10, s)]) * 1.1


def test_one_task_and_many_passes_give_one_memory(spark):
    """A class that one task fits, and the trainer's own, have the memory that passes over the table give."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal((15, 3))[r.integers(15, size=300)] * 8 + r.standard_normal((300, 3)), np.repeat(r.standard_normal((4, 3)), 10, axis=0)])
    rows = spark.createDataFrame([(i, 0 if i < 300 else 1, v.tolist()) for i, v in enumerate(x)], "row_id long, label int, x array<double>").repartition(5)
    here = {(m.label, m.row_id) for m in vectors.kmeans_memory(rows, 10, 1).collect()}
    assert here == {(m.label, m.row_id) for m in vectors.kmeans_memory(rows, 10, 1, local_rows=0).collect()}
    assert len([m for m in here if m[0] == 0]) == 10 and len([m for m in here if m[0] == 1]) == 4  # four distinct vectors
    assert {i for label, i in here if label == 0} == set(vectors.local_memory(np.arange(300), x[:300], 10, 1).tolist())


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_memory_leaves_out_what_is_no_vector(spark, local_rows):
    bad = [(100, 0, None), (101, 0, [1.0, None]), (102, 0, [float("nan"), 1.0]), (103, 0, [float("inf"), 1.0]), (104, None, [1.0, 1.0])]
    rows = spark.createDataFrame([(i, 0, [float(i), 0.0]) for i in range(30)] + bad, "row_id long, label int, x array<double>")
    got = vectors.kmeans_memory(rows, 10, 1, local_rows=local_rows).collect()
    assert len(got) == 10 and all(r.row_id < 30 for r in got)
    with pytest.raises(ValueError, match="several lengths in class 0"):
        vectors.kmeans_memory(rows.union(spark.createDataFrame([(7, 0, [1.0])], rows.schema)), 10, 1, local_rows=local_rows)
    assert vectors.kmeans_memory(rows.limit(0), 10, 1, local_rows=local_rows).collect() == []



def separable(seed=0, classes=6, per=30):
    r = np.random.default_rng(seed)
    means = r.standard_normal((classes, 12)) * 2
    x = np.concatenate([means[c] + r.standard_normal((per, 12)) for c in range(classes)])
    y = np.repeat(np.arange(classes), per)
    part = np.tile(np.repeat(["train", "dev", "test"], [20, 5, 5]), classes)
    return x, y, part


def test_training_regimes():
    x, y, part = separable()
    sets = [(x[part == p], y[part == p]) for p in ("train", "dev", "test")]
    tasks = [[0, 1], [2, 3], [4, 5]]
    run = lambda name, lam=0.7: trainer.run_sequential(*sets, tasks, trainer.Regime(name, lam), 3, 5, 15)
    naive, replay = run("naive"), run("replay")
    assert (naive["pred"][0] == replay["pred"][0]).all()  # nothing differs before the second task
    assert all((a == b).all() for a, b in zip(replay["pred"], run("fkd", 0.0)["pred"]))
    final = lambda out: (out["pred"][-1] == sets[2][1]).mean()
    assert final(replay) > final(naive) + 0.2 and final(run("fkd")) > final(naive) + 0.2
    assert all(p.max() <= max(c for k in tasks[: t + 1] for c in k) for t, p in enumerate(naive["pred"]))
    assert all((a == b).all() for a, b in zip(naive["pred"], run("naive")["pred"]))


def test_runs_in_parallel(spark):
    x, y, part = separable()
    rows = spark.createDataFrame([(i, p, v.tolist(), int(c)) for i, (v, c, p) in enumerate(zip(x, y, part))], "row_id long, part string, x array<double>, y int")
    grid = spark.createDataFrame([("a", "naive", 1), ("b", "replay", 1)], "run_id string, regime string, seed int")
    pred = trainer.train_runs(rows, grid, [[0, 1, 2], [3, 4, 5]], 5, 8)
    tasks = spark.createDataFrame([(c, c // 3) for c in range(6)], "gold int, task int")
    r = metrics.r_matrix(pred.join(tasks, "gold"), ["run_id"])
    acc = {v.run_id: v.acc for v in metrics.acc(r, ["run_id"]).collect()}
    assert acc["b"] > acc["a"]


def test_reports(spark):
    r = spark.createDataFrame([(tr, reg, s, t, j, 0.5 + 0.1 * j - 0.05 * (t - j) + s / 1000) for tr in ("gold", "teacher") for reg in ("naive", "replay") for s in (1, 2) for t in range(3) for j in range(t + 1)], "track string, regime string, seed int, t int, j int, v double")
    main = reports.main_table(r)
    assert main.count() == 4 and "bwt_1" in main.columns and main.first().acc_1234 is None
    text = reports.to_markdown(main.select("track", "regime", "acc_1"), ["track", "regime"])
    assert text.startswith("| track | regime | acc_1 |\n") and "0.5510" in text
    assert reports.to_csv(main.select("track", "acc_1234"), ["track"]).splitlines()[1] == "gold,"
    fixed = reports.fixed_schedule_table(r, spark.createDataFrame([("gold", 1, 0)], "track string, seed int, task int")).where("track = 'gold' AND seed = 1").first()
    assert fixed.forgetting == "t1 -0.050"
    cells = spark.createDataFrame([("c", 0, 0.5), ("c", 1, 0.4), ("d", 0, 0.7)], "k string, replicate int, v double")
    assert {x.k: x.cell for x in reports.spread_cell(cells, ["k"], "v").collect()} == {"c": "0.500 [0.400, 0.500]", "d": "0.700"}
    acc = spark.createDataFrame([(t, s, 0.2, 0.5, 0.51) for t in ("gold", "teacher") for s in (1, 2, 3)], "track string, seed int, naive double, replay double, fkd double")
    ratios = spark.createDataFrame([(1, 2.0, 2.04), (2, 2.0, 2.2)], "seed int, ratio double, reference double")
    shares = spark.createDataFrame([(1, 0.5, 0.4), (2, 0.5, 0.4), (3, 0.5, 0.5)], "seed int, before double, after double")
    kd = spark.createDataFrame([(1, 0.5, 0.4), (2, 0.4, 0.4)], "seed int, kd double, replay double")
    got = {x.line: x.holds for x in reports.score_predictions(ratios, acc, shares, kd).collect()}
    assert got == {"0": False, "1": True, "2": True, "3": True, "6": True, "7": True, "8": False}
    drops = spark.createDataFrame([("x", 0, 0.3), ("y", 1, 0.1), ("z", 0, 0.2)], "label string, task int, drop double")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    assert {(p.a, p.b): p.drop for p in reports.analogous_drops(drops, pairs).collect()} == {("x", "y"): 0.3, ("x", "z"): None}


def test_graph_stream(spark, tmp_path):
    import json
    import os

    from parlance.streaming import meetings

    kind = "mention_seq long, subject string, subject_type string, relation string, object string, object_type string, deadline_date string, source_meeting string, meeting_date date, timestamp double, confidence double"
    (tmp_path / "in").mkdir()
    for k, m in enumerate(("m1", "m2")):
        row = {"mention_seq": k, "subject": "Ann", "subject_type": "PERSON", "relation": "heads", "object": f"C{k}", "object_type": "COURSE", "deadline_date": "", "source_meeting": m, "meeting_date": f"2026-01-0{k + 1}", "timestamp": 1.0, "confidence": 0.9}
        (tmp_path / "in" / f"{m}.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"subject": "SPEAKER_1"}))
        os.utime(tmp_path / "in" / f"{m}.json", (1000 + k, 1000 + k))  # files come in order of age
    store = meetings.GraphStore(spark, str(tmp_path / "store"))
    meetings.run(meetings.read_triples(spark, str(tmp_path / "in"), kind, files=1), store, str(tmp_path / "ck")).awaitTermination()
    ann = store.nodes().where("name = 'Ann'").first()
    assert (str(ann.first_seen), str(ann.last_seen)) == ("2026-01-01", "2026-01-02") and store.edges().count() == 2
    store.update(spark.read.schema(kind).json(str(tmp_path / "in" / "m2.json")), 1)  # the last batch again
    assert store.edges().count() == 2
    batch = spark.read.schema(kind).json(str(tmp_path / "in" / "m1.json"))
    for k in range(2, 7):
        store.update(batch.limit(0) if k == 4 else batch, k)
    assert store.newest() == 6 and store.edges().count() == 6 and store.nodes().count() == 3
    assert len(list((tmp_path / "store/nodes").iterdir())) <= 4  # versions that hold a bucket's newest or the one before, and the last
    (tmp_path / "store/nodes/v=6/_SUCCESS").unlink()  # a batch whose nodes were not finished
    assert store.newest() == 5 and store.edges().count() == 5
