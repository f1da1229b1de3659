"""Verdicts on a made-up grid of cells."""

from parlance.plans import scoring

EXPECTED = {"line10_gold_I_minus_gold": -0.06, "line10_gold_I_real": True, "line10_gold_sub_minus_gold": -0.09, "line10_ratio": 0.78, "line11": "lower", "line12": "same", "line13": "holds", "line13_controls": "not_real_positive", "line14_pct": 50, "line14_expect": "fails", "line15_pp": 3, "line15_expect": "holds", "line17_pct": 60, "line17_expect": "holds"}


def cells(spark, change=None):
    f1 = {("gold_I", "joint"): 0.44, ("gold_I", "replay"): 0.44, ("gold_sub", "joint"): 0.41, ("teacher_I", "joint"): 0.34, ("teacher_I", "replay"): 0.44, ("teacher_I", "joint_balanced"): 0.40, ("perm_I", "joint"): 0.345, ("perm_I", "replay"): 0.42, ("rand_I", "joint"): 0.40, ("rand_I", "replay"): 0.41}
    share = {k: 0.3 for k in f1} | {("teacher_I", "replay"): 0.1, ("perm_I", "replay"): 0.1, ("rand_I", "joint"): 0.15, ("teacher_I", "joint_balanced"): 0.15}
    f1 |= change or {}
    rows = [(c, g, s, r, f1[c, g] + 0.001 * r, share[c, g]) for c, g in f1 for s in (1, 2, 3) for r in (0, 1, 2)]
    return spark.createDataFrame(rows, "condition string, regime string, seed int, replicate int, f1 double, share double")


def test_condition_verdicts(spark):
    ref = spark.createDataFrame([(s, 0.5, 0.1) for s in (1, 2, 3)], "seed int, gold_f1 double, gold_share double")
    v = scoring.condition_verdicts(cells(spark), ref, EXPECTED)
    got = {r.line: (r.observed, r.holds) for r in v.collect()}
    assert got == {10: ("real-negative", True), 11: ("lower", True), 12: ("same", True), 13: ("holds", True), 14: ("3 of 3", True), 15: ("yes,yes,yes,yes,yes", True), 16: ("replicates ran", True), 17: ("3 of 3", True)}
    e = {r.line: r.expectation_correct for r in scoring.with_expectations(v, EXPECTED).collect()}
    assert (e[14], e[15], e[17], e[10]) == (False, True, True, None)
    assert [r.branch for r in scoring.framing(v).collect()] == ["structured noise, countered by balanced replay", "the mechanism is class balancing", "the structure that matters is class-conditional"]
    v = scoring.condition_verdicts(cells(spark, {("teacher_I", "replay"): 0.35, ("rand_I", "replay"): 0.5}), ref, EXPECTED)
    got = {r.line: (r.observed, r.holds) for r in v.collect()}
    assert got[13] == ("partly: gold_I, perm_I", False) and got[14] == ("0 of 0", False)


def test_early_lines(spark):
    drops = spark.createDataFrame([(t, s, g, d) for t in ("gold", "teacher") for s, pair in ((1, (0.3, 0.1)), (2, (0.2, 0.2)), (3, (0.2, 0.15))) for g, d in zip(("replay", "fkd"), pair)], "track string, seed int, regime string, drop double")
    assert tuple(scoring.pair_drop_verdict(drops).first()) == (4, "1", True)
    acc = spark.createDataFrame([(t, s, 0.5 + g, 0.5) for t, g in (("gold", 0.05), ("teacher", 0.04)) for s in (1, 2, 3)], "track string, seed int, fkd double, replay double")
    assert tuple(scoring.gap_verdict(acc).first()) == (5, "real gap, smaller in teacher", False)
