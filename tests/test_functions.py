"""Small fixed cases of column functions and operators."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagmill.functions import planning, stats, weights
from tagmill.functions import text as tx
from tagmill.operators import evaluation, forecast, intervals, ordering, planner, quality, textops, vectors, weightage


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_attribution_shares(spark):
    f = spark.createDataFrame([("A", ["B", "C"]), ("A", [])], "p STRING, s ARRAY<STRING>")
    shared = f.select(F.transform(weights.attribution(F.col("p"), F.col("s"), "shared"), lambda x: x["weight"] / 60).alias("w")).collect()
    assert [list(r.w) for r in shared] == [[0.5, 0.25, 0.25], [1.0]]
    with pytest.raises(ValueError):
        weights.attribution(F.col("p"), F.col("s"), "other")


@pytest.mark.parametrize(("values", "label"), [((15, 19, 21), "rising"), ((20, 14, 14), "falling"), ((8, 11, 3), "mixed"), ((2, 3, 2), "stable"), ((0, 1, 4), "rising")])
def test_trend(spark, values, label):
    assert spark.range(1).select(weights.trend([F.lit(float(v)) for v in values])).first()[0] == label


def test_weights_are_conserved(spark):
    items = spark.createDataFrame([(i, f"l{i}", "S", "c", "S:c", "DA") for i in range(4)], "item_id INT, label STRING, section_id STRING, cluster STRING, unit_id STRING, part STRING")
    records = spark.createDataFrame([(1, 2000, "F", 2, "DA", 0, [1, 2, 3]), (2, 2001, "F", 1, "DA", 1, []), (3, 2001, "F", 1, "DA", 2, [0])], "id INT, year INT, type STRING, marks INT, part STRING, primary INT, secondary ARRAY<INT>")
    for scheme in ("primary", "shared"):
        cube = weightage.item_year_cube(records, items, [2000, 2001], scheme)
        total = cube.agg(F.sum("marks"), F.sum("questions")).first()
        assert total[0] == pytest.approx(4) and total[1] == pytest.approx(3)
        assert cube.count() == 8
    status = {r.item_id: r.status for r in weightage.item_table(records, items, [2000, 2001]).collect()}
    assert status == {0: "asked", 1: "asked", 2: "asked", 3: "only_secondary"}


def test_nothing_asked(spark):
    items = spark.createDataFrame([(1, "l", "S", "c", "S:c", "DA")], "item_id INT, label STRING, section_id STRING, cluster STRING, unit_id STRING, part STRING")
    none = spark.createDataFrame([], "id INT, year INT, type STRING, marks INT, part STRING, primary INT, secondary ARRAY<INT>")
    row = weightage.rollup(none, items, [2000, 2001, 2002], "shared", "section").first()
    assert row.marks_total == 0 and row.share_of_part is None and row.trend == "stable"
    assert weightage.item_table(none, items, [2000]).first().status == "never_asked"
    assert weightage.cooccurrence(none, items).count() == 0


def test_half_even(spark):
    x = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, 3.5, 2.4, 2.6)], "x DOUBLE")
    assert [r[0] for r in rows(x.select(stats.half_even(F.col("x"))))] == [0, 2, 2, 4, 2, 3]
    assert rows(x.select(stats.down(F.col("x"))))[4] == (2.0,)


@pytest.mark.parametrize(("a", "b", "p"), [(19, 36, 0.0300), (0, 0, 1.0), (5, 5, 1.0), (0, 4, 0.125)])
def test_mcnemar(spark, a, b, p):
    got = spark.range(1).select(stats.binomial_two_sided(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))).first()[0]
    assert round(got, 4) == pytest.approx(p, abs=2e-4)


def test_gamma_quantiles_invert_the_distribution():
    for shape in (0.01, 0.5, 1.0, 4.1, 60.0):
        for p in (0.1, 0.9):
            q = stats.gamma_quantile(p, [shape], [1.0])[0]
            if q > 1e-280:
                assert stats.gamma_cdf([shape], [q])[0] == pytest.approx(p, abs=1e-9)
    assert stats.gamma_quantile(0.9, [1.0], [2.0])[0] == pytest.approx(-math.log(0.1) / 2)


def test_normalize(spark):
    f = spark.createDataFrame([("ProbabiliƟes and t-\ndistribuƟon, cross- validaƟon ",)], "t STRING")
    assert f.select(tx.normalize(F.col("t"))).first()[0] == "Probabilities and t-distribution, cross-validation"


def test_unicode():
    assert tx.clean_unicode("ﬁ⁡𝑥ℎ T̅") == "fixh T̅"
    assert tx.clean_unicode("≠") == "≠"
    assert tx.clean_unicode(None) is None


def test_answer_key(spark):
    text = "Q.No Session\n1\n1\nMCQ\nGA\nB\n1\n28 1 MSQ DA A 2 29\n1\nMSQ\nDA\nB; D\n2\n58 1 NAT DA 8  to 8 1 59 1 MCQ DA MTA 2\n60 1 NAT DA -0.5 to -0.25 2"
    found = spark.createDataFrame([(text,)], "t STRING").select(F.explode(textops.answer_key(F.col("t"))).alias("k")).select("k.*").withColumn("a", textops.answer(F.col("type"), F.col("raw")))
    got = {r.number: (r.raw, r.a.kind, r.a.options, r.a.low, r.a.high, r.marks) for r in found.collect()}
    assert got[29] == ("B;D", "options", ["B", "D"], None, None, 2)
    assert got[59][:2] == ("MTA", "mta")
    assert got[60][1:5] == ("range", None, -0.5, -0.25)
    assert sorted(got) == [1, 28, 29, 58, 59, 60]


def test_secondary_tags(spark):
    f = spark.createDataFrame([("A", ["A", "B", "B", "Z"], ["A", "B"])], "p STRING, s ARRAY<STRING>, allowed ARRAY<STRING>")
    assert f.select(textops.secondary_tags(F.col("p"), F.col("s"), F.col("allowed"))).first()[0] == ["B"]


def test_coverage(spark):
    f = spark.createDataFrame([("Sets, maps and graphs.", ["Sets", "maps", "graphs"]), ("Sets, maps and graphs.", ["Sets", "graphs"]), ("Sets, maps.", ["Sets", "maps", "graphs"]), ("Sets", [])], "b STRING, p ARRAY<STRING>")
    assert [r[0] for r in rows(f.select(textops.coverage_cursor(F.col("b"), F.col("p"))))] == [None, "gap", "graphs", "gap"]


def test_sections(spark):
    f = spark.createDataFrame([("One: a b. Two: c.",), ("Two: c. One: a.",)], "t STRING")
    got = f.select(textops.split_sections(F.col("t"), ["One", "Two"]).alias("s")).collect()
    assert [(x.title, x.body) for x in got[0].s] == [("One", "a b"), ("Two", "c")]
    assert got[1].s is None


def test_metrics(spark):
    f = spark.createDataFrame([("a", "P8", ["L12"], "L12", [], ["L12", "P8"], "P", "L", "c1", "c2"), ("b", "L12", [], "L12", [], ["X"], "L", "L", "c2", "c2")], "id STRING, primary STRING, secondary ARRAY<STRING>, guess_primary STRING, guess_secondary ARRAY<STRING>, ranking ARRAY<STRING>, section STRING, guess_section STRING, cluster STRING, guess_cluster STRING")
    f = f.withColumn("subset", F.lit("all"))
    s = evaluation.scores(f).first()
    assert (s.primary_accuracy, s.acceptable_accuracy, s.section_accuracy) == (0.5, 1.0, 0.5)
    r = evaluation.recall(f).first()
    assert (r.recall_at_1, r.recall_at_3, r.mrr) == (0.0, 0.5, 0.25)
    e = evaluation.set_scores(f).first()
    assert (e.tp, e.fp, e.fn) == (2, 0, 1)


def test_shrinkage(spark):
    t = spark.createDataFrame([("a", "S", 0), ("b", "S", 6), ("c", "S", 1), ("d", "S", 2)], "item_id STRING, section_id STRING, total INT")
    shape = forecast.fit_exact(t, 3)
    post = forecast.posterior(t, spark.createDataFrame([(shape,)], "shape DOUBLE"), 3, ())
    e = {r.item_id: r.expected_questions for r in post.collect()}
    rate = 9.5 / 12
    assert 0 < e["a"] < rate < e["b"] < 2


def test_exact_shape_is_better_than_the_grid(spark):
    t = spark.createDataFrame([(str(i), f"S{i % 3}", (i * 7) % 5) for i in range(40)], "item_id STRING, section_id STRING, total INT")
    exact = forecast.fit_exact(t, 3)
    grid = forecast.fit_grid(t.withColumn("g", F.lit(1)), 3, ["g"]).first()["shape"]
    assert abs(math.log(exact) - math.log(grid)) <= (forecast.LOG_HIGH - forecast.LOG_LOW) / forecast.GRID_STEPS


def test_dirichlet(spark):
    u = spark.createDataFrame([("A", "S", 2, 24), ("B", "S", 3, 1)], "unit_id STRING, section_id STRING, items INT, total INT")
    e = {r.unit_id: r.expected_marks for r in forecast.dirichlet(u, 10.0, 3).collect()}
    assert e["A"] + e["B"] == pytest.approx(25 / 3) and e["A"] > e["B"] > 0


def _units(spark, budget):
    u = [("x", "A", 8.0, 20.0), ("x", "B", 3.0, 10.0), ("x", "C", 5.0, 16.0), ("x", "D", 0.5, 12.0)]
    return spark.createDataFrame([(*r, 0.3, float(budget)) for r in u], "profile STRING, unit_id STRING, expected_marks DOUBLE, hours DOUBLE, mastery DOUBLE, budget DOUBLE")


@pytest.mark.parametrize("budget", [0.5, 7, 25, 40])
def test_allocation_meets_its_conditions(spark, budget):
    got = planner.allocate(_units(spark, budget)).collect()
    assert sum(r.planned for r in got) == pytest.approx(budget)
    lam = got[0].lam
    for r in got:
        tau = r.hours / 2
        value = r.expected_marks * (1 - r.mastery) * math.exp(-r.planned / tau) / tau
        cap = tau * math.log((1 - r.mastery) / 0.05)
        if 1e-9 < r.planned < cap - 1e-9:
            assert value == pytest.approx(lam)
        elif r.planned <= 1e-9:
            assert value <= lam + 1e-12


def test_allocation_at_the_ends(spark):
    full = planner.allocate(_units(spark, 10_000)).collect()
    assert all(r.lam == 0 and r.planned == pytest.approx(r.hours / 2 * math.log(0.7 / 0.05)) for r in full)
    assert all(r.lam == math.inf and r.planned == 0 for r in planner.allocate(_units(spark, 0)).collect())


def test_mastery(spark):
    units = spark.createDataFrame([("x", "S:A", "S", 20.0, 8.0, 0.35), ("x", "S:B", "S", 10.0, 2.0, 0.35), ("x", "T:C", "T", 16.0, 5.0, 0.35)], "profile STRING, unit_id STRING, section_id STRING, hours DOUBLE, expected_marks DOUBLE, prior DOUBLE")
    done = spark.createDataFrame([("x", "T:C", 6.0)], "profile STRING, unit_id STRING, hours_done DOUBLE")
    mocks = spark.createDataFrame([("x", "S", 1, 10)], "profile STRING, key STRING, correct INT, attempted INT")
    m = {r.unit_id: r.mastery for r in planner.update_mastery(units, done, mocks).collect()}
    assert m["T:C"] == pytest.approx(1 - 0.65 * math.exp(-6 / 8))
    assert m["S:A"] == pytest.approx((0.35 * 8 + 0.8) / (8 + 8))
    assert m["S:A"] < m["S:B"] < 0.35
    for bad in (("x", "nope", 1, 2), ("x", "S", 3, 2)):
        with pytest.raises(Exception, match="neither|range"):
            planner.update_mastery(units, done, spark.createDataFrame([bad], mocks.schema)).collect()


def test_precedence(spark):
    units = spark.createDataFrame([("x", "DA.PS:A", "DA.PS", "DA"), ("x", "DA.PS:B", "DA.PS", "DA"), ("x", "DA.LA:C", "DA.LA", "DA"), ("x", "GA.X:D", "GA.X", "GA")], "profile STRING, unit_id STRING, section_id STRING, part STRING")
    ratings = spark.createDataFrame([("x", "default", "weak"), ("x", "DA", "okay"), ("x", "DA.PS", "good"), ("x", "DA.PS:A", "strong")], "profile STRING, key STRING, level STRING")
    got = {r.unit_id: r.prior for r in planner.precedence(units, ratings).collect()}
    assert [got[u] for u in ("DA.PS:A", "DA.PS:B", "DA.LA:C", "GA.X:D")] == [planning.LEVELS[x] for x in ("strong", "good", "okay", "weak")]
    with pytest.raises(Exception, match="unknown level"):
        planner.precedence(units, spark.createDataFrame([("x", "DA", "guru")], ratings.schema)).collect()


def _frame(rows):
    names = ["unit_id", "section_id", "hours", "planned", "mastery", "expected_marks", "value", "prereqs", "questions"]
    return pd.DataFrame(rows, columns=names)


def test_order_respects_prerequisites():
    u = lambda i, v, *pre, h=2.0: (i, "s", 4.0, h, 0.5, 1.0, v, list(pre), [])
    order = lambda *rows: [x.names[i] for x in [planner.Units.of(_frame(rows))] for i in x.order]
    assert order(u("a", 1, "b"), u("b", 0.5), u("c", 0.7), u("d", 9, h=0.0)) == ["c", "b", "a"]
    assert order(u("a", 1, "b"), u("b", 2, "a")) == ["b", "a"]
    assert order(u("a", 1, "z")) == ["a"]


def test_schedule_keeps_capacity_and_finishes_units():
    units = [(f"u{i}", f"s{i % 2}", 8.0, 4.0 + i % 3, 0.4, 1.0 + i, float(i), [f"u{i - 1}"] if i % 3 == 1 else [], [f"q{k}" for k in range(i)]) for i in range(8)]
    calendar = [(i, 9.25, "learn" if i < 6 else "final") for i in range(8)]
    rows = planner.simulate(planner.Units.of(_frame(units)), calendar, ["m1"])
    for week, capacity, _ in calendar:
        assert sum(r[3] for r in rows if r[0] == week) <= capacity + 1e-9
    spent = {}
    for _, kind, unit, hours, _ in rows:
        if kind == "learn":
            spent[unit] = spent.get(unit, 0) + hours
    place = {r[2]: i for i, r in enumerate([r for r in rows if r[1] == "finish"])}
    for name, _, _, planned, _, _, _, prereqs, questions in units:
        if name in place:
            assert spent[name] == pytest.approx(planned)
            assert all(place[q] < place[name] for q in prereqs)
            assert [r[4] for r in rows if r[1:3] == ("finish", name)] == [",".join(questions[: planning.PRACTICE])]
    assert [r[2] for r in rows if r[1] == "mock"][0] == "m1"


def test_plan_worked_by_hand():
    """Two units of two sections, then a third that needs the first; ten hours a week, the last two weeks are final."""
    units = [("a", "x", 8.0, 9.0, 0.5, 4.0, 3.0, [], []), ("b", "y", 8.0, 3.0, 0.5, 2.0, 2.0, [], []), ("c", "x", 8.0, 4.0, 0.2, 1.0, 1.0, ["a"], [])]
    calendar = [(0, 10.0, "learn"), (1, 10.0, "learn"), (2, 10.0, "final"), (3, 10.0, "final")]
    got = [r[:4] for r in planner.simulate(planner.Units.of(_frame(units)), calendar, ["m"])]
    # week 0: a and b get five hours each, of which b needs three; the two that are left go to a, which has two to go
    # week 1: b is due (a third of 15 % of its hours, half an hour at least); a ends, then c; late revision goes to the end
    assert got[:7] == [(0, "finish", "b", 0.0), (0, "learn", "a", 7.0), (0, "learn", "b", 3.0), (1, "revise", "b", 0.5), (1, "finish", "a", 0.0), (1, "finish", "c", 0.0), (1, "learn", "a", 2.0)]
    assert got[7] == (1, "learn", "c", 4.0)
    # final weeks: two mocks fill the first, one half of the second; the rest goes by marks at risk and revision owed
    assert [r for r in got if r[1] == "mock"] == [(2, "mock", "m", 5.0), (2, "mock", "external", 5.0), (3, "mock", "external", 5.0)]
    level = [1 - (1 - m) * math.exp(-h / 4) for m, h in ((0.5, 9), (0.5, 3), (0.2, 4))]
    risk = [k * (1 - x) + owed for k, x, owed in zip((4, 2, 1), level, (1.5, 1.0, 1.5), strict=True)]
    blocks = [math.floor(10 * x / sum(risk)) for x in risk]
    blocks[risk.index(max(risk))] += 10 - sum(blocks)
    assert sorted(r for r in got if r[1] == "target") == sorted((3, "target", u, b / 2) for u, b in zip("abc", blocks, strict=True) if b)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 30)), max_size=40), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 30)), max_size=10), st.booleans())
def test_as_of(spark, left, right, strict):
    a = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(left)], "id INT, g INT, t INT")
    marks = dict((k, i) for i, k in enumerate(right))
    b = spark.createDataFrame([(g, t, o) for (g, t), o in marks.items()], "g INT, t INT, o INT")
    got = {r.id: r.o for r in intervals.as_of(a, b, ["g"], "t", ["o"], strict=strict).collect()}
    want = {}
    for i, (g, t) in enumerate(left):
        before = [(s, o) for (h, s), o in marks.items() if h == g and (s < t if strict else s <= t)]
        if before:
            want[i] = max(before)[1]
    assert got == want


def test_overlaps_match_all_pairs(spark):
    import random

    random.seed(3)
    data = [(i % 2, i, float(s := random.randint(0, 200)), float(s + random.randint(0, 40))) for i in range(120)]
    got = {(r.a, r.b) for r in intervals.overlapping_pairs(spark.createDataFrame(data, "g INT, i INT, s DOUBLE, e DOUBLE"), ["g"], "i", "s", "e", 16.0, 0.4).collect()}
    want = set()
    for ga, ia, sa, ea in data:
        for gb, ib, sb, eb in data:
            if ga == gb and (sb, ib) > (sa, ia) and ea > sa and eb > sb and sb < ea and min(ea, eb) - sb >= 0.4 * min(ea - sa, eb - sb):
                want.add((ia, ib))
    assert got == want


def test_numbers_run_over_buckets(spark):
    f = spark.createDataFrame([(i % 2, i * 7) for i in range(100)], "g INT, k INT")
    got = ordering.number_rows(f, ["g"], "k", width=50).orderBy("g", "k").collect()
    assert [r.n for r in got] == [*range(1, 51), *range(1, 51)]


def test_latest_and_checks(spark):
    f = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, None)], "k INT, t INT, v STRING")
    assert sorted(rows(ordering.latest(f, ["k"], "t").select("k", "v"))) == [(1, "b"), (2, None)]
    r = quality.report(quality.unique(f, "u", "k"), quality.check(f, "c", F.col("t") > 5), quality.check(f, "w", F.col("t") > 0, "warning"))
    assert {x.name: x.passed for x in r.collect()} == {"u": False, "c": True, "w": False}
    assert quality.passed(r).first().passed is False
    assert quality.check(f.limit(0), "none", F.col("t") > 0).first().violations == 0


def test_toy_vectors(spark):
    f = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.6]), (3, 0, [0.0, 1.0]), (4, 1, [1.0, 0.0])], "id BIGINT, part INT, vector ARRAY<DOUBLE>")
    got = [(r.id, r.other, r["rank"]) for r in vectors.top_k(f, f, 2).orderBy("id", "rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 2, 1), (3, 1, 2)]
    sims = spark.createDataFrame([(9, 1, 0.9), (9, 2, 0.1)], "id BIGINT, item BIGINT, score DOUBLE")
    none = spark.createDataFrame([], "id BIGINT, label BIGINT, p_knn DOUBLE")
    assert sum(r.blended for r in vectors.blend(sims, none, 0.5, 0.05).collect()) == pytest.approx(1)


def test_ticks_routes_and_boxes(spark):
    from tagmill.functions import charts

    f = spark.createDataFrame([(7.0,), (0.0,), (100.0,), (0.9,)], "x DOUBLE")
    assert [r[0] for r in rows(f.select(charts.ticks(F.col("x"))))] == [[0, 2, 4, 6, 8], [0], [0, 20, 40, 60, 80, 100], pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0])]
    r = spark.createDataFrame([("#/questions/Q7",), ("#/nowhere",), ("trends",), ("",)], "p STRING")
    assert [tuple(x[0]) for x in rows(r.select(charts.route(F.col("p"))))] == [("questions", "Q7"), ("map", None), ("trends", None), ("map", None)]
    b = spark.createDataFrame([(0.0, 0.0, 50.0, 1.0), (0.0, 780.0, 1.0, 800.0), (0.0, 100.0, 9.0, 109.0)], "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    assert rows(b.select(charts.rule_kind(*box), charts.in_margin(F.col("y0"), F.col("y1")), charts.rounded_box(*box))) == [("horizontal", True, "0,0,50,1"), ("vertical", True, "0,780,1,800"), ("none", False, "0,100,9,109")]


def test_embedding_hook(spark):
    import numpy as np

    from tagmill.functions import embed

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    f = spark.createDataFrame([("abc",), (None,)], "t STRING").select(embed.embedder(load)("t").alias("v"))
    got = f.select(embed.cosine(F.col("v"), F.col("v"))).collect()
    assert [r[0] for r in got] == pytest.approx([1.0, 1.0])
