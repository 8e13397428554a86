"""Queries of the evaluation family: the quantity tagger held against the price tagger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagmill.operators import evaluation as e
from tagmill.plans.binding import ctes, items, records

C = ctes()


def _rows(spark, d):
    i = items(spark, d)
    truth = i.select(F.col("item_id").alias("primary"), F.col("unit_id").alias("cluster"))
    guess = i.select(F.col("item_id").alias("guess_primary"), F.col("unit_id").alias("guess_cluster"), F.col("section_id").alias("guess_section"))
    rows = records(spark, d).join(truth, "primary").join(guess, "guess_primary")
    return rows.withColumn("clean", F.col("marks") == 1)


def _subsets(rows):
    return e.subsets(rows, {"all": F.lit(True), "GA": F.col("part") == "GA", "DA": F.col("part") == "DA", "clean": F.col("clean"), "needs_review": ~F.col("clean")})


def tagger_scores(spark, d):
    return e.scores(_subsets(_rows(spark, d)))


def recall_at_k(spark, d):
    return e.recall(_subsets(_rows(spark, d)))


def item_set_prf(spark, d):
    return e.set_scores(_subsets(_rows(spark, d)))


def cohen_kappa(spark, d):
    return e.kappa(_rows(spark, d).filter("part = 'DA'"), "section", "guess_section")


def _taggers(spark, d):
    """Truth by price; tagger one by quantity; tagger two takes the smallest item of the record."""
    rows = _rows(spark, d)
    return rows.withColumn("second", F.array_min(F.concat(F.array("primary"), "secondary", "ranking")))


def tagger_agreement(spark, d):
    return e.agreement(_taggers(spark, d), "guess_primary", "second", "primary")


def mcnemar(spark, d):
    return e.mcnemar(_taggers(spark, d), "guess_primary", "second", "primary")


def tag_disagreements(spark, d):
    i = items(spark, d)
    label = lambda c, n: i.select(F.col("item_id").alias(c), F.col("label").alias(n))
    rows = _rows(spark, d).filter("primary <> guess_primary")
    rows = rows.join(label("primary", "reference_label"), "primary").join(label("guess_primary", "guess_label"), "guess_primary")
    return rows.select("id", F.col("primary").alias("reference_primary"), "reference_label", "guess_primary", "guess_label", F.array_contains("secondary", F.col("guess_primary")).alias("guess_in_reference_items"))


def classification_report(spark, d):
    return e.class_report(_rows(spark, d), "section", "guess_section")


def classifier_accuracy(spark, d):
    return e.accuracy_and_macro_f1(_rows(spark, d), "section", "guess_section")


def majority_baseline(spark, d):
    """Every record gets the most frequent section (first by name on ties)."""
    rows = _rows(spark, d).select("section")
    top = rows.groupBy("section").count().orderBy(F.desc("count"), "section").limit(1).select(F.col("section").alias("guess"))
    return e.accuracy_and_macro_f1(rows.crossJoin(F.broadcast(top)), "section", "guess")  # one row is broadcast


def rank_of_truth(spark, d):
    """How many records have the true item at each rank of the second tagger (0: not in its first fifteen)."""
    return _rows(spark, d).groupBy(F.array_position("ranking", F.col("primary")).alias("rank")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


_E = """, e AS (
    SELECT r.*, c.unit_id AS cluster, g.unit_id AS guess_cluster, g.section_id AS guess_section, r.marks = 1 AS clean, k.rank,
           (SELECT count(*) FROM t WHERE t.id = r.id AND t.rp <= 4 AND t.rq <= 4) AS tp, s.n_all,
           EXISTS (SELECT 1 FROM t WHERE t.id = r.id AND t.item_id = r.guess_primary AND t.rp <= 4) AS acceptable, s.smallest
    FROM r JOIN i c ON c.item_id = primary_item JOIN i g ON g.item_id = guess_primary
    JOIN (SELECT id, CASE WHEN rq <= 15 THEN rq ELSE 0 END AS rank FROM t WHERE rp = 1) k ON k.id = r.id
    JOIN (SELECT id, least(count(*), 4) AS n_all, min(item_id) AS smallest FROM t GROUP BY id) s ON s.id = r.id),
z AS (SELECT e.*, unnest(list_filter(['all', CASE WHEN part = 'GA' THEN 'GA' END, CASE WHEN part = 'DA' THEN 'DA' END, CASE WHEN clean THEN 'clean' END, CASE WHEN NOT clean THEN 'needs_review' END], lambda x: x IS NOT NULL)) AS subset FROM e)
"""


def _report(rows: str) -> str:
    return f""", y AS ({rows}), cells AS (SELECT t, g, count(*) AS n FROM y GROUP BY ALL),
    k AS (SELECT coalesce(a.c, b.c) AS class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
          FROM (SELECT t AS c, sum(n) AS support FROM cells GROUP BY t) a FULL JOIN (SELECT g AS c, sum(n) AS predicted FROM cells GROUP BY g) b ON a.c = b.c
          LEFT JOIN (SELECT t AS c, n AS tp FROM cells WHERE t = g) h ON h.c = coalesce(a.c, b.c)),
    report AS (SELECT class, support, round(coalesce(tp / nullif(predicted, 0), 0), 4) AS class_precision, round(coalesce(tp / nullif(support, 0), 0), 4) AS class_recall,
               round(f, 4) AS f1, f FROM (SELECT *, coalesce(2.0 * tp / nullif(predicted + support, 0), 0) AS f FROM k))"""


_ACC = "SELECT (SELECT round(sum(n) FILTER (t = g) / sum(n), 4) FROM cells) AS accuracy, (SELECT round(avg(f), 4) FROM report) AS macro_f1"

QUERIES = {f.__name__: f for f in (tagger_scores, recall_at_k, item_set_prf, cohen_kappa, tagger_agreement, mcnemar, tag_disagreements, classification_report, classifier_accuracy, majority_baseline, rank_of_truth)}
ORACLES = {
    "tagger_scores": C + _E + "SELECT subset, count(*) AS n, round(avg((guess_primary = primary_item)::INT), 4) AS primary_accuracy, round(avg(acceptable::INT), 4) AS acceptable_accuracy, round(avg((cluster = guess_cluster)::INT), 4) AS cluster_accuracy, round(avg((section = guess_section)::INT), 4) AS section_accuracy FROM z GROUP BY subset",
    "recall_at_k": C + _E + "SELECT subset, count(*) AS n, " + ", ".join(f"round(avg((rank BETWEEN 1 AND {k})::INT), 4) AS recall_at_{k}" for k in e.RANK_CUTOFFS) + ", round(avg(CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END), 4) AS mrr FROM z GROUP BY subset",
    "item_set_prf": C + _E + "SELECT subset, tp, fp, fn, round(p, 4) AS item_precision, round(r, 4) AS item_recall, round(2 * p * r / greatest(p + r, 1e-9), 4) AS item_f1 FROM (SELECT subset, sum(tp) AS tp, sum(n_all - tp) AS fp, sum(n_all - tp) AS fn, sum(tp) / greatest(sum(n_all), 1) AS p, sum(tp) / greatest(sum(n_all), 1) AS r FROM z GROUP BY subset)",
    "cohen_kappa": C + _E + """, n AS (SELECT count(*) AS n, count(*) FILTER (section = guess_section) AS same FROM e WHERE part = 'DA'),
        x AS (SELECT sum(a * b) AS ab FROM (SELECT section AS s, count(*) AS a FROM e WHERE part = 'DA' GROUP BY 1) JOIN (SELECT guess_section AS s, count(*) AS b FROM e WHERE part = 'DA' GROUP BY 1) USING (s))
        SELECT n, round(same / n, 4) AS observed, round(ab / (n * n), 4) AS expected, round((same / n - ab / (n * n)) / (1 - ab / (n * n)), 3) AS kappa FROM n, x""",
    "tagger_agreement": C + _E + "SELECT count(*) AS n, round(avg((guess_primary = smallest)::INT), 4) AS agreement_rate, round(avg((guess_primary = primary_item)::INT) FILTER (guess_primary = smallest), 4) AS accuracy_when_agree, round(avg((guess_primary = primary_item)::INT) FILTER (guess_primary <> smallest), 4) AS first_accuracy_when_disagree, round(avg((smallest = primary_item)::INT) FILTER (guess_primary <> smallest), 4) AS second_accuracy_when_disagree FROM e",
    "mcnemar": C + _E + """, c AS (SELECT count(*) AS n, count(*) FILTER (guess_primary = primary_item AND smallest <> primary_item) AS a, count(*) FILTER (guess_primary <> primary_item AND smallest = primary_item) AS b FROM e)
        SELECT n, a AS only_first_right, b AS only_second_right, round(least(1, 2 * (SELECT sum(exp(lgamma(a + b + 1) - lgamma(j + 1) - lgamma(a + b - j + 1) - (a + b) * ln(2))) FROM (SELECT unnest(range(0, least(a, b) + 1)) AS j))), 4) AS p_value FROM c""",
    "tag_disagreements": C + _E + "SELECT e.id, primary_item AS reference_primary, a.label AS reference_label, guess_primary, b.label AS guess_label, acceptable AS guess_in_reference_items FROM e JOIN i a ON a.item_id = primary_item JOIN i b ON b.item_id = guess_primary WHERE primary_item <> guess_primary",
    "classification_report": C + _E + _report("SELECT section AS t, guess_section AS g FROM e") + " SELECT class, support, class_precision, class_recall, f1 FROM report",
    "classifier_accuracy": C + _E + _report("SELECT section AS t, guess_section AS g FROM e") + _ACC,
    "majority_baseline": C + _E + _report("SELECT section AS t, (SELECT section FROM e GROUP BY section ORDER BY count(*) DESC, section LIMIT 1) AS g FROM e") + _ACC,
    "rank_of_truth": C + _E + "SELECT rank, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 4) AS share FROM e GROUP BY rank",
}
