"""Queries of the vector family. Parts are the labels, or their parity; items are the five first vectors of a label."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators import evaluation, softmax, vectors
from tagmill.plans.binding import table
from tagmill.sources.scratch import lent, written

GRID = [(w, t) for w in (0.25, 0.5, 0.75, 1.0) for t in (0.02, 0.05)]


def _rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label", (F.col("label") % 2).alias("part"))


def _items(rows):
    """The first five vectors of each label; few, as labels are."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return rows.withColumn("n", n).filter("n <= 5").drop("n")


def _all_scores(rows, items):
    """Similarity of every row to every item of its part."""
    return vectors.all_scores(rows, items).withColumnRenamed("other", "item")


def zero_shot_topk(spark, d):
    rows = _rows(spark, d)
    return vectors.top_k(rows, _items(rows), 15).select("id", F.col("other").alias("item"), "rank", (F.round("score", 4) + F.lit(0.0)).alias("score"))


def similar_top5(spark, d):
    rows = _rows(spark, d).withColumn("part", F.col("label"))
    return vectors.top_k(rows, rows, 5).select("id", "other", "rank", (F.round("score", 3) + F.lit(0.0)).alias("score"))


def cv_folds(spark, d):
    return vectors.folds(_rows(spark, d), "part", "id", 5, 42).select("id", "part", "fold")


def _labelled(spark, d):
    """Rows with folds and a reference item: one of their part's items, dealt by id."""
    rows = vectors.folds(_rows(spark, d), "part", "id", 5, 42)
    items = _items(rows).select(F.col("part").alias("__part"), F.col("id").alias("truth"), (F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("part")).alias("m"))
    return rows.join(items, (F.col("part") == F.col("__part")) & (F.pmod(F.col("id") * 7, F.col("m")) == F.col("k"))).select("id", "vector", "label", "part", "fold", "truth")


def knn_blend(spark, d):
    """Ranking of the items for each row, neighbours from the other folds."""
    rows = _labelled(spark, d)
    sims = _all_scores(rows, _items(rows)).select("id", "item", "score")
    near = vectors.top_k(rows, rows, 5, group="fold").select("id", "other", "score")
    mixed = vectors.blend(sims, vectors.votes(near, rows, "truth"), 0.5, 0.05)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("blended", 12)), "item"))
    return mixed.withColumn("rank", rank).filter("rank <= 15").select("id", "item", "rank", F.round("blended", 6).alias("score"))


def _grid_accuracy(spark, d):
    """Accuracy of every setting on the inner folds of every outer training set."""
    rows = written(_labelled(spark, d).withColumn("inner", F.pmod(F.floor(F.col("id") / 5), F.lit(4))), "labelled")
    sims = written(_all_scores(rows, _items(rows)).select("id", "item", "score"), "scores")
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("g"), F.lit(w).alias("w"), F.lit(t).alias("t")) for i, (w, t) in enumerate(GRID))))
    per_fold = []
    for fold in range(5):
        train = rows.filter(F.col("fold") != fold)
        near = vectors.top_k(train, train, 5, group="inner").select("id", "other", "score")
        setting = sims.join(train.select("id", "truth"), "id").withColumn("s", grid).select("id", "item", "score", "truth", "s.*")
        mixed = vectors.blend(setting, vectors.votes(near, train, "truth"), F.col("w"), F.col("t"), ("id", "g"))
        best = mixed.groupBy("id", "g", "truth").agg(F.min_by("item", F.struct(-F.round("blended", 12), F.col("item"))).alias("top"))
        per_fold.append(best.groupBy("g").agg(F.round(F.avg((F.col("top") == F.col("truth")).cast("int")), 6).alias("accuracy")).withColumn("fold", F.lit(fold)))
    out = per_fold[0]
    for x in per_fold[1:]:
        out = out.unionByName(x)
    return out


def nested_cv_grid(spark, d):
    """Per outer fold the setting of the best inner accuracy; of equal ones the first of the grid."""
    best = _grid_accuracy(spark, d).groupBy("fold").agg(F.min_by(F.struct("g", "accuracy"), F.struct(-F.col("accuracy"), F.col("g"))).alias("b"))
    pick = lambda j: F.element_at(F.array(*(F.lit(s[j]) for s in GRID)), F.col("b.g") + 1)
    return best.select("fold", pick(0).alias("weight"), pick(1).alias("temperature"), F.col("b.accuracy").alias("accuracy"))


def _dealt(rows):
    """Rows with fold, class (from 0 by name of the target) and weight (the same for each class in all), and the classes."""
    from pyspark.ml.feature import StringIndexer

    names = rows.select("target")
    index = StringIndexer(inputCol="target", outputCol="class", stringOrderType="alphabetAsc").fit(names)
    sizes = names.groupBy("target").agg((1 / F.count(F.lit(1))).alias("weight"))
    dealt = index.transform(vectors.folds(rows, "target", "id", 5, 42)).withColumn("fold", F.col("fold").cast("int"))
    return dealt.join(F.broadcast(sizes), "target"), len(index.labels)  # a row a class


def _scores(guesses, name):
    return evaluation.accuracy_and_macro_f1(guesses, "truth", "guess").select(F.lit(name).alias("model"), "accuracy", "macro_f1")


def _tfidf(docs):
    """Guesses of TF-IDF of words and pairs of words; texts are read into counts once, all folds are fitted together."""
    width = 1 << 14
    dealt, classes = _dealt(docs)
    counts = softmax.packed(dealt, "text", width, "id bigint, class double, weight double, fold int").select("id", "class", "weight", "at", "n", "more", "fold")
    with lent(counts, "counts", ("fold",)) as rows:
        models = softmax.models(rows, width, classes, lambda n, present: np.log((n + 1) / (present + 1)), penalty=0.01, rounds=15)
        return written(softmax.guesses(rows, models), "guesses")


def _embedding(vecs):
    """Guesses from the vectors, fold by fold."""
    from pyspark.ml.classification import LogisticRegression

    logistic = LogisticRegression(labelCol="class", weightCol="weight", maxIter=25, regParam=0.1)
    with lent(_dealt(vecs)[0].select("id", "class", "weight", "features", "fold"), "vectors", ("fold",)) as rows:
        parts = []
        for fold in range(5):
            found = logistic.fit(rows.filter(F.col("fold") != fold)).transform(rows.filter(F.col("fold") == fold))
            parts.append(found.select("id", F.col("class").alias("truth"), F.col("prediction").alias("guess")))
        return written(reduce(DataFrame.unionByName, parts), "guesses")


def classifier_cv(spark, d):
    """Majority class, TF-IDF and embeddings with logistic regression, each cross-validated in five folds."""
    from pyspark.ml.functions import array_to_vector

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("target"))
    vecs = _rows(spark, d).select("id", array_to_vector("vector").alias("features"), F.col("label").cast("string").alias("target"))
    top = docs.groupBy("target").count().orderBy(F.desc("count"), "target").limit(1).select(F.col("target").alias("guess"))
    majority = _scores(docs.select(F.col("target").alias("truth")).crossJoin(F.broadcast(top)), "majority_class")  # one row is broadcast
    return majority.unionByName(_scores(_tfidf(docs), "tfidf_logreg")).unionByName(_scores(_embedding(vecs), "embedding_logreg"))


_V = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label, label % 2 AS part FROM embeddings),
it AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM v) WHERE n <= 5),
f AS (SELECT id, (row_number() OVER (PARTITION BY part ORDER BY substr(md5(concat(id, '/42')), 1, 13)) - 1) % 5 AS fold FROM v),
tr AS (SELECT v.id, k.id AS truth FROM v JOIN (SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY part) AS m FROM it) k ON k.part = v.part AND (v.id * 7) % k.m = k.k),
vl AS (SELECT v.*, f.fold, tr.truth, (v.id // 5) % 4 AS inner_fold FROM v JOIN f USING (id) JOIN tr USING (id)),
s AS (SELECT v.id, it.id AS item, round(list_dot_product(v.vector, it.vector), 12) AS score FROM v JOIN it ON it.part = v.part AND it.id <> v.id)
"""

QUERIES = {f.__name__: f for f in (zero_shot_topk, similar_top5, cv_folds, knn_blend, nested_cv_grid, classifier_cv)}
ORACLES = {
    "zero_shot_topk": _V + "SELECT id, item, rank, round(score, 4) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 15",
    "similar_top5": _V + "SELECT id, other, rank, round(score, 3) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM (SELECT a.id, b.id AS other, round(list_dot_product(a.vector, b.vector), 12) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id)) WHERE rank <= 5",
    "cv_folds": _V + "SELECT v.id, part, fold FROM v JOIN f USING (id)",
    "knn_blend": _V
    + """, nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM (SELECT a.id, b.id AS other, b.truth, round(list_dot_product(a.vector, b.vector), 12) AS score FROM vl a JOIN vl b ON a.part = b.part AND a.fold <> b.fold)) WHERE rank <= 5),
        k AS (SELECT id, truth AS item, sum(greatest(score, 0)) AS sm FROM nb GROUP BY ALL HAVING sum(greatest(score, 0)) > 0),
        kp AS (SELECT id, item, sm / sum(sm) OVER (PARTITION BY id) AS p FROM k),
        e AS (SELECT *, exp(score / 0.05 - max(score / 0.05) OVER (PARTITION BY id)) AS x, count(*) OVER (PARTITION BY id) AS m FROM s),
        b AS (SELECT e.id, e.item, 0.5 * x / sum(x) OVER (PARTITION BY e.id) + 0.5 * CASE WHEN max(p) OVER (PARTITION BY e.id) IS NULL THEN 1 / m ELSE coalesce(p, 0) END AS blended FROM e LEFT JOIN kp ON kp.id = e.id AND kp.item = e.item)
        SELECT id, item, rank, round(blended, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(blended, 12) DESC, item) AS rank FROM b) WHERE rank <= 15""",
    "nested_cv_grid": _V
    + """, o AS (SELECT unnest(range(0, 5)) AS ofold),
        g AS (SELECT i AS g, [0.25, 0.25, 0.5, 0.5, 0.75, 0.75, 1.0, 1.0][i + 1] AS w, [0.02, 0.05, 0.02, 0.05, 0.02, 0.05, 0.02, 0.05][i + 1] AS t FROM (SELECT unnest(range(0, 8)) AS i)),
        pairs AS (SELECT a.id, b.id AS other, b.truth, a.fold AS fa, b.fold AS fb, round(list_dot_product(a.vector, b.vector), 12) AS score FROM vl a JOIN vl b ON a.part = b.part AND a.inner_fold <> b.inner_fold),
        nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ofold, id ORDER BY score DESC, other) AS rank FROM pairs, o WHERE fa <> ofold AND fb <> ofold) WHERE rank <= 5),
        k AS (SELECT ofold, id, truth AS item, sum(greatest(score, 0)) AS sm FROM nb GROUP BY ALL HAVING sum(greatest(score, 0)) > 0),
        kp AS (SELECT ofold, id, item, sm / sum(sm) OVER (PARTITION BY ofold, id) AS p FROM k),
        e AS (SELECT s.id, s.item, g.g, g.w, exp(score / t - max(score / t) OVER (PARTITION BY s.id, g.g)) AS x FROM s, g),
        ps AS (SELECT *, x / sum(x) OVER (PARTITION BY id, g) AS p_sim, count(*) OVER (PARTITION BY id, g) AS m FROM e),
        b AS (SELECT o.ofold, ps.id, ps.item, ps.g, vl.truth, w * p_sim + (1 - w) * CASE WHEN max(p) OVER (PARTITION BY o.ofold, ps.id, ps.g) IS NULL THEN 1 / m ELSE coalesce(p, 0) END AS blended
              FROM ps JOIN vl ON vl.id = ps.id JOIN o ON vl.fold <> o.ofold LEFT JOIN kp ON kp.ofold = o.ofold AND kp.id = ps.id AND kp.item = ps.item),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ofold, id, g ORDER BY round(blended, 12) DESC, item) AS rank FROM b) WHERE rank = 1),
        acc AS (SELECT ofold, g, round(avg((item = truth)::INT), 6) AS accuracy FROM top GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY ofold ORDER BY accuracy DESC, g) AS n FROM acc)
        SELECT CAST(ofold AS INTEGER) AS fold, CAST(w AS DOUBLE) AS weight, CAST(t AS DOUBLE) AS temperature, accuracy FROM best JOIN g USING (g) WHERE n = 1""",
}
