"""Cross-validated classifiers: the work is done once and the scores are those of models fitted fold by fold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tagmill.operators import evaluation, grams, softmax, vectors
from tagmill.plans.binding import table
from tagmill.plans.vectors import classifier_cv


@pytest.fixture(scope="module")
def result(spark, data):
    return classifier_cv(spark, data)


def test_scores_read_predictions_only(result):
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "text:" not in plan and "embedding:" not in plan  # columns read from files
    assert plan.count("Exchange") < 60


def test_tfidf_is_that_of_models_fitted_fold_by_fold(spark, data, result):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
    from pyspark.sql import functions as F

    docs = table(spark, data, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("target"))
    rows = StringIndexer(inputCol="target", outputCol="class", stringOrderType="alphabetAsc").fit(docs).transform(vectors.folds(docs, "target", "id", 5, 42))
    rows = rows.join(docs.groupBy("target").agg((1 / F.count(F.lit(1))).alias("weight")), "target").localCheckpoint()
    stages = [RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\W+"), NGram(n=2, inputCol="w1", outputCol="w2"), SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__"), HashingTF(numFeatures=1 << 14, inputCol="grams", outputCol="tf"), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="class", weightCol="weight", maxIter=15, regParam=0.01)]
    guesses = []
    for fold in range(5):
        found = Pipeline(stages=stages).fit(rows.filter(F.col("fold") != fold)).transform(rows.filter(F.col("fold") == fold))
        guesses += [(r["class"], r.prediction) for r in found.select("class", "prediction").collect()]
    wanted = evaluation.accuracy_and_macro_f1(spark.createDataFrame(guesses, "t double, g double"), "t", "g").first()
    got = result.filter("model = 'tfidf_logreg'").first()
    assert (got.accuracy, got.macro_f1) == (wanted.accuracy, wanted.macro_f1)


@pytest.mark.parametrize("classes", [2, 3])
def test_coefficients_are_those_of_spark(spark, classes):
    """Counts beyond a byte, an empty row, a column that all rows have and one that none has."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        counts = rng.poisson(0.3 + (np.arange(12) % classes == i % classes), 12) * (np.arange(12) != 5)
        counts[3] += 1
        counts[7] *= 70_000 if i % 5 == 0 else 100
        at = np.flatnonzero(counts) if i else []
        rows.append((i, float(i % classes), 0.01 + i % 3, int(i // 7 % 5), Vectors.sparse(12, at, counts[at].astype(float) if i else [])))
    frame = spark.createDataFrame(rows, ["id", "class", "weight", "fold", "features"]).withColumn("fold", F.col("fold").cast("int"))
    columns = softmax.stored(np.concatenate([r[4].indices for r in rows]), np.concatenate([r[4].values for r in rows]).astype(int), np.append(0, np.cumsum([len(r[4].indices) for r in rows])))
    packed = spark.createDataFrame([(*r[:4], *x) for r, *x in zip(rows, *(c.to_pylist() for c in columns))], "id bigint, class double, weight double, fold int, at binary, n binary, more binary").repartition(3).localCheckpoint()
    found = softmax.models(packed, 12, classes, lambda n, present: np.ones(12), 0.01, 15)
    guesses = {r.id: r.guess for r in softmax.guesses(packed, found).collect()}
    for fold in range(5):
        model = LogisticRegression(featuresCol="features", labelCol="class", weightCol="weight", maxIter=15, regParam=0.01).fit(frame.filter(f"fold <> {fold}"))
        c = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])
        np.testing.assert_allclose(found[fold], c if classes == 2 else c[1:] - c[0], rtol=1e-6, atol=1e-9)
        for r in model.transform(frame.filter(f"fold = {fold}")).select("id", "prediction").collect():
            assert guesses[r.id] == r.prediction


def test_counts_are_those_of_spark(spark, data):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer

    odd = ["", " ", "a", "A_b9 a_B9", "\u0130s \u212aelvin \u0130stanbul", "na\u00efve caf\u00e9 \u00c9t\u00e9 \u03a3\u03a3", "x " * 70_000, "tail", "of a word", "\U0001f600emoji\u0000nul", "-", "abcd abcde abcdef abcdefg abcdefgh"]
    texts = odd + [r.text for r in table(spark, data, "documents").select("text").collect()]
    stages = [RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\W+"), NGram(n=2, inputCol="w1", outputCol="w2"), SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__"), HashingTF(numFeatures=1 << 14, inputCol="grams", outputCol="tf")]
    wanted = [r.tf for r in PipelineModel(stages).transform(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").select("tf").collect()]
    places, counts, starts = grams.counts(pa.array(texts), 1 << 14)
    assert starts[-1] == len(places)
    for i, v in enumerate(wanted):
        assert places[starts[i] : starts[i + 1]].tolist() == v.indices.tolist()
        assert counts[starts[i] : starts[i + 1]].tolist() == v.values.tolist()
