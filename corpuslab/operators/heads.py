"""Classifier heads on feature vectors, from Spark ML, balanced by inverse class frequency.

A radial-basis support vector machine is not among them: Spark has none.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.corpus import class_weights
from corpuslab.operators.metrics import evaluate
from corpuslab.operators.mixing import permutation


def head(kind: str, seed: int = 0):
    args = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "logreg":
        return LogisticRegression(maxIter=100, regParam=1.0 / 100, **args)
    if kind == "linear_svm":
        return OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01), weightCol="weight")
    if kind == "forest":
        return RandomForestClassifier(numTrees=100, maxDepth=8, seed=seed, **args)
    if kind == "boosted":
        return OneVsRest(classifier=GBTClassifier(maxIter=30, seed=seed), weightCol="weight")
    raise ValueError(f"unknown head {kind}")


def prepared(df: DataFrame, vec: str = "v") -> DataFrame:
    """The rows with `features` and `weight`; weights, a row for each class, are broadcast."""
    weights = class_weights(df)
    return df.join(F.broadcast(weights), "label").withColumn("features", array_to_vector(vec))


def fit_predict(train: DataFrame, test: DataFrame, kind: str, seed: int = 0, key: str = "ord", vec: str = "v") -> DataFrame:
    """key, y_true, y_pred for the rows of test."""
    model = head(kind, seed).fit(prepared(train, vec).select("features", "label", "weight"))
    out = model.transform(test.select(key, "label", array_to_vector(vec).alias("features")))
    return out.select(key, F.col("label").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def cross_validated(df: DataFrame, kind: str, folds: int = 5, seed: int = 0, key: str = "ord", vec: str = "v") -> DataFrame:
    """key, y_true, y_pred: every row predicted by the model of the other folds; folds are stratified."""
    f = permutation(df, seed, ["label"], key).withColumn("fold", F.pmod("rn", F.lit(folds))).drop("rn")
    out = None
    for i in range(folds):
        part = fit_predict(f.where(F.col("fold") != i), f.where(F.col("fold") == i), kind, seed, key, vec)
        out = part if out is None else out.unionByName(part)
    return out


def sweep(arms: dict[str, DataFrame], test: DataFrame, kinds: list[str], seeds: list[int]) -> DataFrame:
    """arm, head, seed and the metrics of each: training is a Spark job for each combination."""
    out = None
    for name, train in arms.items():
        for kind in kinds:
            for seed in seeds:
                row = evaluate(fit_predict(train, test, kind, seed)).select(F.lit(name).alias("arm"), F.lit(kind).alias("head"), F.lit(seed).alias("seed"), "*")
                out = row if out is None else out.unionByName(row)
    return out
