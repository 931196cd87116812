"""Classifier heads: beyond SQL, so these have no oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import heads as H
from corpuslab.operators.metrics import evaluate
from corpuslab.queries import views as V
from corpuslab.registry import query


def _vectors(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), (F.col("label") % 4).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


@query("cls2_heads")
def _(spark, sf):
    v = _vectors(spark, sf)
    return H.sweep({"all": v.where("ord % 4 <> 0")}, v.where("ord % 4 = 0"), ["logreg", "forest"], [0]).select("arm", "head", "seed", "n", "accuracy", "balanced_accuracy")


@query("cls3_arm_sweep")
def _(spark, sf):
    v = _vectors(spark, sf)
    train = v.where("ord % 4 <> 0")
    return H.sweep({"all": train, "half": train.where("ord % 2 = 1")}, v.where("ord % 4 = 0"), ["logreg"], [0]).select("arm", "head", "seed", "n", "balanced_accuracy")


@query("cls8_cross_validated")
def _(spark, sf):
    v = _vectors(spark, sf)
    return evaluate(H.cross_validated(v, "logreg", 3)).select("n", "accuracy", "balanced_accuracy")


@query("abl3_stratum_feature")
def _(spark, sf):
    d = V.v_docs(spark, sf).where("lang = 'en'").select("ord", "label", F.array(F.log1p("n_chars")).alias("v"))
    return evaluate(H.fit_predict(d.where("ord % 4 <> 0"), d.where("ord % 4 = 0"), "logreg")).select("n", "accuracy")
