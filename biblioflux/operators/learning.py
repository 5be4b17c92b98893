"""Learned scorers of pairs: a boosted-tree classifier and a pairwise linear ranker."""

from __future__ import annotations

import json
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY = ["pub_id", "bib_key"]


def balanced_weights(pairs: DataFrame) -> DataFrame:
    """pairs plus ``weight``: both labels count as much in total."""
    n = pairs.agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_p"))
    weight = F.when(F.col("label") == 1, F.expr("try_divide(_n, 2 * _p)")).otherwise(F.expr("try_divide(_n, 2 * (_n - _p))"))
    return pairs.join(F.broadcast(n)).withColumn("weight", F.coalesce(weight, F.lit(1.0)).cast("double")).drop("_n", "_p")


def filled(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """pairs whose features have no gaps: 0 for numbers that are null or not a number, 'missing' for texts."""
    text = {f.name for f in pairs.schema if f.dataType.typeName() == "string"}
    fill = lambda c: F.coalesce(F.col(c), F.lit("missing")) if c in text else F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return pairs.withColumns({c: fill(c) for c in columns})


def _assembled(pairs: DataFrame, columns: list[str], last) -> Pipeline:
    """Stages that turn the columns into features, texts by an index of their values (unseen ones have one of their own)."""
    text = [f.name for f in pairs.schema if f.name in columns and f.dataType.typeName() == "string"]
    coded = [f"{c}__code" for c in text]
    index = [StringIndexer(inputCols=text, outputCols=coded, handleInvalid="keep")] if text else []
    return Pipeline(stages=[*index, VectorAssembler(inputCols=[f"{c}__code" if c in text else c for c in columns], outputCol="features", handleInvalid="keep"), last])


def train_classifier(pairs: DataFrame, columns: list[str], iterations: int = 20, rate: float = 0.1, depth: int = 5, leaf: int = 1, validation: str | None = None, seed: int = 42) -> PipelineModel | None:
    """Boosted trees on balanced pairs, stopping early on the rows that ``validation`` marks; None without positives.

    A leaf holds at least ``leaf`` rows, which keeps trees from fitting single pairs.
    """
    if pairs.where("label = 1").isEmpty():
        return None
    options = {"validationIndicatorCol": validation} if validation else {}
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=iterations, stepSize=rate, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, **options)
    return _assembled(pairs, columns, trees).fit(balanced_weights(filled(pairs, columns)))


def train_ranker(pairs: DataFrame, columns: list[str], rounds: int = 100, ridge: float = 0.01) -> PipelineModel | None:
    """Linear ranker on differences of features between the true and each other candidate of an entry; None without positives.

    Texts have no difference and cannot be its features.
    """
    both = preferences(filled(pairs, columns), columns)
    if both.isEmpty():
        return None
    model = LogisticRegression(labelCol="label", featuresCol="features", fitIntercept=False, maxIter=rounds, regParam=ridge)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), model]).fit(both)


def preferences(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(label, columns): for each true and other candidate of an entry the difference of their features, once each way round."""
    good = pairs.where("label = 1").select(*QUERY, *[F.col(c).alias(f"_{c}") for c in columns])
    diff = pairs.where("label = 0").join(good, QUERY)
    up = diff.select(F.lit(1.0).alias("label"), *[(F.col(f"_{c}") - F.col(c)).cast("double").alias(c) for c in columns])
    return up.unionByName(up.select(F.lit(0.0).alias("label"), *[(-F.col(c)).alias(c) for c in columns]))


def history(model: PipelineModel, rows: DataFrame | None = None) -> list[float]:
    """Loss by iteration: of the training rows for a linear model, of the rows given for trees."""
    last = model.stages[-1]
    if hasattr(last, "evaluateEachIteration"):
        prepared = PipelineModel(model.stages[:-1]).transform(rows)
        return list(map(float, last.evaluateEachIteration(prepared)))
    return list(map(float, last.summary.objectiveHistory)) if last.hasSummary else []


def predict(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """pairs, gaps in the model's features ``filled``, plus ``score``: the probability of a match, or of standing above another candidate."""
    known = [c for stage in model.stages if hasattr(stage, "getInputCols") for c in stage.getInputCols() if c in pairs.columns]
    out = model.transform(filled(pairs, list(dict.fromkeys(known))))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *[c for c in out.columns if c.endswith("__code")])


def tune(train: DataFrame, valid: DataFrame, columns: list[str], rates=(0.03, 0.1, 0.3), depths=(3, 5, 7), iterations=(10,), leaves=(1,), parallel: int = 3) -> tuple[dict, float]:
    """Best (rate, depth, iterations, leaf) by mean reciprocal rank on one fixed validation set; of equals the first.

    Both sets are kept while ``parallel`` fits at a time read them.
    """
    from biblioflux.operators import ranking

    train, valid = train.persist(), valid.persist()
    try:
        if train.where("label = 1").isEmpty():
            return {}, -1.0
        truth = valid.where("label = 1").select(*QUERY, "candidate_id")
        order = "cand_ord" if "cand_ord" in valid.columns else "candidate_id"

        def score(setting: tuple) -> float:
            rate, depth, n, leaf = setting
            ranked = ranking.predictions(ranking.top_k(predict(train_classifier(train, columns, n, rate, depth, leaf), valid), order=order))
            return ranking.metrics(ranking.ranks(truth, ranked)).first()["mrr"]

        settings = list(product(rates, depths, iterations, leaves))
        with ThreadPool(parallel) as pool:
            scores = pool.map(score, settings, chunksize=1)
    finally:
        train.unpersist()
        valid.unpersist()
    best = max(range(len(settings)), key=lambda i: scores[i])
    return dict(zip(("rate", "depth", "iterations", "leaf"), settings[best])), scores[best]


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """(feature, importance), the largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(columns, map(float, values)), key=lambda x: -x[1])


def importance_table(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """(feature, importance), the largest first: what ``write.csv`` with a header makes the importance file."""
    return spark.createDataFrame(importances(model, columns), "feature string, importance double")


def save(model: PipelineModel, path: str, columns: list[str], parameters: dict | None = None, losses: list[float] | None = None) -> None:
    """The model under path/model, and what it was made of (columns, parameters, losses, importances) as JSON under path/metadata."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    about = {"columns": columns, "model_type": type(model.stages[-1]).__name__, "best_params": parameters or {}, "training_history": losses or [], "feature_importance": dict(importances(model, columns))}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str) -> tuple[PipelineModel, dict]:
    """A saved model and its metadata; {} where the metadata is missing."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    model = PipelineModel.load(f"{path}/model")
    try:
        row = SparkSession.active().read.text(f"{path}/metadata").first()
    except AnalysisException:
        row = None
    return model, json.loads(row.value) if row else {}
