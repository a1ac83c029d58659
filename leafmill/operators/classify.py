"""Spellings to codes by character n-grams: logistic regression, or a linear support vector machine per code."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.entities import grams

WIDTH = 4_096  # of the hashed n-gram counts
STEPS = 20
TASK_ROWS = 20_000  # spellings that a task learns from in each step


def _counted(rows: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """rows with the n-grams of the text, word ends marked by blanks."""
    return rows.withColumn("grams", grams(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), low, high))


def fit(spellings: DataFrame, kind: str = "logistic", low: int = 2, high: int = 4) -> PipelineModel:
    """A model from (code, variant). kind is `logistic` or `svc`; both learn on the cluster."""
    if kind not in ("logistic", "svc"):
        raise ValueError(f"no classifier of kind {kind}")
    named = spellings.where("code IS NOT NULL")
    # every step runs a task for each part, so there are no more parts than the rows need
    rows = _counted(named.repartition(max(1, -(-named.count() // TASK_ROWS))), "variant", low, high)
    learner = LogisticRegression(maxIter=STEPS) if kind == "logistic" else OneVsRest(classifier=LinearSVC(maxIter=STEPS, regParam=0.01), parallelism=4)
    index = StringIndexer(inputCol="code", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    steps: list[Transformer] = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=WIDTH), IDF(inputCol="tf", outputCol="features"), learner]
    learned = Pipeline(stages=steps).fit(index.transform(rows))
    return PipelineModel([*learned.stages, IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)])


def predict(model: PipelineModel, tokens: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(id, token, code) of tokens (id, token): the code that each most likely stands for. Null tokens have none."""
    rows = model.transform(_counted(tokens.select("id", "token"), "token", low, high))
    return rows.select("id", "token", F.when(F.col("token").isNotNull(), F.col("predicted")).alias("code"))
