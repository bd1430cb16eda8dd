"""The scanned-form classifier head and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Makers and models whose images are labelled as scanned forms.
FORM_DEVICES = ("MASTERPAGE", "BV Family", "KEN MANTHEY", "PACS Support PAH", "Fluorospot Compact FD")


def form_label_rule(df: DataFrame, devices: Sequence[str] = FORM_DEVICES) -> DataFrame:
    """Add ``is_form``: a device from the list, in any case, or no maker or model at all."""
    listed = "(?i)" + "|".join(devices)
    maker, model = F.col("manufacturer"), F.col("model")
    unknown = maker.isNull() | model.isNull() | maker.rlike("(?i)null") | model.rlike("(?i)null")
    return df.withColumn("is_form", unknown | maker.rlike(listed) | model.rlike(listed))


def form_classifier(train: DataFrame, features: str = "features", label: str = "class",
                    max_iter: int = 20) -> PipelineModel:
    """Fit one linear layer with a sigmoid on a feature array; gradients are summed across executors."""
    vectors = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("_v"),
                           F.col(label).cast("double").alias("_y"))
    head = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=max_iter, rawPredictionCol="_raw",
                              probabilityCol="_p", predictionCol="_yhat")
    return Pipeline(stages=[head]).fit(vectors)


def score_forms(model: PipelineModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``sigmoid``, the probability of class 1."""
    vectors = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.transform(vectors)
    return scored.withColumn("sigmoid", vector_to_array("_p")[1]).drop("_v", "_raw", "_p", "_yhat")


def classifier_eval(scored: DataFrame, label: str = "class") -> DataFrame:
    """Counts and whole-percent accuracy at a threshold of one half."""
    predicted = F.when(F.col("sigmoid") < 0.5, 0).otherwise(1)
    right = F.count_if(predicted == F.col(label))
    return scored.agg(F.count(F.lit(1)).alias("total"), right.alias("correct")).select(
        "total", "correct", F.expr("100 * correct div total").alias("accuracy"))
