"""A linear ranking model over feature tables, fitted by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ready(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    numbers = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    return df.withColumns(numbers | ({"_label": F.col(label).cast("double")} if label else {}))


def fit_logistic(df: DataFrame, features: list[str], label: str, strength: float = 1.0, rounds: int = 1000) -> PipelineModel | None:
    """Standardised features and logistic regression with an L2 penalty of 1 / (strength * rows).

    Missing features count as 0. None if the rows don't hold both labels.
    """
    n, pos = df.agg(F.count("*"), F.count_if(F.col(label))).first()
    if pos in (0, n):
        return None
    steps = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        LogisticRegression(featuresCol="_scaled", labelCol="_label", probabilityCol="_p", regParam=1 / (strength * n), standardization=False, maxIter=rounds),
    ]
    return Pipeline(stages=steps).fit(_ready(df, features, label))


def score_logistic(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """The rows with `score`, the chance of the label to five digits, so that few distinct scores are ranked; constant features add nothing."""
    kept = [c for c in df.columns if c not in features]
    return model.transform(_ready(df, features)).select(*kept, F.round(vector_to_array("_p")[1], 5).alias("score"))
