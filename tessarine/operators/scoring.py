"""A pair classifier: calibrated probability that a pair is the same, from its features, and a fixed threshold over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pairs that the classifier is fitted on, at most.
LABELLED = 20_000


def pair_probabilities(pairs: DataFrame, key: str, features: Sequence[str], label: str, labelled: int = LABELLED) -> DataFrame:
    """``pairs`` with probability, from a logistic regression over ``features`` fitted on the rows whose boolean ``label`` is known.

    Fitted on at most ``labelled`` rows drawn by a hash of ``key``. Null and NaN features count as 0 and
    as missing (a feature of its own). Without labels of both kinds the probability is null.
    """
    numbers = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for f in features]
    missing = [F.coalesce(F.isnan(F.col(f).cast("double")), F.lit(True)).cast("double") for f in features]
    shaped = pairs.withColumn("__x", array_to_vector(F.array(*numbers, *missing)))
    drawn = shaped.where(F.col(label).isNotNull()).select("__x", F.col(label).cast("double").alias("__y"), F.xxhash64(key).alias("__h")).orderBy("__h").limit(labelled)
    if drawn.select("__y").distinct().count() < 2:
        return pairs.withColumn("probability", F.lit(None).cast("double"))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r", regParam=0.01, maxIter=50).fit(drawn)
    scored = model.transform(shaped)
    return scored.withColumn("probability", F.get(vector_to_array("__p"), F.lit(1))).drop("__x", "__p", "__r", "__c")


def decided(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` with decision: 'PASS' from ``threshold`` on, else 'REJECT', 'UNRESOLVED' without a probability."""
    p = F.col("probability")
    return pairs.withColumn("decision", F.when(p.isNull(), "UNRESOLVED").when(p >= threshold, "PASS").otherwise("REJECT"))
