"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxfold.plans import folds, kernels, mixed, models, prepare

QUERIES = {**prepare.QUERIES, **kernels.QUERIES, **models.QUERIES, **folds.QUERIES, **mixed.QUERIES}
SQL = {**prepare.SQL, **kernels.SQL, **models.SQL, **folds.SQL, **mixed.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return models.predict_manhattan(spark, d)
