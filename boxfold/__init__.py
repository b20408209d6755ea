"""boxfold: Spark-first fuzzy box analytics and tabular data preparation."""

__version__ = "0.1.0"
