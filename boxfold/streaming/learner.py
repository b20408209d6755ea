"""Learning from a stream: every micro-batch goes on from the boxes stored so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxfold.operators import fit as fitting
from boxfold.operators import score


def _path(folder: str, epoch: int) -> str:
    return f"{folder}/epoch={epoch:012d}"


def stored_epochs(spark: SparkSession, folder: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch="))


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    done = stored_epochs(spark, folder)
    return spark.read.parquet(_path(folder, done[-1])) if done else None


def learn_stream(samples: DataFrame, folder: str, checkpoint: str, learner: str = "improved", by: tuple[str, ...] = ("model_id",), trigger: dict | None = None, **params) -> StreamingQuery:
    """Start learning from a streaming frame of samples.

    An epoch reads the boxes of the epoch before it and writes its own folder, so a batch that runs again after a
    failure starts from the same state and overwrites the same result: exactly once."""
    keys = list(by)

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [e for e in stored_epochs(spark, folder) if e < epoch]
        state = spark.read.parquet(_path(folder, before[-1])) if before else None
        boxes = fitting.fit(batch, learner, keys, state, **params)
        boxes.write.mode("overwrite").parquet(_path(folder, epoch))

    writer = samples.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def predict_stream(samples: DataFrame, boxes: DataFrame, d: int, **how) -> DataFrame:
    """Predictions of a streaming frame by a finished model; map-only, so it needs no state."""
    return score.predict(samples, boxes, d, **how)


def windowed_counts(predicted: DataFrame, time: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Predicted classes per window of event time; later rows than ``late`` are left to a later correction."""
    return predicted.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "y_pred").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "y_pred", "n")
