"""The learners as pipeline stages: an Estimator whose Model adds a prediction column, with save and load."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxfold.kernels import learners as kl
from boxfold.kernels import scoring
from boxfold.lineage import cut
from boxfold.operators import fit as fitting
from boxfold.operators import score
from boxfold.sources import files


class _BoxParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    learner = Param(Params._dummy(), "learner", "name of the learner", TypeConverters.toString)
    theta = Param(Params._dummy(), "theta", "longest edge of a box", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "slope of membership", TypeConverters.toFloat)
    orderCol = Param(Params._dummy(), "orderCol", "column that gives the order of learning", TypeConverters.toString)
    boundary = Param(Params._dummy(), "boundary", "how classes of equal membership are told apart: manhattan, or probability (by the weight of samples)", TypeConverters.toString)
    partRows = Param(Params._dummy(), "partRows", "rows of a part; parts are learnt side by side", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", learner="improved", theta=0.5, gamma=1.0, orderCol="seq", partRows=fitting.MOST_ROWS, boundary="manhattan")

    def _features(self, df: DataFrame):
        c = self.getFeaturesCol()
        return F.col(c) if isinstance(df.schema[c].dataType, T.ArrayType) else vector_to_array(c)


class BoxClassifier(Estimator, _BoxParams):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", learner="improved", theta=0.5, gamma=1.0, orderCol="seq", partRows=fitting.MOST_ROWS, boundary="manhattan") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoxModel:
        x, order = self._features(dataset), F.col(self.getOrDefault("orderCol"))
        s = dataset.select(order.cast("bigint").alias("sid"), order.cast("bigint").alias("seq"), x.alias("xl"), x.alias("xu"), F.coalesce(F.col(self.getLabelCol()).cast("int"), F.lit(-1)).alias("y"))
        boxes = cut(fitting.partitioned(s, self.getOrDefault("learner"), self.getOrDefault("partRows"), theta=self.getOrDefault("theta"), gamma=self.getOrDefault("gamma")))
        return self._copyValues(BoxModel(boxes))


class BoxModel(Model, _BoxParams):
    def __init__(self, boxes: DataFrame | None = None) -> None:
        super().__init__()
        self.boxes = boxes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Map-only: every row keeps its columns and gets the class of its box."""
        d = len(self.boxes.first()["v"])
        learner = self.getOrDefault("learner")
        kind, rule = kl.kind_of(learner), self.getOrDefault("boundary") if self.getOrDefault("boundary") != "manhattan" else kl.rule_of(learner)
        model = score.one_block(self.boxes, d, kind=kind, rule=rule, gamma=self.getOrDefault("gamma"))
        shared = dataset.sparkSession.sparkContext.broadcast(model)
        x = F.transform(self._features(dataset), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
        name = self.getPredictionCol()
        base = dataset.drop(name)
        schema = T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())])
        kept = base.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                values = batch.column(batch.num_columns - 1)
                bounds = pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), values, values], names=["sid", "xl", "xu"])
                xl, xu = score._bounds(bounds, d)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scoring.winners(m, xl, xu).astype(float))], names=schema.names)

        return base.select(*[F.col(f"`{c}`") for c in kept], x.alias("_x")).mapInArrow(run, schema)

    def save(self, path: str, model_id: str = "model") -> None:
        files.store_model(self.boxes, path, model_id, {p.name: v for p, v in self.extractParamMap().items()})

    @classmethod
    def load(cls, spark, path: str, model_id: str = "model") -> BoxModel:
        boxes, params = files.load_model(spark, path, model_id)
        return cls(boxes)._set(**json.loads(json.dumps(params)))
