import numpy as np
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml import Pipeline

from boxfold.functions.register import register
from boxfold.ml import BoxClassifier, BoxModel


def test_pipeline_and_storage(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.random((200, 2)) * 10
    rows = [(i, float(a), float(b), int(a > b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "seq bigint, a double, b double, label int")
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features"), BoxClassifier(theta=0.2)]
    model = Pipeline(stages=stages).fit(df)
    out = model.transform(df)
    assert out.columns[-1] == "prediction" and out.count() == 200
    assert MulticlassClassificationEvaluator(metricName="accuracy").evaluate(out) > 0.9
    boxes = model.stages[-1]
    boxes.save(str(tmp_path))
    again = BoxModel.load(spark, str(tmp_path))
    ready = model.stages[1].transform(model.stages[0].transform(df))
    assert again.transform(ready).select("seq", "prediction").collect() == boxes.transform(ready).select("seq", "prediction").collect()
    assert again.getOrDefault("theta") == 0.2


def test_boundary_by_the_weight_of_samples(spark):
    boxes = spark.createDataFrame([(1, [0.1, 0.1], [0.5, 0.5], 2, 9.0), (2, [0.2, 0.2], [0.3, 0.3], 1, 4.0)], "box_id bigint, v array<double>, w array<double>, c int, n_samples double")
    df = spark.createDataFrame([([0.25, 0.25],), ([0.45, 0.45],)], "features array<double>")
    told = {b: [r["prediction"] for r in BoxModel(boxes)._set(learner="online", boundary=b).transform(df).collect()] for b in ("manhattan", "probability")}
    assert told == {"manhattan": [1.0, 2.0], "probability": [2.0, 2.0]}


def test_sql_functions(spark):
    assert "box_membership" in register(spark)
    row = spark.sql("SELECT box_membership(array(0.1D, 0.2D), array(0.1D, 0.2D), array(0.45D, 0.3D), array(0.6D, 0.6D), 1.0D) AS m, box_overlaps(array(0.2D), array(0.5D), array(0.5D), array(0.6D)) AS o, "
                    "box_contains(array(0.3D), array(0.4D), array(0.2D), array(0.5D)) AS c, box_distance(array(0.2D, 0.1D), array(0.5D, 0.6D), array(0.5D, 0.6D)) AS d, pair_code(10L, 20L) AS p").first()
    assert (round(row["m"], 9), row["o"], row["c"], round(row["d"], 9), row["p"]) == (0.65, True, True, 0.8, 220)
