"""The kernels of ``PointBoxes.java`` (folds over whole points) and ``LevelBoxes.java`` (folds over boxes) as SQL functions that no Python worker has to run.

Spark brings the compiler (Janino) that it makes its own plans with; the classes go to the executors as a jar, so nothing has to be
installed.  What they tell is what ``learners`` and ``scoring`` tell, which remain for all other samples and learners."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string

#: Sources, each of which may use those before it.
SOURCES = [os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.java") for name in ("PointBoxes", "LevelBoxes")]

_BOXES = "v:array<double>,w:array<double>,c:int,n_samples:double,centroid:array<double>"
#: SQL function, its class, type of its result.
FUNCTIONS = [
    ("boxfold_accuracies", "PointBoxes$Accuracies", "array<double>"),
    ("boxfold_fitted", "PointBoxes$Fitted", f"array<struct<{_BOXES}>>"),
    ("boxfold_outermost", "LevelBoxes$Outermost", f"array<struct<box_id:bigint,{_BOXES}>>"),
    ("boxfold_coarser", "LevelBoxes$Coarser", f"array<struct<box_id:bigint,{_BOXES}>>"),
]

_compiled: dict[str, dict[str, object]] = {}


def ensure(spark: SparkSession) -> None:
    """Registers the functions in the session; compiles and ships them once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _compiled:
        loader, path = None, os.path.join(tempfile.mkdtemp(prefix="boxfold-jar-"), "boxfold-kernels.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for source in SOURCES:
                compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
                if loader is not None:
                    compiler.setParentClassLoader(loader)
                with open(source) as f:
                    compiler.cook(f.read())
                for name, code in compiler.getBytecodes().items():
                    jar.writestr(name.replace(".", "/") + ".class", bytes(code))
                loader = compiler.getClassLoader()
        sc._jsc.addJar(path)
        _compiled.clear()
        _compiled[sc.applicationId] = {inner: loader.loadClass(f"boxfold.{inner}").getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0)) for _, inner, _ in FUNCTIONS}
    session = spark._jsparkSession
    for name, inner, kind in FUNCTIONS:
        session.udf().register(name, _compiled[sc.applicationId][inner], session.parseDataType(_parse_datatype_string(kind).json()))
