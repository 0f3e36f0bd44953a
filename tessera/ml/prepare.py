"""Fitted preparation stages of a saved pipeline.

* ``MatrixPreparer`` (P8): the model matrix of a frame with strings and nulls.
  Numeric and boolean columns become doubles, nulls the train median; strings
  become label codes, nulls the train mode. The fitted model carries its medians,
  modes and codes as tables, so no label passes through the driver, and saves
  them beside the other stages of its pipeline.
* ``PopulationScaler`` (M9): zero mean and unit *population* deviation of a
  vector column. Spark's own scaler divides by the sample deviation; coefficients of
  a saved model then agree with no correction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.quantiles import quantile_row
from tessera.operators.stats import NUMERIC
from tessera.session import materialize

UNKNOWN = "unknown"
BROADCAST_CODES = 100_000


def split_kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric and boolean columns, all others) of ``features``."""
    kinds = NUMERIC + (T.BooleanType,)
    numeric = [c for c in features if isinstance(df.schema[c].dataType, kinds)]
    return numeric, [c for c in features if c not in numeric]


def model_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Every column but the target and the key and time columns; raises
    when none is left."""
    out = [c for c in df.columns if c not in exclude]
    if not out:
        raise ValueError("no feature column is left for the model")
    return out


def label_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, label, code, n): the distinct values of each string column,
    numbered from 0 in order, and how many there are. The values are
    range-partitioned and numbered by partition offsets. A column without a value
    has the one label ``unknown``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("label")) for c in cols])
    seen = df.select(F.inline(pairs)).where(F.col("label").isNotNull()).distinct()
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "name string")
    seen = seen.unionByName(every.join(seen, "name", "left_anti").withColumn("label", F.lit(UNKNOWN)))
    rows = materialize(seen.repartitionByRange("name", "label").sortWithinPartitions("name", "label")
                       .withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("name", "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a column and partition
    of = Window.partitionBy("name")
    before = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("name", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(of).alias("n"))
    rank = F.row_number().over(Window.partitionBy("name", "_part").orderBy("label"))
    return rows.withColumn("_r", rank).join(sizes, ["name", "_part"]).select(
        "name", "label", (F.col("_off") + F.col("_r") - 1).cast("double").alias("code"), F.col("n").cast("double").alias("n"))


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, label): each string column's most frequent value, the smallest of
    equally frequent ones; ``unknown`` for a column without a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("label")) for c in cols])
    counts = df.select(F.inline(pairs)).where(F.col("label").isNotNull()).groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "name string")
    return every.join(best, "name", "left").select("name", F.coalesce("b.label", F.lit(UNKNOWN)).alias("label"))


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "columns filled with their median", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns turned into label codes", TypeConverters.toListString)

    def columns(self) -> tuple[list[str], list[str]]:
        return self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)


class MatrixPreparer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """P8 as an estimator: fit on the train rows, apply to any."""

    @keyword_only
    def __init__(self, *, numeric=None, categorical=None):
        super().__init__()
        self._setDefault(numeric=[], categorical=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MatrixPreparerModel:
        numeric, categorical = self.columns()
        fills = dataset.sparkSession.range(1).select(F.lit(True).alias("one"))
        if numeric:
            as_double = dataset.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
            medians = quantile_row(as_double, numeric, [0.5], "exact", fmt="median_{name}")
            fills = fills.crossJoin(medians)  # one row each
        if categorical:
            m = modes(dataset, categorical)
            fills = fills.crossJoin(m.agg(*[F.max(F.when(F.col("name") == c, F.col("label"))).alias(f"mode_{c}") for c in categorical]))
        codes = label_codes(dataset, categorical) if categorical else dataset.sparkSession.createDataFrame(
            [], "name string, label string, code double, n double")
        model = MatrixPreparerModel(materialize(fills), materialize(codes))
        return self._copyValues(model)


class MatrixPreparerModel(Model, _Columns, MLWritable, MLReadable):
    """``fills``: one row, ``median_{column}`` and ``mode_{column}``; ``codes``:
    (name, label, code, n). A label that the train rows didn't hold gets the next
    code after the last."""

    def __init__(self, fills: DataFrame | None = None, codes: DataFrame | None = None):
        super().__init__()
        self._setDefault(numeric=[], categorical=[])
        self.fills, self.codes = fills, codes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numeric, categorical = self.columns()
        d = dataset.crossJoin(F.broadcast(self.fills))  # one row
        d = d.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"`median_{c}`")) for c in numeric}
                          | {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.col(f"`mode_{c}`")) for c in categorical})
        few = bool(categorical) and self.codes.count() <= BROADCAST_CODES
        for c in categorical:
            own = self.codes.where(F.col("name") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            size = self.codes.where(F.col("name") == c).agg(F.max("n").alias("_n"))  # one row
            d = d.join(F.broadcast(own) if few else own, F.col(f"`{c}`") == F.col("_label"), "left").crossJoin(F.broadcast(size))
            d = d.withColumn(c, F.coalesce("_code", "_n")).drop("_label", "_code", "_n")
        return d.select(*[F.col(f"`{c}`") for c in dataset.columns])

    def copy(self, extra=None):
        that = super().copy(extra)
        that.fills, that.codes = self.fills, self.codes
        return that

    def write(self) -> MLWriter:
        return _PreparerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PreparerReader(cls)


class _PreparerWriter(MLWriter):
    def __init__(self, instance: MatrixPreparerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.fills.write.parquet(f"{path}/fills")
        self.instance.codes.write.parquet(f"{path}/codes")


class _PreparerReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> MatrixPreparerModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/fills"), spark.read.parquet(f"{path}/codes"))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class PopulationScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M9: standardise a vector column by its mean and population deviation.
    The fitted stage is Spark's own scaler model, so it saves and scores as such;
    a column without deviation becomes 0."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "scaled vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> StandardScalerModel:
        a, b = self.getOrDefault(self.inputCol), self.getOrDefault(self.outputCol)
        sample = StandardScaler(inputCol=a, outputCol=b, withMean=True, withStd=True).fit(dataset)
        n, spark = dataset.count(), dataset.sparkSession
        std = Vectors.dense(sample.std.toArray() * (math.sqrt((n - 1) / n) if n else 1.0))
        java = spark._jvm.org.apache.spark.ml.feature.StandardScalerModel(
            sample.uid, _py2java(spark.sparkContext, std), _py2java(spark.sparkContext, sample.mean))
        sample._java_obj.copyValues(java, spark._jvm.org.apache.spark.ml.param.ParamMap.empty())
        return StandardScalerModel(java)._resetUid(sample.uid)
