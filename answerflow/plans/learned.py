"""Estimators that learn in passes over a written table: every pass is one Spark job whose tasks
return sums, and the sums of all tasks are added up key by key before the driver sees them."""

from __future__ import annotations

import base64
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerflow.session import durable

Sums = dict[int, np.ndarray]
# Rows worth a task of their own as long as cores are idle, and rows of a task at most.
ROWS_OF_A_TASK = 16_384
MOST_ROWS_OF_A_TASK = 524_288
# Numbers of all tasks that the driver adds up itself.
AT_THE_DRIVER = 1 << 20


def pieces_of(spark: SparkSession, rows: int, least: int = 0) -> int:
    """Files in which a table is written that every pass reads, so that a pass has all cores at work.
    `least` rows are worth a task of their own."""
    busy = min(-(-rows // (least or ROWS_OF_A_TASK)), spark.sparkContext.defaultParallelism)
    return max(busy, -(-rows // MOST_ROWS_OF_A_TASK), 1)


def keyed(sums: Sums) -> pa.RecordBatch:
    flat = [np.asarray(v, np.float64).ravel() for v in sums.values()]
    offsets = np.cumsum([0, *(len(v) for v in flat)]).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0)))
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), values], names=["key", "values"])


def summed(
    rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Sums], finish: Callable[[Sums], Sums] = lambda sums: sums,
    tasks: int = 0, numbers: int = 0,
) -> Sums:
    """The arrays `work` returns from every task, added up under equal keys.

    Each key is added up in one task, so what a model learns from is spread by key and neither
    a task nor the driver holds the sums of all tasks. `finish` turns the sums of the keys in a
    task into what the driver gets. With one task for all rows there is nothing to add up; with
    few, or few cores, no more tasks add up than there are of them. If a task returns no more than
    so many `numbers` and those of all tasks are few, the driver adds them up; `finish` must not be given then.
    """
    alone = tasks == 1 or 0 < tasks * numbers <= AT_THE_DRIVER
    adding = [min(tasks, rows.sparkSession.sparkContext.defaultParallelism)] if tasks else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = work(batches)
        yield keyed(finish(sums) if alone else sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for batch in batches:
            for key, values in zip(batch.column("key").to_pylist(), batch.column("values")):
                values = values.values.to_numpy(zero_copy_only=False)
                total[key] = total[key] + values if key in total else values
        yield keyed(finish(total))

    kind = "key long, values array<double>"
    partial = rows.mapInArrow(run, kind)
    table = (partial if alone else partial.repartition(*adding, "key").mapInArrow(add, kind)).toArrow()
    found: Sums = {}
    for key, values in zip(table.column("key").to_pylist(), table.column("values")):
        values = np.array(values.values)
        found[key] = found[key] + values if key in found else values
    return found


def rows_of(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def numbers_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


class LearnedEstimator(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """`settings` names the parameters of a subclass with their defaults."""

    settings: dict[str, object] = {}

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        for name in cls.settings:
            setattr(cls, name, Param(Params._dummy(), name, name))

    def __init__(self, **given):
        super().__init__()
        self._setDefault(seed=42, **self.settings)
        self._set(**given)

    def value(self, name: str):
        return self.getOrDefault(name)

    def training_rows(self, df: DataFrame) -> DataFrame:
        """Written rows (row, x, y, weight); `row` is a hash of the features, so equal rows have equal
        hashes. Rows without features or label are left out; a weight that is missing is 1."""
        weight = F.coalesce(F.col(self.getWeightCol()), F.lit(1.0)) if self.isDefined(self.weightCol) else F.lit(1.0)
        x = vector_to_array(self.getFeaturesCol())
        rows = df.where(F.col(self.getFeaturesCol()).isNotNull() & F.col(self.getLabelCol()).isNotNull())
        return durable(
            rows.select(
                F.xxhash64(x).alias("row"), x.alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"),
                weight.cast("double").alias("weight"),
            ).hint("rebalance")  # files of a good size: a small table is one task in every pass
        )


class LearnedModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose learned arrays are a parameter, so that it is stored and read like any stage."""

    state = Param(Params._dummy(), "state", "learned arrays")

    @classmethod
    def of(cls, features: str, **arrays) -> "LearnedModel":
        out = io.BytesIO()
        np.savez(out, **{k: np.asarray(v) for k, v in arrays.items()})
        model = cls()
        model._set(featuresCol=features, state=base64.b64encode(out.getvalue()).decode())
        return model

    def arrays(self) -> dict[str, np.ndarray]:
        with np.load(io.BytesIO(base64.b64decode(self.getOrDefault("state")))) as found:
            return dict(found)

    def outputs(self, learned: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        """From a matrix of features to (probability of label 1, prediction), or to predictions."""
        raise NotImplementedError

    def applied(self, df: DataFrame) -> Column:
        apply = self.outputs(self.arrays())

        @F.pandas_udf("array<double>")
        def of(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            return pd.Series(list(apply(np.stack(features.to_numpy()))))

        return of(vector_to_array(self.getFeaturesCol()))


class LearnedClassifier(LearnedModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        found = df.withColumn("_learned", self.applied(df))
        return found.withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_learned")[0], F.col("_learned")[0])), "prediction": F.col("_learned")[1],
        }).drop("_learned")


class LearnedRegressor(LearnedModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.applied(df)[0])
