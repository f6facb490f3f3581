"""Fitted models on their way to the executors."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shipped:
    """A model as broadcast bytes: its class travels by value, as the functions do (see the
    package), so a worker needs no copy of this library. A task unpacks it once.

    Models have a bound that does not follow the documents (classes, buckets, items of one
    index), which is what makes them fit for a broadcast.
    """

    def __init__(self, spark: SparkSession, model):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(model))
        self._model = None

    @property
    def value(self):
        if self._model is None:
            self._model = cloudpickle.loads(self._packed.value)
        return self._model
