"""A Spark-native engine for code-evidence graphs: extraction, resolution, storage, retrieval and measurement."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


__version__ = "0.2.0"


def attach(spark: SparkSession) -> SparkSession:
    """Let this session's Python workers import the package from where the driver has it.

    Enough where workers see that folder (one machine, a shared mount); elsewhere install the package on the workers or
    pass it with ``--py-files``.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
    return spark
