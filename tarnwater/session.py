"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver has it.

    Clusters whose machines don't share that folder install the package or ship it with addPyFile instead.
    """
    try:
        environment = spark.sparkContext.environment
    except Exception:  # a session without a context, as with Connect
        return
    here, now = str(Path(__file__).resolve().parent.parent), environment.get("PYTHONPATH", "")
    if here not in now.split(":"):
        environment["PYTHONPATH"] = f"{here}:{now}" if now else here
