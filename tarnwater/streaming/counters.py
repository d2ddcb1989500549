"""Statistics kept up to date as dates arrive: counters by cell and class add up, everything else follows from them.

Each micro-batch is reduced to its counts and appended under its batch number, so a batch that is run again replaces itself. A reader
sums the batches; compact() folds them into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import CELL, StatisticsParams, ratio
from ..operators.statistics import masks


def class_counts(obs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return obs.groupBy(*keys, "cls").agg(F.count("*").alias("n"))


def follow(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = CELL, **trigger) -> StreamingQuery:
    """Start a query that folds observations into counters at `path`; trigger as for writeStream, by default all that is there."""

    def fold(batch: DataFrame, number: int) -> None:
        class_counts(batch, keys).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def statistics(spark: SparkSession, path: str, params: StatisticsParams = StatisticsParams(), keys: Sequence[str] = CELL) -> DataFrame:
    """The statistics of all observations so far."""
    counts = spark.read.parquet(path).groupBy(*keys, "cls").agg(F.sum("n").alias("n"))
    valid = F.col("cls") != params.nodata
    total = lambda pred: F.sum(F.when(pred, F.col("n")).otherwise(0))
    best = F.max_by(F.col("cls"), F.when(valid, F.col("n") * 1024 - F.col("cls")))
    out = counts.groupBy(*keys).agg(total(valid).alias("valid_count"), total(valid & F.col("cls").isin(*params.water)).alias("water_count"), total(valid & (F.col("cls") == params.cloud)).alias("cloud_count"), F.coalesce(best, F.lit(params.nodata)).cast("int").alias("mode_class"))
    out = out.withColumns({"water_prob": ratio(F.col("water_count"), F.col("valid_count")), "cloud_frac": ratio(F.col("cloud_count"), F.col("valid_count"))})
    return out.withColumns(masks(F.col("water_prob"), params))


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str] = CELL) -> None:
    """One summed batch at `target` in place of many at `path`."""
    spark.read.parquet(path).groupBy(*keys, "cls").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("batch").parquet(target)
