"""Writers. Partitioned tables are overwritten partition by partition; what is there already can be left out before the work."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that df has rows of, keep the others."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def unwritten(df: DataFrame, path: str, by: str) -> DataFrame:
    """The rows of partitions not written yet. The names of partitions are read, not the data."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()] if files.exists(place) else []
    there = [(unquote(n.partition("=")[2]),) for n in names if n.startswith(f"{by}=")]
    if not there:
        return df
    written = spark.createDataFrame(there, "v string")
    return df.join(written, F.coalesce(df[by].cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) == written["v"], "left_anti")


def series_csv(df: DataFrame, path: str, order: str = "month_key") -> None:
    """A series as one CSV file with a header, in order."""
    df.coalesce(1).sortWithinPartitions(order).write.mode("overwrite").option("header", True).csv(path)


def summary_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in one file."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
