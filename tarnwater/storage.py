"""Intermediates on storage that every machine of the cluster sees."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What this process has written and not deleted yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs on one machine, as in tests, and an error if not."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every machine of the cluster sees")
        own = tempfile.mkdtemp(prefix="tarnwater-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = f"file://{own}"
        context.setCheckpointDir(place)
    return place.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts the lineage, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for name in df.inputFiles()[:1]:
        path = name.rsplit("/", 1)[0]
        _delete(spark, path)
        _WRITTEN[:] = [p for p in _WRITTEN if p.rsplit("/", 1)[1] != path.rsplit("/", 1)[1]]


def release(spark: SparkSession) -> None:
    """Delete all intermediates of this process. Frames that read them, results of operators among them, are void from then on."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
