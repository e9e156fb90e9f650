"""Greedy absorption of near duplicates, in the order of their ids, without walking a list.

Edge cases: null ids and pairs of an id with itself take no part; repeated pairs count once; without pairs nothing is absorbed; extra columns are not read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Pairs that are settled in a walk on the driver; ids that are sent to every task.
DRIVER_PAIRS, FEW_IDS = 100_000, 200_000


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset a temporary one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not found:
            found = tempfile.mkdtemp(prefix="tracewell-")
            atexit.register(shutil.rmtree, found, True)
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """df as a table of the shared folder: many pairs take far less there than in a checkpoint."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _dropped(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def absorb(pairs: DataFrame, driver_pairs: int = DRIVER_PAIRS) -> DataFrame:
    """(id, absorber) of pairs (a, b) of near duplicates with a < b: walking up the ids, each id that is still there absorbs its greater
    partners that are, so an id goes to its least partner that stays. An id with no smaller partner left always stays, so each round settles all of these and their
    partners at once; chains of dependent ids are short, and the pairs left shrink every round. The last `driver_pairs` are settled in a walk on the driver, with
    equal results. Who absorbs whom is read from all pairs at the end, as an id can go in an earlier round than the least that absorbs it stays."""
    spark = pairs.sparkSession
    folder = f"{shared(spark)}/absorbed-{uuid.uuid4().hex}"
    every = left = _stored(pairs.select("a", "b").where("a < b"), f"{folder}/pairs")
    kind, gone, k = every.select(F.col("b").alias("id")), None, 0
    try:
        while (n := left.count()) > driver_pairs:
            first = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            out = cut(left.join(_few(cut(first)), "a", "left_semi").select(F.col("b").alias("id")).distinct())
            gone = out if gone is None else gone.unionByName(out)
            few = _few(out)
            rest = left.join(few.withColumnRenamed("id", "a"), "a", "left_anti").join(few.withColumnRenamed("id", "b"), "b", "left_anti")
            left = _stored(rest, f"{folder}/rest{k}")
            if k:
                _dropped(spark, f"{folder}/rest{k - 1}")
            k += 1
        if n:
            walked: set = set()
            for a, b in sorted(map(tuple, left.select("a", "b").collect())):
                if a not in walked:
                    walked.add(b)
            out = spark.createDataFrame([(x,) for x in walked], kind.schema)
            gone = out if gone is None else gone.unionByName(out)
        if gone is None:
            return spark.createDataFrame([], kind.withColumn("absorber", F.col("id")).schema)
        stay = every.join(_few(cut(gone)).withColumnRenamed("id", "a"), "a", "left_anti")
        return cut(stay.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("absorber")))
    finally:
        _dropped(spark, folder)
