"""What the operators need beside the session: tables in the shared folder, joins on hot keys, and the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready, shared_dir


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rasterloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what table() wrote; only once nothing lazy reads it any more."""
    path = getattr(df, "_rasterloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def split_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int, share: float = 1e-4, least: int = 1000) -> DataFrame:
    """left and right joined on key, of which right holds a row or few a value. sizes (key, n): rows of left by key. Keys of at least `share` of all total rows (so 1 / share of them at most, a proven bound) stay where they are: their rows of right are broadcast, and only the others are shuffled."""
    heavy = table(sizes.where(F.col("n") >= F.lit(max(least, share * total))).select(key), "heavy")
    if heavy.isEmpty():
        return left.join(right, key)
    few = F.broadcast(heavy)
    near = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key)
    return near.unionByName(left.join(few, key, "left_anti").join(right, key))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
