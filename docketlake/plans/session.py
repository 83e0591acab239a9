"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes above which a materialised table is never broadcast, whatever size the optimizer infers for it.
BROADCAST = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir. Where none is named, a local session gets a folder of its own
    and a cluster an error: executors could not read a folder of the driver's machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docketlake-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder, so that later stages neither recompute it nor depend on one executor.

    A checkpoint keeps the optimizer's guess of df's size, which may be far below the truth. The files written are
    measured instead, and a table above BROADCAST carries a hint that keeps it and what is derived from it out of
    broadcast joins. The files go with the last reference to the table where the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out.hint("merge") if checkpoint_bytes(out) > BROADCAST else out


def checkpoint_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that checkpoint() has just given."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    return path.getFileSystem(conf).getContentSummary(path).getLength()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, h: Column, total: int, most: int) -> DataFrame:
    """At most `most` rows of df, which has `total`, in order of a 64-bit hash: the same rows whatever the partitioning.

    Only rows below a bound that about three times as many pass are ordered, so that no task hands on more than its share.
    """
    bound = -(2**63) + int(2**64 * min(1.0, 3 * most / max(1, total)))
    near = df.withColumn("__h", h)
    if bound < 2**63:
        near = near.filter(F.col("__h") < F.lit(bound))
    return near.orderBy("__h").limit(most).drop("__h")
