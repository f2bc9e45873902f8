"""Session helpers: lineage cuts, table access and size checks.

Nothing here assumes local mode.  The one place that invents a directory
(`checkpoint_dir`) refuses to do so on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`.

    Only where that is unset *and* the master is local (tests, notebooks) is a
    temporary folder created; on a cluster an unset folder is an error, since a
    machine-local one would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weft-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Run `df` once, store it in the shared checkpoint folder and forget its lineage.

    A reliable checkpoint (not a local one): losing an executor costs nothing.
    Partitioning and ordering of the plan survive, so a later join on the same
    key needs no second shuffle.
    """
    checkpoint_dir(df.sparkSession)
    return _sized(df.checkpoint(eager=True))


def _sized(df: DataFrame) -> DataFrame:
    """`df`, a checkpoint, with the default estimate of its size where the carried one is of 2,048 EiB or more.

    A checkpoint keeps the estimate of the plan it cuts, and that of a join is the product of
    its sides: from round to round the digits double, until they alone fill the driver.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    if "E+" not in plan.stats().simpleString():  # how such sizes are written; the number itself may have too many digits for Python
        return df
    none = spark._jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def store(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """Write `df` as compressed Parquet to the shared folder; (the table, its path).

    Smaller than a checkpoint, and a part of it can be read by `partition_by`.  The path is
    for `discard`, once nothing reads the table any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of `store`."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """`df`, a scan, in at least as many partitions as there are cores.

    A table of few files would keep its whole work in few tasks; a table of many is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """`collect()` for tables whose size is bounded by design; the bound is checked.

    Reads at most `limit + 1` rows, so a wrong assumption raises instead of
    filling the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, which the driver must not gather")
    return rows
