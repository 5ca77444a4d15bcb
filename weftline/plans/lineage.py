"""Cutting lineage in iterative jobs and writing intermediate tables.

Everything goes to the shared folder that the session names in
``spark.checkpoint.dir``, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; a local one is made only for ``local`` masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder, in the folder of this application."""
    application = spark.sparkContext.applicationId
    return f"{scratch_root(spark).rstrip('/')}/weftline/{application}/{label}-{uuid.uuid4().hex}"


def is_missing_path(error) -> bool:
    """Whether an analysis error says that nothing was written at a path yet."""
    return error.getCondition() == "PATH_NOT_FOUND"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends here, the partitioning is kept."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str, partition_by: str | list[str] | None = None, packed: bool = False) -> DataFrame:
    """Write ``df`` once as parquet in the scratch folder and read it back.

    Used where several later steps read the same result: it is computed once,
    columns can be pruned again and its size is known to the planner. ``packed`` tables take more time to write and less room.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("error")
    if packed:
        writer = writer.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input that sits in few files to all cores before costly work on its texts.

    An input with at least as many partitions as there are cores is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark ``df`` for broadcast only when it holds at most ``max_rows`` rows.

    ``df`` should be cheap to count (a written table). Beyond the bound it is
    returned unmarked and the join shuffles.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Set SQL options (``__`` stands for a dot) and put the old values back."""
    old = {}
    for key, value in values.items():
        name = key.replace("__", ".")
        old[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def fixed_layout(spark: SparkSession, partitions: int):
    """Options for loops over tables that are laid out once.

    The partition count is chosen from the table size, and adaptive execution
    rests because it would drop the known partitioning of checkpointed tables,
    which is what lets every step join without moving the big side. Auto-broadcast
    rests too: the small side is already where it is needed.
    """
    return settings(
        spark,
        spark__sql__shuffle__partitions=str(partitions),
        spark__sql__adaptive__enabled="false",
        spark__sql__autoBroadcastJoinThreshold="-1",
    )


def layout_size(spark: SparkSession, rows: int) -> int:
    """Partitions for a table of ``rows`` narrow rows that a loop reads over and over."""
    fine = -(-rows // 25_000)
    coarse = -(-rows // 20_000_000)
    return max(1, min(fine, max(coarse, spark.sparkContext.defaultParallelism)))
