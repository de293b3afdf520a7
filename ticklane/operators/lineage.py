"""Tables computed once and written to the shared checkpoint folder, their lineage cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session may lack it and gets a folder beside its warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints").rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df computed and checkpointed."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession) -> str:
    """A place for a table in the shared folder, one that nothing else uses."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
