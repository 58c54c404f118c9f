"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast: those of a dimension, packed or not.
FEW = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, from ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder and
    a cluster an error: executors could not read a folder of this machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='strandline-')}")
    return (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application that no one has written to yet, in the shared folder."""
    return f"{shared_folder(spark)}/strandline-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder; who reads it reads only the columns it takes."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else left to Spark's own choice of join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df
