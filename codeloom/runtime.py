"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a counted side of a join may have to be sent to every executor.
FEW = 200_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder of ``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is this machine."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)



def few(df: DataFrame) -> DataFrame:
    """Checkpointed and counted: at most ``FEW`` rows are broadcast in joins, more are left to Spark."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= FEW else df
