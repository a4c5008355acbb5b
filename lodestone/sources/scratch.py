"""Tables cut from their lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows written once in the session's checkpoint folder and read from there: survives lost executors.

    Without a folder a local session gets one of its own; on a cluster that is an error.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return rows.checkpoint()
