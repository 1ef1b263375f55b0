"""Lineage that is cut in the shared folder, for loops whose plans would grow with every pass."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the folder that `spark.checkpoint.dir` names. In local mode, where one machine is all there is, a temporary one is named if the session names none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="sonoframe-")
        context.setCheckpointDir(found)
    return df.checkpoint()
