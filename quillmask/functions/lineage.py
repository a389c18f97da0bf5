"""Plans that are cut: a table that many others are built on is written once, to the folder that
the cluster names in spark.checkpoint.dir, so that their plans stay small and a lost executor
costs a re-read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and read back from a checkpoint. Only where no folder is set and everything runs
    on this machine (tests) one is made."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmask-"))
    return df.checkpoint()
