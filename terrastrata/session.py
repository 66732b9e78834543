"""Session helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="terrastrata-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scanned_again(df: DataFrame) -> DataFrame:
    """``df`` for several scans: stored once if making it takes a shuffle, else as it is, since reading its input again costs less than writing it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return checkpointed(df) if re.search(r"(?m)^[\s:+-]*(Join|Aggregate|Window|Sort|Distinct|Repartition|RebalancePartitions|GlobalLimit|FlatMapGroups|FlatMapCoGroups)", plan) else df
