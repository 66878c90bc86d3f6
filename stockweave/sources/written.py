"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder if it names one, else (tests) one beside the warehouse."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').removesuffix('/')}/_checkpoints").removesuffix("/")


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, computed once and written as Parquet; its lineage is cut, and lost executors lose nothing of it."""
    place = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def counted(df: DataFrame, *partition_by: str, **conditions) -> tuple[DataFrame, dict[str, int]]:
    """df as written() has it, and how many of its rows meet each condition, counted by the same job."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions.items())), *partition_by)
    return out, {"rows": 0, **dict.fromkeys(conditions, 0), **seen.get}
