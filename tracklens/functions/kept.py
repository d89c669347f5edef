"""Tables that are computed once and kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, label: str = "table") -> DataFrame:
    """df, computed once and kept where every executor can read it again: as Parquet in the shared folder that
    ``spark.checkpoint.dir`` names. Where none is set (local runs) it is persisted."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/tracklens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
