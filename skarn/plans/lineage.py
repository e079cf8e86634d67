"""Cutting lineage with tables in the shared folder, which outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir; where none is set, a local master gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/skarn/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
