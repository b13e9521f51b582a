"""Tables that several later steps read, written once to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write the frame below spark.checkpoint.dir and read it again. A local session that names no folder uses one beside
    its warehouse; any other must name it."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{at.rstrip('/')}/folioframe/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
