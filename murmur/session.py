"""Session settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on; cluster sizing stays with the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder the cluster names.

    Where the setting is absent, a session inside one process makes its own; on a cluster
    that is an error, since machines do not see each other's folders.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        root = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="murmur-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, cutting lineage safely."""
    path = scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
