"""Shared-folder materialisation: how lineage is cut so that lost executors cost one stage, not the job.

``materialise`` writes a DataFrame as Parquet under the folder named by ``spark.checkpoint.dir`` (shared by driver and
executors) and reads it back. A temporary folder is made only when the session names none, which is the case in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session (``spark.checkpoint.dir``), or one of our own where the setting is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written rows."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, for operators that fix a partition count themselves."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
