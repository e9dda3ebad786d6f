"""Streaming use of the batch plan: arriving records join the entities that they share keys with.

A store of four tables lies below a path, each partitioned by the batch that wrote it: ``profiles`` and ``keys`` (raw
records and their match keys), ``entities``, and ``replaced`` (components whose rows of earlier batches no longer hold).
A batch looks up the components that share one of its keys, links and merges their records anew together with its own,
writes them and marks the old rows as replaced. So the entities are at all times those of one run over all records that
have arrived, and a batch costs what it touches: its own records and the components it meets.

Defined cases: ordinals are those of one stream, unique over all batches, in any order; a batch that is replayed overwrites
its own rows and reads those of earlier batches only; entities without any key get a new random id at a replay; an empty
batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.link import linked, match_keys
from weftline.operators.merge import merge
from weftline.schemas import CANONICAL, RAW_PROFILE, struct_of
from weftline.storage import materialise

_TABLES = {
    "profiles": f"component bigint, {RAW_PROFILE}",
    "keys": "component bigint, kind string, key string",
    "entities": f"component bigint, cluster_id bigint, {CANONICAL}",
    "replaced": "component bigint",
}


def _rows(spark: SparkSession, path: str, table: str, before: int | None = None) -> DataFrame:
    rows = spark.read.schema(f"{_TABLES[table]}, batch bigint").parquet(f"{path}/{table}")
    return rows if before is None else rows.filter(F.col("batch") < before)


def _standing(spark: SparkSession, path: str, table: str, before: int | None = None) -> DataFrame:
    """Rows of a table that no later batch has replaced."""
    last = _rows(spark, path, "replaced", before).groupBy("component").agg(F.max("batch").alias("replaced"))
    rows = _rows(spark, path, table, before).join(last, "component", "left")
    return rows.filter("replaced is null or replaced <= batch").drop("replaced", "batch")


def _add(batch: DataFrame, number: int, path: str, linkage: str) -> None:
    spark = batch.sparkSession
    arrived = materialise(batch.select(*struct_of(RAW_PROFILE).names), "arrived")
    keys = match_keys(arrived).select("kind", "key").distinct()
    met = materialise(_standing(spark, path, "keys", number).join(keys, ["kind", "key"], "left_semi").select("component").distinct(), "met")
    old = _standing(spark, path, "profiles", number).join(met, "component", "left_semi").drop("component")
    rows = materialise(old.unionByName(arrived), "records")
    clusters = materialise(linked(rows, linkage), "clusters")
    part = clusters.select("ordinal", "component")
    entities = merge(rows, clusters.select("ordinal", "cluster_id")).join(part.withColumnRenamed("ordinal", "cluster_id"), "cluster_id")
    written = {"profiles": rows.join(part, "ordinal"), "keys": match_keys(rows).join(part, "ordinal"), "entities": entities, "replaced": met}
    for table, frame in written.items():
        frame.select(*struct_of(_TABLES[table]).names).write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")


def upsert_entities(profiles: DataFrame, path: str, linkage: str = "greedy"):
    """A streaming query writer: each micro-batch of raw profiles is merged into the store below ``path``."""
    spark = profiles.sparkSession
    for table, schema in _TABLES.items():
        # An empty first batch, so that every table can be read.
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{table}/batch=-1")
    return profiles.writeStream.foreachBatch(lambda batch, number: _add(batch, number, path, linkage))


def latest_entities(spark: SparkSession, path: str) -> DataFrame:
    """``cluster_id`` and the CANONICAL columns of every entity in the store below ``path``."""
    return _standing(spark, path, "entities").drop("component")
