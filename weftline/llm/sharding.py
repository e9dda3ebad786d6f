"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned.

The range key is the 64-bit hash of the text, so equal texts lie together. ``FINE`` ranges are cut at quantiles of a
size-weighted sample; their exact bytes and rows are then counted, ranges that are overfull (a hot text, or a bad draw)
are subdivided by the hash of doc_id, parts that are overfull still (rows equal in doc_id and text) by the hash of a row
number, and all of them, in key order, are dealt to shards so that bytes come out near equal. DataFrame operations only;
the driver holds the sample and one row per range or part, all of a fixed size.

Defined cases: a null text has size 1 and the CRC of the empty text; null and repeated doc_ids are rows like any other,
and rows that very often repeat both doc_id and text are split over shards where equal sizes need it; an empty table
gives no rows; with fewer rows than shards some shards stay empty; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.storage import materialise

#: Ranges cut from the sample, a power of two, and sampled keys per range.
FINE, PER_RANGE = 4096, 8
#: A range is overfull beyond this share of a shard's bytes, and is then cut into parts of about a fifth of that.
OVERFULL = 0.05
#: ... or beyond this many rows, if that is also four times the mean of all ranges.
OVERFULL_ROWS = 100_000


def _splitters(rows: DataFrame, total: int, seed: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys: at most FINE - 1 ascending longs.

    A record is drawn size * FINE * PER_RANGE / total times on average, by its own hash: the same rows give the same
    sample however they are partitioned.
    """
    share = F.col("size") * (FINE * PER_RANGE / total)
    draw = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select("key", (F.floor(share) + F.when(draw < share - F.floor(share), 1).otherwise(0)).cast("long").alias("w")).filter("w > 0")
    sample = sorted(map(tuple, drawn.groupBy("key").agg(F.sum("w").alias("w")).collect()))
    every, bounds, seen = sum(w for _, w in sample) / FINE, [], 0
    for key, w in sample:
        if seen and seen >= every * (len(bounds) + 1):
            bounds += [key] * int(seen / every - len(bounds))
        seen += w
    return sorted(set(bounds))[: FINE - 1]


def _range_of(key, bounds: list[int]):
    """How many boundaries are <= key: a binary search over a literal array, in a fixed number of steps."""
    if not bounds:
        return F.lit(0)
    table = F.array(*map(F.lit, bounds + [None] * (FINE - len(bounds))))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(FINE.bit_length() - 1))))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) <= key, step).otherwise(0))


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, under the law ``bytes``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    bounds = _splitters(rows, total["bytes"], seed) if total["n"] else []
    spark_bounds = rows.withColumn("range", _range_of(F.col("key"), bounds))

    most = OVERFULL * total["bytes"] / n_shards
    most_rows = max(OVERFULL_ROWS, 4 * total["n"] // FINE)

    def split(frame: DataFrame, by: list[str], name: str, *hashed: str, least: int = 1) -> DataFrame:
        """``frame`` with a column ``name``: the subrange, by hash, of a row whose cell of ``by`` is overfull, else 0.

        Cells of fewer than ``least`` rows are left whole.
        """
        stats = frame.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter(F.col("n") >= least).collect()
        parts = [(*(s[c] for c in by), int(max(5 * s["bytes"] / most if s["bytes"] > most else 1, 2 * s["n"] / most_rows if s["n"] > most_rows else 1))) for s in stats]
        # At most 5 * n_shards / OVERFULL plus FINE / 2 subranges are made.
        table = F.broadcast(spark.createDataFrame([p for p in parts if p[-1] > 1], ", ".join(f"s_{c} int" for c in by) + ", parts int"))
        on = [F.col(c) == F.col(f"s_{c}") for c in by]
        part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*hashed, F.lit(seed)), F.col("parts")).cast("int"))
        return frame.join(table, on, "left").select(*frame.columns, part.alias(name))

    parted = split(spark_bounds, ["range"], "part", "doc_id", "text_crc32")
    # So many rows that a hash of doc_id leaves together are equal rows.
    placed = split(parted, ["range", "part"], "sub", "row", least=20)
    cells = sorted((tuple(x) for x in placed.groupBy("range", "part", "sub").agg(F.sum("size"), F.count("*")).collect()))

    edges = [total["bytes"] * (i + 1) / n_shards for i in range(n_shards - 1)]
    table, before, filled = [], 0, [0] * n_shards
    for r, p, q, size, n in cells:
        shard = bisect_right(edges, before + size / 2)
        table.append((r, p, q, shard, filled[shard]))
        before, filled[shard] = before + size, filled[shard] + n
    cell = F.broadcast(spark.createDataFrame(table, "c_range int, c_part int, c_sub int, shard int, base long"))
    order = Window.partitionBy("range", "part", "sub").orderBy("key", "doc_id", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order))
    return ranked.join(cell, (F.col("range") == F.col("c_range")) & (F.col("part") == F.col("c_part")) & (F.col("sub") == F.col("c_sub"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
