"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are centred and turned by learned rotations (iterative quantisation), whose signs are the code; the code is split
into one-byte substrings, each with its own index. Two codes within Hamming radius r agree up to r // SUBSTRINGS bits on
some substring (pigeonhole), so probing every substring's buckets within that many bits reaches EVERY code within r. The
codes reached are checked on the whole code and those within r reranked by double-precision cosine of the original
vectors. The rotations are fitted, and r is set, on a bounded sample (``SAMPLE`` vectors): the radius holds the true
nearest neighbours of sampled queries with probability ``TARGET``. Where r gives too few, it is widened, so that a cell
always returns as many as it has to.

All vectors are indexed. Equal vectors are one entry with their few smallest ids. Entries are dealt to shards and query
vectors to blocks, both of bounded size; each (shard, block) cell builds its shard's index, and the cells' best are merged.

Defined cases: null, zero and non-finite vectors, and vectors that hold nulls, take no part, neither as queries nor as
candidates; vectors of a length other than the commonest take no part either; a null id takes no part; rows that repeat
an id are candidates of their own, but never for a query with their id; vectors of tiny or huge components are compared
after a division by the largest of them; an empty table gives no rows; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.storage import materialise

ROTATIONS, SAMPLE, SAMPLE_QUERIES, TARGET = 2, 8192, 256, 0.97
SHARD, BLOCK = 8192, 4096
QUERY_EVERY = 50


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Learned rotated codes: ``encode`` gives rows of bytes, one substring each."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 30, seed: int = 5):
        x, rng = unit(sample), np.random.default_rng(seed)
        self.mean = x.mean(0)
        x = x - self.mean
        dim = x.shape[1]
        axes = np.linalg.svd(x.T @ x)[0]
        v, turns = x @ axes, []
        for _ in range(rotations):
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(rounds):
                a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (a @ b).T
            turns.append(axes @ r)
        self.turn = np.concatenate(turns, 1)
        self.bits = self.turn.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((unit(x) - self.mean) @ self.turn >= 0, axis=1)


def radius_for(codes: Codes, sample: np.ndarray, k: int) -> int:
    """The radius that holds a sampled query's k nearest with probability TARGET."""
    if len(sample) < 2:
        return codes.bits
    x, c = unit(sample), codes.encode(sample)
    q = np.arange(min(SAMPLE_QUERIES, len(sample)))
    s = x[q] @ x.T
    s[q, q] = -2
    near = np.argsort(-s, axis=1)[:, : min(k, len(sample) - 1)]
    return int(np.quantile(np.bitwise_count(c[q][:, None, :] ^ c[near]).sum(2), TARGET, method="higher"))


class MultiIndex:
    """One shard's substring indexes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.starts = np.stack([np.searchsorted(codes[self.order[:, j], j], np.arange(257)) for j in range(codes.shape[1])])
        flips = np.arange(256, dtype=np.uint8)
        self.flips = [flips[np.bitwise_count(flips) <= r] for r in range(9)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within ``radius`` of ``code``."""
        flips, seen = self.flips[min(8, radius // len(code))], np.zeros(len(self.codes), bool)
        for j, byte in enumerate(code):
            starts, order = self.starts[j], self.order[:, j]
            for value in (byte ^ flips).tolist():
                seen[order[starts[value] : starts[value + 1]]] = True
        at = np.flatnonzero(seen)
        return at[np.bitwise_count(self.codes[at] ^ code).sum(1) <= radius]


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (array of double) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    # A cosine knows no scale; squares of such components would be 0 or infinite.
    most = F.array_max(F.transform("embedding", F.abs))
    scaled = F.when((most > 1e-100) & (most < 1e100), F.col("embedding")).otherwise(F.transform("embedding", lambda x: x / most))
    return rows.select("vec_id", scaled.alias("embedding"))


def nearest(vectors: DataFrame, k: int = 5, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every``, its k nearest found."""
    spark, keep = vectors.sparkSession, k + 1
    rows = valid(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if lengths:
        rows = rows.filter(F.size("embedding") == lengths[0]["n"])
    # Ids of a vector beyond the first k + 1 cannot be among anyone's k nearest: the window keeps them before its shuffle.
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep)
    entries = materialise(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.xxhash64("embedding")), "entries")
    asked = materialise(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query"), "embedding").distinct(), "queries")
    # Where one id only asks with a vector, what is that id's alone is left out before lists are cut.
    queries = asked.groupBy("query", "embedding").agg(F.min("query_id").alias("only"), (F.count("*") == 1).alias("alone"))

    n, m = entries.count(), queries.count()
    sample = entries.select("entry", "embedding").orderBy(F.xxhash64("entry", F.lit(3)), "entry").limit(SAMPLE).collect()
    if not n or not m:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    sample = np.array([r["embedding"] for r in sample])
    codes = Codes(sample)
    radius = radius_for(codes, sample, keep)
    model = spark.sparkContext.broadcast((codes, radius))

    shards, blocks = math.ceil(n / SHARD), math.ceil(m / BLOCK)
    shard = F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("query", F.lit(2)), F.lit(blocks)).cast("int")
    left = entries.select(shard.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "entry", "embedding", F.get("ids", F.lit(0)).alias("owner"), (F.size("ids") == 1).alias("owned"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), block.alias("b"), "query", "embedding", "only", "alone")

    def cell(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "entry": [], "score": []}
        if len(entries) and len(queries):
            codes, radius = model.value
            x, q = np.stack(entries["embedding"]).astype(float), np.stack(queries["embedding"]).astype(float)
            ids, index = entries["entry"].to_numpy(), MultiIndex(codes.encode(x))
            lengths = np.sqrt((x * x).sum(1))
            own = defaultdict(list)
            for i, (owner, owned) in enumerate(zip(entries["owner"].tolist(), entries["owned"].tolist(), strict=True)):
                if owned:
                    own[owner].append(i)
            for name, v, c, only, alone in zip(queries["query"].tolist(), q, codes.encode(q), queries["only"].tolist(), queries["alone"].tolist(), strict=True):
                mine = own.get(only, []) if alone else []
                r = radius
                at = np.setdiff1d(index.within(c, r), mine)
                while len(at) < min(keep, len(x) - len(mine)):
                    r = min(codes.bits, r + len(c))
                    at = np.setdiff1d(index.within(c, r), mine)
                score = x[at] @ v / (lengths[at] * np.sqrt((v * v).sum()))
                if len(at) > keep:
                    # Equal scores stay together: the smaller id decides between them later.
                    at, score = at[some := score >= np.partition(score, -keep)[-keep]], score[some]
                out["query"] += [name] * len(at)
                out["entry"] += ids[at].tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype({"query": "int64", "entry": "int64", "score": "float64"})

    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(cell, "query long, entry long, score double")
    named = found.join(entries.select(F.col("entry").alias("e_entry"), "ids"), F.col("entry") == F.col("e_entry"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = named.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep)
    lists = materialise(top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("cost"), "vec_id"))).alias("near")).withColumnRenamed("query", "q"), "nearest")
    others = asked.join(lists, F.col("query") == F.col("q")).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.cost")).alias("score"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
