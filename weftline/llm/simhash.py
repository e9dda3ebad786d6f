"""SimHash near-duplicates through an inverted index over positional bytes, with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits share at least FIVE of them,
so every pair that meets in the index has its shared positional bytes tallied, only pairs whose tally reaches five are
retained, and those are verified on the 64 bits.

A list of one byte value would hold one 256th of all fingerprints. Of five shared bytes three at least lie in one half of
the fingerprint, so a posting holds three bytes of a half: four choices in each half, EIGHT postings a fingerprint.
Equal fingerprints are collapsed first: a group of copies is one entry. Lists of more than ``TILE`` entries, counted by a
partial aggregate before anything is gathered, are never paired: their entries are posted again with two more bytes of
the five positions left (a retained pair shares two of those), and a list that is still longer differs in three bytes
only, 2^24 values at most, where each entry looks its neighbours up by flipping up to three bits, in linear time. Lists
leave as links that connect what they connect, not as all their pairs.

Defined cases: a null, empty or blank text has no words and the fingerprint zero, which links like any other; fewer than
three words are one shingle; rows repeating a doc_id are documents of their own that share the component id rule; a null
doc_id takes part and is never a component id unless no other doc_id is reachable; an empty table gives no rows; other
columns are ignored.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.tokens import bounded_batches, releasing
from weftline.operators.components import connected_components
from weftline.storage import materialise, partitions

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Bytes that a pair must share: 8 positions, at most one spoilt by each differing bit.
LEAST_SHARED = 8 - MAX_BITS
#: Most fingerprints of one posting list that are paired up, and most lists that a broadcast names.
TILE, BROADCAST_KEYS = 1024, 200_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` (the 64 bits as a signed long) of every row; text_hash is xxhash64 of the text."""

    bounded_batches(docs.sparkSession)

    def per_batch(batches):
        for batch in batches:
            fp = np.array([simhash(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(per_batch), "doc_id long, text_hash long, fp long")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair shares."""
    x = np.ascontiguousarray(a ^ b)
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are retained by their tally and verified."""
    return (tally(a, b) >= LEAST_SHARED) & (np.bitwise_count(a ^ b) <= MAX_BITS)


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is reachable within one list, each as (least member, member)."""
    n, rows = len(fp), 128
    cuts = range(0, n, rows)  # a block of rows at a time: temporaries stay small
    near = np.concatenate([_linked(*np.broadcast_arrays(fp[i : i + rows, None], fp[None, :])) for i in cuts])
    return _spanning(fp, lambda old: np.concatenate([np.where(near[i : i + rows], old[None, :], np.int32(n)).min(1) for i in cuts]))


def _spanning(fp: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
    """``least`` gives each entry the least label among its neighbours and itself; repeated until no label changes."""
    label, old = np.arange(len(fp), dtype=np.int32), None
    while old is None or (label != old).any():
        old = label
        label = least(old)
        label = label[label]
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[at]], fp[at]


def _flips(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a long list whose entries differ in at most 24 bits: each entry flips up to MAX_BITS of them."""
    bits = [i for i in range(64) if int(np.bitwise_or.reduce(fp ^ fp[0])) >> i & 1]
    if len(bits) > 24:
        # Only where the hashes of two lists collide.
        high = fp & np.uint64(sum(1 << i for i in bits[:-24]))
        parts = [_flips(fp[high == x]) for x in np.unique(high)]
        return tuple(np.concatenate([x[i] for x in parts]) for i in (0, 1))
    dense = np.zeros(len(fp), np.int32)
    for k, i in enumerate(bits):
        dense |= (fp >> np.uint64(i) & np.uint64(1)).astype(np.int32) << k
    table = np.full(1 << len(bits), -1, np.int32)
    table[dense] = np.arange(len(fp), dtype=np.int32)
    masks = [sum(1 << i for i in chosen) for n in range(1, MAX_BITS + 1) for chosen in combinations(range(len(bits)), n)]

    def least(old):
        label = old.copy()
        for mask in masks:
            at = table[dense ^ np.int32(mask)]
            np.minimum(label, np.where(at >= 0, old[at], label), out=label)
        return label

    return _spanning(fp, least)


def _link_lists(batches):
    """Streams posting lists of at most TILE entries, sorted by key: the links of each list."""

    def close(key, fp):
        """All complete lists; those of a few entries together."""
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(cut, len(key)))
        links = []
        for n in np.unique(size[size > 1]).tolist():
            first = cut[size == n]
            if n <= 16:
                i, j = np.triu_indices(n, 1)
                a, b = fp[first[:, None] + i].reshape(-1), fp[first[:, None] + j].reshape(-1)
                ok = _linked(a, b)
                links.append((a[ok], b[ok]))
            else:
                links += [_forest(fp[c : c + n]) for c in first.tolist()]
        a, b = (np.concatenate([x[i] for x in links] or [np.zeros(0, np.uint64)]) for i in (0, 1))
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        other = np.flatnonzero(key != key[-1]) if len(key) else key
        done = int(other[-1]) + 1 if len(other) else 0  # the last list may go on in the next batch
        yield from close(key[:done], fp[:done])
        key, fp = key[done:], fp[done:]
    yield from close(key, fp)


def _link_long(pdf):
    """One list that has all but three bytes in common."""
    import pandas as pd

    a, b = _flips(np.unique(pdf["fp"].to_numpy().view(np.uint64)))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _posting(number: int, positions) -> Column:
    """The key of the bytes at ``positions``; its three lowest bits are ``number``."""
    mask = sum(255 << 8 * i for i in positions)
    held = F.xxhash64(F.lit(mask - (1 << 64) if mask >> 63 else mask), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return held.bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(number))


#: The positions of the eight postings: three of a half.
POSTED = [chosen for half in (range(4), range(4, 8)) for chosen in combinations(half, 3)]


def _by_length(postings: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The postings of lists of at most TILE entries, and those of longer lists (None if there are none)."""
    keys = materialise(postings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(F.col("key").alias("k")), "long-lists")
    n = keys.count()
    if not n:
        return postings, None
    keys = F.broadcast(keys) if n <= BROADCAST_KEYS else keys
    return tuple(postings.join(keys, F.col("key") == F.col("k"), how) for how in ("left_anti", "left_semi"))


def _links_of(postings: DataFrame) -> DataFrame:
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(_link_lists, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints (column ``fp``) that connect exactly what MAX_BITS connects."""
    # A small file would be a task or two: the fingerprints are dealt out before each becomes its postings.
    dealt = distinct.repartition(partitions(distinct.sparkSession))
    postings = dealt.select(F.explode(F.array(*(_posting(i, chosen) for i, chosen in enumerate(POSTED)))).alias("key"), "fp")
    short, long = _by_length(postings)
    found = _links_of(short)
    if long is not None:
        # Two more of the five positions that the list's posting leaves out.
        again = [[(*chosen, *more) for more in combinations(sorted({*range(8)} - {*chosen}), LEAST_SHARED - 3)] for chosen in POSTED]
        keys = F.coalesce(*(F.when(F.col("key").bitwiseAND(F.lit(7)) == i, F.array(*(_posting(0, x) for x in several))) for i, several in enumerate(again)))
        longer = materialise(long.select(F.explode(keys).alias("key"), "fp").distinct(), "long-postings")
        short, long = _by_length(longer)
        found = found.union(_links_of(short))
        if long is not None:
            found = found.union(long.groupBy("key").applyInPandas(_link_long, "a long, b long"))
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id, text_hash, component`` of every row of ``docs``.

    ``component`` names the row's group by a fingerprint of it: two groups never share one, while documents that repeat
    a doc_id, or have none, may give two groups the same ``component_id``.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    parts = connected_components(links(least.select("fp"))).withColumnRenamed("node", "n_fp")
    met = least.join(parts, F.col("fp") == F.col("n_fp"), "left").withColumn("component", F.coalesce("component", "fp"))
    roots = met.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "r")
    named = materialise(met.join(roots, F.col("component") == F.col("r")).select(F.col("fp").alias("c_fp"), "component", "component_id"), "components")
    out = prints.join(named, F.col("fp") == F.col("c_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("component")
