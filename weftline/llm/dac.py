"""Token files with directly addressable codes.

Ids are split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one; a bitmap beside it
says which of them continue, and a rank directory (one count per 512 bits) turns a position on level k into its position
on level k + 1. Any id is read by one chunk and one rank per level, without decoding its neighbours.

A segment is one self-contained byte string: header, document directory, levels. Segments are rows of a Parquet dataset
(``part, segment, ids_before, n_ids, doc_ids, starts, payload``) in ascending document order, so that writing needs
nothing but Spark's own committed output and reading works on any store that Spark reads. Files are not compressed:
``lookup_tokens`` finds a document's segment in the two directory columns alone, and reads any of its tokens from the
stored bytes by one chunk and one rank a level.

Defined cases: a null or empty text is its end id alone; special tokens in a text have their own ids; null doc_ids sort
first; repeated doc_ids are documents of their own, ordered by the hash of their text; rows equal in both are spread like
others; an empty table gives an empty dataset and no rows; a lookup of an unknown doc_id or of a position outside a
document gives no row, one of a repeated doc_id a row for each of its documents; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import blocks, bounded_batches, default_path, encoder, grouped, releasing
from weftline.storage import new_path, partitions

MAGIC, BLOCK = b"DACS", 512
#: Ids after which a segment is closed; a longer document has one of its own.
SEGMENT_IDS = 1 << 20
FILE = "part int, segment int, ids_before long, n_ids long, doc_ids array<long>, starts array<long>, payload binary"


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one segment: ``lengths[i]`` ids belong to ``doc_ids[i]``, in order."""
    out = [b""]
    null = np.array([d is None for d in doc_ids], bool)
    out.append(np.packbits(null, bitorder="little").tobytes())
    out.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.append(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8").tobytes())
    rest, levels = ids.astype(np.uint32, copy=False), 0
    while True:
        chunks = (rest & 255).astype(np.uint8)
        more = rest > 255
        words = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint64)]).astype("<u4")
        out += [struct.pack("<QQ", len(chunks), len(words)), chunks.tobytes(), words.tobytes(), ranks.tobytes()]
        levels += 1
        rest = rest[more] >> 8
        if not len(rest):
            break
    out[0] = MAGIC + struct.pack("<IIQ", levels, len(doc_ids), len(ids))
    return b"".join(out)


class Segment:
    """A reader over the bytes of one segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        levels, docs, self.n_ids = struct.unpack_from("<IIQ", payload, 4)
        at = 20
        null = np.unpackbits(np.frombuffer(payload, np.uint8, (docs + 7) // 8, at), count=docs, bitorder="little")
        at += (docs + 7) // 8
        ids = np.frombuffer(payload, "<i8", docs, at)
        self.doc_ids = [None if n else int(d) for n, d in zip(null, ids, strict=True)]
        at += 8 * docs
        self.offsets = np.frombuffer(payload, "<i8", docs + 1, at)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            n, words = struct.unpack_from("<QQ", payload, at)
            at += 16
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, words, at + n)
            ranks = np.frombuffer(payload, "<u4", -(-n // BLOCK) + 1, at + n + words)
            at += n + words + 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``: one chunk and one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            within = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(ranks[block]) + int(within.sum()), shift + 8
        return value

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at many positions: for each, one chunk and one rank a level."""
        out, rows, i = np.zeros(len(places), np.uint32), np.arange(len(places)), places.astype(np.int64)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[rows] |= chunks[i].astype(np.uint32) << np.uint32(8 * k)
            more = (bits[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)
            rows, i = rows[more], i[more]
            if not len(rows):
                break
            block = i // BLOCK
            # The set bits before each position in its block of bits.
            at = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
            left = np.clip(i[:, None] - 8 * at, 0, 8)
            held = bits[np.minimum(at, len(bits) - 1)] & ((1 << left) - 1).astype(np.uint8)
            i = ranks[block].astype(np.int64) + np.bitwise_count(held).sum(1, dtype=np.int64)
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, at = np.zeros(self.n_ids, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            values = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out[:] = values
            else:
                out[at] |= values
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            at = np.flatnonzero(more) if at is None else at[more]
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode every text, append the end id, and write segments in ascending doc_id order below ``path``."""
    file = tokenizer or default_path()
    bounded_batches(docs.sparkSession)

    def segments(batches):
        tok, part, segment, before = encoder(file), TaskContext.get().partitionId(), 0, 0
        names, lengths, held, n = [], [], [], 0

        def close():
            nonlocal segment, before, names, lengths, held, n
            payload, starts = encode_segment(names, lengths, np.concatenate(held)), np.concatenate([[0], np.cumsum(lengths)[:-1]])
            row = pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (segment, pa.int32()), (before, pa.int64()), (n, pa.int64()), (names, pa.list_(pa.int64())), (starts, pa.list_(pa.int64())), (payload, pa.binary()))],
                names=["part", "segment", "ids_before", "n_ids", "doc_ids", "starts", "payload"],
            )
            segment, before, names, lengths, held, n = segment + 1, before + n, [], [], [], 0
            return row

        for batch in grouped(batches):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in blocks(texts):
                ids, at = tok.encode_column(texts[lo:hi])
                ids, at = np.insert(ids, at[1:], 0), at + np.arange(len(at))  # the end id after every row
                first = 0
                for i in range(1, len(at)):
                    names.append(doc_ids[lo + i - 1])
                    lengths.append(int(at[i] - at[i - 1]))
                    n += lengths[-1]
                    if n >= SEGMENT_IDS:
                        held.append(ids[at[first] : at[i]])
                        first = i
                        yield close()
                held.append(ids[at[first] :])
        if names:
            yield close()

    # The hash parts a doc_id that very many rows repeat, and the row's number rows that are equal in both.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").mapInArrow(releasing(segments), FILE).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files at ``path``: ``doc_id, start, n_tokens, ids_crc32, ids`` (little-endian unsigned 32-bit)."""
    files = spark.read.schema(FILE).parquet(path)

    def documents(batches):
        for batch in batches:
            for part, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                segment = Segment(payload.as_buffer().to_pybytes())
                raw, at = memoryview(segment.ids().astype("<u4", copy=False).tobytes()), segment.offsets
                spans = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(spans), pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(at[:-1] + before, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(x) for x in spans], pa.int64())],
                    names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    # One row per part, and there are no more parts than the writer had partitions.
    ends = files.groupBy("part").agg(F.max(F.col("ids_before") + F.col("n_ids")).alias("n"))
    base = ends.select(F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = files.select("part", "ids_before", "payload").mapInArrow(documents, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), F.col("part") == F.col("b_part")).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, position, id`` for the rows (``doc_id``, ``position``) of ``wanted``: random access to the files at ``path``."""
    files = spark.read.schema(FILE).parquet(path)
    # Only the directory's columns are read here.
    held = F.explode(F.arrays_zip(F.col("doc_ids").alias("doc"), F.col("starts").alias("start"), F.concat(F.slice("starts", 2, F.size("starts")), F.array("n_ids")).alias("stop"))).alias("d")
    documents = files.select("part", "segment", "n_ids", held).select("part", "segment", "d.doc", "d.start", "d.stop")
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"))
    met = asked.join(documents, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("position") >= 0) & (F.col("position") < F.col("stop") - F.col("start")))
    # A segment's bytes meet the positions asked of it in stretches of a bounded number.
    places = met.groupBy("part", "segment", F.pmod(F.xxhash64("doc_id", "position"), F.lit(16)).alias("salt")).agg(F.collect_list(F.struct("doc_id", "position", (F.col("start") + F.col("position")).alias("at"))).alias("places"))
    places = places.select(F.col("part").alias("p_part"), F.col("segment").alias("p_segment"), "places")
    rows = files.select("part", "segment", "payload").join(places, (F.col("part") == F.col("p_part")) & (F.col("segment") == F.col("p_segment"))).select("payload", "places")

    def read(batches):
        for batch in batches:
            for payload, places in zip(batch.column(0), batch.column(1), strict=True):
                each = places.values
                doc_ids, positions, at = (each.field(i) for i in range(3))
                ids = Segment(payload.as_buffer().to_pybytes()).at(at.to_numpy())
                yield pa.RecordBatch.from_arrays([doc_ids, positions, pa.array(ids.astype(np.int64))], names=["doc_id", "position", "id"])

    return rows.mapInArrow(read, "doc_id long, position long, id long")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)
