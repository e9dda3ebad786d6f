"""Sequence packing by shortest-pack-first over the length histogram.

Each document's ids (its end id included) are cut at multiples of the sequence length: whole sequences and one rest.
Only the histogram of piece lengths, at most ``length`` numbers, is packed: lengths are placed longest first, each into
the pattern with the most room left, and patterns carry counts. Pieces then find their pattern by their rank among the
pieces of their length. Ranks come from windows over (length, salt) and a prefix sum over salts, so a length that a
third of all pieces share is spread over many tasks. The salt is a hash of a number that each written piece has of its
own, so null and repeated doc_ids are spread like others.

Defined cases: a null or empty text is its end id alone; null and repeated doc_ids are documents of their own; special
tokens in a text have their own ids; an empty table gives no rows; a text of any length is cut; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import blocks, bounded_batches, default_path, encoder, grouped, releasing
from weftline.storage import materialise, partitions

LENGTH, END = 1024, b"\0\0\0\0"
PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, memo: int = 250_000, block: int = 16_000_000) -> DataFrame:
    """Pieces of at most ``length`` ids: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit) and ``doc_tokens``.

    A worker remembers up to twice ``memo`` cuts and encodes about ``block`` bytes at a time: memory against time.
    """
    path = tokenizer or default_path()
    bounded_batches(docs.sparkSession)

    def pieces(batches):
        tok = encoder(path, memo)
        for batch in grouped(batches, size=block):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in blocks(texts, size=block):
                ids, at = tok.encode_column(texts[lo:hi])
                raw, at, out = ids.astype("<u4", copy=False).tobytes(), at.tolist(), ([], [], [], [], [])
                for doc_id, a, b in zip(doc_ids[lo:hi], at, at[1:], strict=False):
                    n = b - a + 1
                    for start in range(0, n, length):
                        piece = raw[4 * (a + start) : 4 * min(b, a + start + length)]
                        if start + length >= n:
                            piece += END
                        for column, value in zip(out, (doc_id, start, len(piece) // 4, piece, n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(pieces), PIECES)


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Patterns ``(count, lengths)`` that use every piece of the histogram exactly once, by shortest pack first."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # free ids -> patterns with that much room
    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        made = []  # added afterwards, so that this length meets only patterns made of longer ones first
        while left:
            free = max((f for f, packs in room.items() if packs and f >= size), default=None)
            if free is None:
                fit = length // size
                if left >= fit:
                    made.append((left // fit, [size] * fit))
                if left % fit:
                    made.append((1, [size] * (left % fit)))
                break
            count, lengths = room[free].pop()
            take = min(count, left)
            if count > take:
                room[free].append((count - take, lengths))
            room[free - size].append((take, [*lengths, size]))
            left -= take
        for count, lengths in made:
            room[length - sum(lengths)].append((count, lengths))
    return [x for packs in room.values() for x in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, from_rank, to_rank, first_sequence, offset)``: which ranks of a length go where."""
    ranks, first, out = defaultdict(int), 0, []
    for count, lengths in patterns:
        offset = 0
        for size in lengths:
            out.append((size, ranks[size], ranks[size] + count, first, offset))
            ranks[size] += count
            offset += size
        first += count
    return out


def place_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``pieces``: ``piece``, a number of its own, ``length`` and other columns."""
    spark = pieces.sparkSession
    salts = max(64, partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int"))
    counts = materialise(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The pattern table is bounded by the sequence length alone, whatever the number of pieces.
    table = F.broadcast(spark.createDataFrame(slots(pack_histogram(histogram, length)), "s_length int, lo long, hi long, first long, offset long"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("piece")
    ranked = salted.withColumn("at", F.row_number().over(order)).join(base, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at") - 1)
    met = ranked.join(table, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select(*pieces.columns, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, keep_ids: bool = True, **work) -> DataFrame:
    """Every piece with its place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on demand, ``ids``.

    ``work`` is that of ``cut_documents``. Texts are encoded once; the pieces are written to the shared folder and read from there.
    """
    pieces = cut_documents(docs, tokenizer, length, **work).withColumn("ids_crc32", F.crc32("ids")).withColumn("length", F.col("length").cast("int"))
    pieces = materialise((pieces if keep_ids else pieces.drop("ids")).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = place_pieces(pieces, length)
    columns = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*columns, *(["ids"] if keep_ids else []))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
