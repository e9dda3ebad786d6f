"""Benchmark decontamination by template canonicalisation.

Texts become canonical words: case and punctuation go, numbers, names and units also have a typed placeholder; a
capitalised word that opens a sentence counts both as a word and as a name. Windows of
five words are hashed twice, literally and, where they hold placeholders, as a template. A template with fewer than
``LITERALS`` other words is made longer until it holds them: to the right, to the left, and to both sides, each hashed. A
unit is one only beside a number. Document windows are hash-joined to benchmark windows. An item is found in a document if at least
``SIMILARITY`` of its windows occur there; windows that occur only as templates count if their slots are consistent, that
is, if one value of the item always stands for one value of the document. Every occurrence of the item is judged by itself:
matches are grouped by the document's position less the item's, half an item either way, and the best group counts.

Windows that no benchmark window can equal are left out before the join by a bitmap of a fixed size (``BITS`` bits, built
from the benchmark and sent to the executors); a full bitmap would let more rows through, never fewer.

An item of fewer than five words is one window as a whole and is found where its words stand in a row.

Defined cases: null and empty texts hold nothing, and items without any word are never found;
items that are equal as canonical words are one item with the least of their item_ids; rows equal in doc_id and text
are one document, rows that share only the doc_id are judged apart; a null doc_id is reported as null; empty tables give
no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.keys import join_keys
from weftline.llm.tokens import blocks, bounded_batches, grouped, releasing
from weftline.storage import materialise

WORDS, SIMILARITY, LITERALS = 5, 0.8, 2
#: Bits of the window bitmap (512 KB).
BITS = 1 << 22

UNITS = frozenset("% $ € £ ° mm cm m km in ft yd mi mg g kg t oz lb ml cl l gal ms s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years mph kmh kph hz khz mhz ghz w kw kwh v mv a ma j kj cal kcal pa kpa bar psi kb mb gb tb usd eur gbp cent cents dollar dollars euro euros pound pounds percent degree degrees meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres".split())
MONEY = frozenset("$ € £ usd eur gbp".split())

# Patterns over single chunks (RE2): a number with nothing but punctuation around it, a capital first, a sentence's end.
_SIGNS = "$€£%°"
_NUMBER = rf"^[^\pL\pN_{_SIGNS}]*[+-]?[0-9][0-9.,:/]*[^\pL\pN_{_SIGNS}]*$"
_CAPITAL, _ENDS = r"^[^\pL\pN]*\p{Lu}[^\pL\pN]*[\pL\pN]", r"[.!?:][\"')\]}»”’]*$"
#: Numbers and what is glued to them come apart.
_GLUED = ((rf"([0-9])([\pL{_SIGNS}])", r"\1 \2"), (r"([$€£])([0-9])", r"\1 \2"))
_PLAIN, _NUM, _UNIT, _NAME = range(4)

_RNG = np.random.default_rng(20)
_BYTE, _MIX = _RNG.integers(0, 2**64, 256, np.uint64) | np.uint64(1), _RNG.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**64, 4, np.uint64)  # what stands for a placeholder of each kind
_POWER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of a string column: a polynomial over random numbers for bytes, then mixed."""
    words = pa.concat_arrays([words])
    raw = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(raw)])
    data = np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)
    power = np.concatenate([[np.uint64(1)], np.full(int(raw.max()) if len(raw) else 0, _POWER)]).cumprod(dtype=np.uint64)
    place = np.arange(at[-1]) - np.repeat(at[:-1], raw)
    run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[place], dtype=np.uint64)])
    return _mixed(run[at[1:]] - run[at[:-1]] + raw.astype(np.uint64))


def _windows(x: np.ndarray, words: int = WORDS) -> np.ndarray:
    n = len(x) - words + 1
    return _mixed(sum(x[i : i + n] * _MIX[i] for i in range(words)))


def _anchored(x: np.ndarray, plain: np.ndarray, row: np.ndarray):
    """(hashes, whether there are any) of windows made longer to hold LITERALS plain words: right, left, and both ways."""
    n, size = len(x) - WORDS + 1, len(x)
    at, begins = np.flatnonzero(plain), np.arange(n)
    count = np.concatenate([[0], np.cumsum(plain)])
    power = np.concatenate([[np.uint64(1)], np.full(size, _POWER)]).cumprod(dtype=np.uint64)
    back = np.concatenate([[np.uint64(1)], np.full(size, np.uint64(pow(int(_POWER), -1, 1 << 64)))]).cumprod(dtype=np.uint64)
    run = np.concatenate([[np.uint64(0)], np.cumsum(x * power[:-1], dtype=np.uint64)])
    before, upto = count[:n], count[WORDS : WORDS + n]
    for salt, (first, last) in enumerate(((None, before + LITERALS - 1), (upto - LITERALS, None), (before - 1, upto)), 2):
        ok = np.full(n, len(at) > 0)
        left, right = begins, begins + WORDS
        if first is not None and len(at):
            ok &= first >= 0
            left = np.minimum(left, at[np.maximum(first, 0)])
        if last is not None and len(at):
            ok &= last < len(at)
            right = np.maximum(right, at[np.minimum(last, len(at) - 1)] + 1)
        ok &= (row[left] == row[begins]) & (row[right - 1] == row[begins])
        yield _mixed((run[right] - run[left]) * back[left] + (right - left).astype(np.uint64)) + np.uint64(salt), ok


def _value(chunk: str, word: str) -> str:
    """The value of a number, for comparing slots."""
    return re.sub(r"[^\d.+-]", "", chunk.replace(",", "")).strip(".") or word


def scan(texts: pa.Array, bitmap: np.ndarray | None, short: tuple[int, ...] = ()):
    """(text number, window position, hash, slots or None) of every window that the bitmap lets through.

    ``short`` are lengths below WORDS whose windows are given too. Without a bitmap the texts are items: one that has just
    so many words is that window, at the position that is its length below zero.

    Slots are None for a literal window, else the placeholders' kinds and values joined by U+001F. A literal window
    that repeats within a text is given once, a template at each of its places.
    """
    texts = pc.fill_null(texts, "")
    digits = pc.match_substring_regex(texts, "[0-9]")
    if pc.any(digits).as_py():
        some = texts.filter(digits)
        for pattern, to in _GLUED:
            some = pc.replace_substring_regex(some, pattern, to)
        texts = pc.replace_with_mask(texts, digits, some)
    split = pc.utf8_split_whitespace(texts)
    at, coded = split.offsets.to_numpy().astype(np.int64), pc.dictionary_encode(split.flatten())
    chunks, index = coded.dictionary, coded.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    if not len(index):
        return
    low = pc.utf8_lower(chunks)
    word = pc.replace_substring_regex(low, r"[^\pL\pN]+", "")
    bare = pc.equal(word, "")
    word = pc.if_else(bare, pc.replace_substring_regex(low, rf"[^{_SIGNS}]+", ""), word)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    kept = flag(pc.not_equal(word, ""))
    kind = np.where(flag(pc.match_substring_regex(chunks, _NUMBER)), _NUM, np.where(flag(pc.is_in(word, pa.array(sorted(UNITS)))), _UNIT, _PLAIN))
    capital, ends, hashes = flag(pc.match_substring_regex(chunks, _CAPITAL)), flag(pc.match_substring_regex(chunks, _ENDS)), _hashes(word)

    money = flag(pc.is_in(word, pa.array(sorted(MONEY))))
    keep = kept[index]
    index, row = index[keep], row[keep]
    if not len(index):
        return
    literal, kind = hashes[index], kind[index]
    opens = np.concatenate([[True], ends[index[:-1]] | (row[1:] != row[:-1])])
    # A unit stands behind its number, money before it as well.
    number, same = kind == _NUM, row[1:] == row[:-1]
    beside = np.concatenate([[False], number[:-1] & same]) | (money[index] & np.concatenate([number[1:] & same, [False]]))
    kind = np.where((kind == _UNIT) & ~beside, _PLAIN, kind)
    # A capital that opens a sentence may be a name or not: its windows are templates both ways.
    upper = capital[index] & (kind == _PLAIN)
    named, kind = np.where(upper, _NAME, kind), np.where(upper & ~opens, _NAME, kind)
    sizes = np.bincount(row, minlength=len(texts))
    first, passes, long = np.concatenate([[0], np.cumsum(sizes)]), [], len(index) >= WORDS
    for k in (k for k in short if k <= len(index)):
        n = len(index) - k + 1
        within = row[k - 1 :] == row[:n]
        passes.append((_windows(literal, k) + np.uint64(8 + k), within if bitmap is not None else within & (sizes[row[:n]] == k), None))
    if long:
        opener = np.convolve(named != kind, np.ones(WORDS, int), "valid") > 0
        inside = row[WORDS - 1 :] == row[: len(row) - WORDS + 1]
        passes.append((_windows(literal), inside, None))
    for kinds, which in ((kind, inside), (named, inside & opener)) if long else ():
        held = np.convolve(kinds > 0, np.ones(WORDS, int), "valid")
        template = np.where(kinds == _PLAIN, literal, _PLACE[kinds])
        passes.append((_windows(template) + np.uint64(1), which & (held > 0) & (held <= WORDS - LITERALS), kinds))
        passes += [(h, inside & ok & (held > WORDS - LITERALS), kinds) for h, ok in _anchored(template, kinds == _PLAIN, row)]
    for h, ok, kinds in passes:
        if bitmap is not None:
            bit = h % np.uint64(8 * len(bitmap))
            ok = ok & (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        seen = set()
        for p in np.flatnonzero(ok).tolist():
            slots = None
            if kinds is not None:
                values = []
                for i, k in zip(index[p : p + WORDS].tolist(), kinds[p : p + WORDS].tolist(), strict=True):
                    if k:
                        w = word[i].as_py()
                        values.append(f"{k}{_value(chunks[i].as_py(), w) if k == _NUM else w}")
                slots = "\x1f".join(values)
            if (key := (int(row[p]), int(h[p]), slots and p)) not in seen:
                seen.add(key)
                yield key[0], int(p - first[row[p]]) if bitmap is not None or sizes[key[0]] >= WORDS else -int(sizes[key[0]]), key[1], slots


def _scan_frame(rows: DataFrame, keys: list[str], short: tuple[int, ...], bitmap=None) -> DataFrame:
    """Windows of ``rows`` (``keys`` and, last, ``text``): keys, pos, hash, slots."""

    def per_batch(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in grouped(batches, len(keys), 2_000_000):
            for lo, hi in blocks(batch.column(len(keys)), size=2_000_000):
                part = batch.slice(lo, hi - lo)
                found = list(scan(pa.concat_arrays([part.column(len(keys))]), bits, short))
                at = pa.array([f[0] for f in found], pa.int64())
                columns = [part.column(i).take(at) for i in range(len(keys))]
                columns += [pa.array([f[1] for f in found], pa.int32()), pa.array(np.array([f[2] for f in found], np.uint64).view(np.int64)), pa.array([f[3] for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "pos", "hash", "slots"])

    return rows.mapInArrow(releasing(per_batch), ", ".join(f"{k} long" for k in keys) + ", pos int, hash long, slots string")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, windows, pos, hash, slots``: every window of every item that differs from the others as canonical words."""
    rows = _scan_frame(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), ["item_id"], tuple(range(1, WORDS)))
    # Items with the same literal windows are one item.
    literal = rows.filter("slots is null").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("all"))
    chosen = literal.groupBy(F.sha2(F.to_json("all"), 256).alias("same")).agg(F.min("item_id").alias("i_id"), F.min(F.size("all")).alias("windows"))
    return rows.join(chosen, F.col("item_id") == F.col("i_id")).select("item_id", "windows", "pos", "hash", "slots")


def _bitmap(windows: DataFrame) -> bytes:
    bits = np.zeros(BITS // 8, np.uint8)
    # h mod BITS of the unsigned hash is its low bits; there are at most BITS of them.
    at = np.array([r[0] for r in windows.select(F.col("hash").bitwiseAND(F.lit(BITS - 1)).cast("int")).distinct().toLocalIterator()], np.int64)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def _consistent(pdf):
    """One (document, item): windows whose slots agree with the likeliest value of each slot in the best occurrence."""
    import pandas as pd
    from bisect import bisect_left, bisect_right
    from collections import Counter, defaultdict

    literal, rows = set(), []
    for at, p, a, b in zip(pdf["pos"], pdf["i_pos"], pdf["i_slots"], pdf["slots"], strict=True):
        if a is None:
            literal.add(p)
        else:
            rows.append((at - p, p, list(zip(a.split("\x1f"), b.split("\x1f"), strict=False))))
    rows.sort(key=lambda r: r[0])
    shifts = [r[0] for r in rows]
    reach = (int(pdf["windows"].iloc[0]) + 3) // 2  # less than how far apart two occurrences are

    def agreeing(part, shift):
        votes = defaultdict(Counter)
        for d, _, pairs in part:
            for a, b in pairs:
                votes[a][b] += 1_000_000 if d == shift else 1
        best = {a: min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}
        return literal | {p for _, p, pairs in part if all(best[a] == b for a, b in pairs)}

    # The whole document is one more group: an item may be spread over it.
    kept = agreeing(rows, None)
    for shift in sorted(set(shifts)):
        near = agreeing(rows[bisect_left(shifts, shift - reach) : bisect_right(shifts, shift + reach)], shift)
        kept = max(kept, near, key=len)
    first = pdf.iloc[0]
    return pd.DataFrame({"doc_id": [first["doc_id"]], "text_hash": [first["text_hash"]], "item_id": [first["i_item"]], "windows": [first["windows"]], "matched": [len(kept)]}).astype({"doc_id": "Int64"})


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash, item_id, windows, matched, kind`` for every document and benchmark item found in it.

    ``text_hash`` is xxhash64 of the text; ``kind`` is ``verbatim`` or ``template``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = materialise(benchmark_windows(benchmark), "benchmark-windows")
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    short = tuple(sorted(r[0] for r in items.filter("pos < 0").select(-F.col("pos")).distinct().collect()))
    windows = _scan_frame(rows, ["doc_id", "text_hash"], short, bitmap)
    side = items.select(F.col("hash").alias("i_hash"), F.col("item_id").alias("i_item"), F.col("pos").alias("i_pos"), F.col("slots").alias("i_slots"), "windows")
    met = windows.join(side, (F.col("hash") == F.col("i_hash")) & (F.col("slots").isNull() == F.col("i_slots").isNull())).select("doc_id", "text_hash", "pos", "slots", "i_item", "i_pos", "i_slots", "windows")
    met = materialise(met, "window-matches")
    tally = met.groupBy("doc_id", "text_hash", "i_item").agg(F.max("windows").alias("windows"), F.size(F.collect_set(F.when(F.col("slots").isNull(), F.col("i_pos")))).alias("literal"), F.size(F.collect_set("i_pos")).alias("any"))
    enough = lambda c: F.col(c) >= SIMILARITY * F.col("windows")
    tally = materialise(tally.filter(enough("any")), "window-tally")
    verbatim = tally.filter(enough("literal")).select("doc_id", "text_hash", F.col("i_item").alias("item_id"), "windows", F.col("literal").cast("long").alias("matched"), F.lit("verbatim").alias("kind"))
    unsure = tally.filter(~enough("literal")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("i_item").alias("i"))
    open_rows = met.join(unsure, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("i_item") == F.col("i")), "left_semi")
    # A group holds windows of one document only, which one task has read whole before.
    template = open_rows.groupBy("doc_id", "text_hash", "i_item").applyInPandas(_consistent, "doc_id long, text_hash long, item_id long, windows int, matched long")
    return verbatim.union(template.filter(enough("matched")).withColumn("kind", F.lit("template")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a benchmark item is found."""
    bad = materialise(contaminated(docs, benchmark).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct(), "contaminated")
    return join_keys(docs, bad, "left_anti", bad.count())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("windows").cast("long").alias("windows"), "matched", "kind")
