"""Token ids of whole texts by the tokenizers library, with a bounded memo of the pieces between spaces.

The byte-level BPE's split pattern always starts a new piece at a space that a non-space follows. A text in which every
space is followed by a non-space (or ends the text) can therefore be cut before each space, and equal cuts have equal
ids wherever they stand; each distinct cut is encoded by the library and looked up afterwards. Any other text is
encoded whole, and so is one that holds a special token of the file. Both ways give the ids of the library's plain call
for the whole text (tests/llm compare them).
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space that any white space follows; a few characters more than that do no harm.
_UNSAFE = r" [\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: How the byte-level vocabulary writes a space.
SPACE = "\u0120"
#: After a letter or digit, a run of these is a piece of its own to the tokenizer.
TAIL = ".,;:!?"
_ENCODERS: dict[str, ChunkEncoder] = {}


def default_path() -> str:
    """The public byte-level BPE file; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_ids(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4:
        raise OverflowError("array('I') is not 32 bits wide here")
    if os.sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _parts(cut: str) -> list[str | None]:
    """Memo keys whose ids make up those of a cut; None is a line end between two that are not white space."""
    lines = cut.split("\n") if cut[0] != " " else [cut]
    if len(lines) > 1:
        for x in lines:
            if not x or x[0].isspace() or x[-1].isspace():
                lines = [cut]
                break
    keys = []
    for i, line in enumerate(lines):
        if i:
            keys.append(None)
        word = line.rstrip(TAIL)
        if word and len(word) < len(line) and word[-1].isalnum():
            keys += [" " + word if i else word, " " + line[len(word) :]]
        else:
            keys.append(" " + line if i else line)
    return keys


class ChunkEncoder:
    """Ids of texts, through a memo in two generations of at most ``limit`` cuts each, the older one dropped when full.

    The memo maps a cut without its space, or, for what has no space before it, the string after one space, to its ids
    as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([_UNSAFE, *map(re.escape, special)])
        self.limit, self.memo, self.old = limit, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True
        self.newline = pack_ids(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of every word with a space before it, by encoding many in one string: only their first ids begin with a space."""
        runs = [" " + " ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], "<u4")
        at = [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
        if len(at) != len(words) + 1:
            return self._whole([" " + w for w in words])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, new: list[str]) -> None:
        """Memo entries for cuts that it lacks. Lines and trailing punctuation are pieces of their own to the tokenizer."""
        memo, made, marked, need = self.memo, [], [], set()
        remember = self.old.get
        marks = dict.fromkeys(TAIL, 0)
        for cut in new:
            ids = remember(cut)
            if ids is not None:
                memo[cut] = ids
            elif not cut or cut[-1] not in TAIL and "\n" not in cut:
                need.add(cut)
            elif cut[-1] in marks and cut[-2:-1].isalnum() and "\n" not in cut:
                # The commonest form, a word and one mark.
                word = cut[:-1]
                marked.append(cut)
                marks[cut[-1]] += 1
                if word not in memo:
                    ids = remember(word)
                    if ids is not None:
                        memo[word] = ids
                    else:
                        need.add(word)
            else:
                keys = _parts(cut)
                if len(keys) > 1:
                    made.append((cut, keys))
                for k in keys:
                    if k is not None and k not in memo:
                        ids = remember(k)
                        if ids is not None:
                            memo[k] = ids
                        else:
                            need.add(k)
        need.update(" " + x for x, n in marks.items() if n and " " + x not in memo)
        spaced = [k for k in need if k and k[0] != " "]
        plain = [k for k in need if not k or k[0] == " "]
        memo.update(zip(spaced, self._spaced(spaced), strict=True))
        # The empty key is a space that ends a text.
        memo.update(zip(plain, self._whole([k[1:] if k else " " for k in plain]), strict=True))
        memo[None] = self.newline
        for cut, keys in made:
            memo[cut] = b"".join([memo[k] for k in keys])
        of = {x: memo[" " + x] for x, n in marks.items() if n}
        for cut in marked:
            memo[cut] = memo[cut[:-1]] + of[cut[-1]]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column one after another, and the offsets of its rows; null counts as empty."""
        if len(self.memo) > self.limit:
            self.memo, self.old = {}, self.memo
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, self.unsafe)
        some = pc.any(unsafe).as_py()
        words = pc.split_pattern(pc.if_else(unsafe, "", texts) if some else texts, " ")
        at, coded = words.offsets.to_numpy(), pc.dictionary_encode(words.values)
        keys, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        # A row's first word has no space before it.
        first = index[at[:-1]]
        index[at[:-1]] = np.arange(len(keys), len(keys) + len(first))
        keys += [" " + keys[i] for i in first.tolist()]
        memo = self.memo
        self._learn([k for k in keys if k not in memo])
        found = list(map(memo.__getitem__, keys))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        held, lengths = np.frombuffer(b"".join(found), "<u4"), sizes[index]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        del found, keys
        if ends[-1]:
            shift = starts[index] - ends[:-1]
            kind = np.int32 if max(ends[-1], len(held)) < 2**31 else np.int64
            at_id = np.repeat(shift.astype(kind), lengths)
            at_id += np.arange(ends[-1], dtype=kind)
            ids = held[at_id]
        else:
            ids = held[:0]
        offsets = ends[at]
        if some:
            rows = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            odd = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
            for i, raw in zip(odd.tolist(), self._whole(texts.take(pa.array(odd)).to_pylist()), strict=True):
                rows[i] = np.frombuffer(raw, "<u4")
            ids, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, offsets

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it: all ids in a row, and where each word's begin and how many they are."""
        if len(self.memo) > self.limit:
            self.memo, self.old = {}, self.memo
        memo = self.memo
        self._learn([w for w in words if w not in memo])
        found = [memo[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoder(path: str, limit: int = 250_000) -> ChunkEncoder:
    """One encoder per Python worker and file; ``limit`` bounds its memo."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].limit = limit
    return _ENCODERS[path]


def bounded_batches(spark, rows: int = 1024, size: int = 32_000_000) -> None:
    """Lower the session's Arrow batches to so many rows and bytes: whole texts pass through them.

    The settings stay lowered, as frames are executed after the operator that made them has returned.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def releasing(function):
    """A function of Arrow batches that gives unused memory back when a partition is done, as idle workers stay alive."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return run


def grouped(batches, column: int = 1, size: int = 16_000_000):
    """Successive Arrow batches joined into ones of about ``size`` bytes of text: fewer, larger batches are cheaper here."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, n = [], 0
    if held:
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield joined[0] if joined else held[0]


def blocks(texts: pa.Array, rows: int = 1 << 16, size: int = 16_000_000):
    """(first, last) bounds of runs of at most so many rows and, but for a single text, bytes: bounded work memory."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (i - first >= rows or held + n > size):
            yield first, i
            first = i
            held = 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)
