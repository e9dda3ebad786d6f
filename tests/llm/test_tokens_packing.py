import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from weftline.llm import packing
from weftline.llm.tokens import ChunkEncoder, default_path, pack_ids

LENGTH = packing.LENGTH


@pytest.fixture(scope="module")
def tok():
    return ChunkEncoder(default_path())


PLAIN = Tokenizer.from_file(default_path())  # the library by itself


def whole(tok, text):
    return pack_ids(PLAIN.encode(text, add_special_tokens=False).ids)


def test_special_tokens_have_their_own_ids(tok):
    for text in ("<|endoftext|>", "a <|endoftext|> b", " x<|endoftext|>\ny, <|endoftext|> ", "<|endoftext", "<|endoftext|>" * 3):
        assert tok.encode([text, "a b"]) == [whole(tok, text), whole(tok, "a b")]
    assert 50256 in PLAIN.encode("a <|endoftext|> b", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t  \x0b\x1fab'std1.,é中\U0001f600<|>", "<|endoftext|>"]), max_size=40).map("".join), max_size=4))
def test_memo_gives_the_ids_of_the_whole_text(texts):
    tok = test_memo_gives_the_ids_of_the_whole_text.__dict__.setdefault("tok", ChunkEncoder(default_path(), limit=20))
    assert tok.encode(texts) == [whole(tok, t) for t in texts]


def test_memo_on_documents(tok, documents):
    texts = [d.text for d in documents]
    assert tok.encode(texts) == [whole(tok, t) for t in texts]


def test_a_word_and_one_mark_is_not_taken_apart(monkeypatch):
    """The commonest cuts but plain words take no call of their own; their ids stay those of the whole text."""
    from weftline.llm import tokens

    taken = []
    monkeypatch.setattr(tokens, "_parts", lambda cut, plain=tokens._parts: taken.append(cut) or plain(cut))
    tok = ChunkEncoder(default_path(), limit=3)
    for text in ("One, two. three; One! \u00e9t\u00e9? 7: end.", "two, three, four four,", "x. y.. .z ., , 9,"):
        assert tok.encode([text, text + " a, "]) == [whole(tok, text), whole(tok, text + " a, ")]
    assert sorted(set(taken)) == [",", ".,", "y.."]
    assert tok.encode(["a,\nb. c,\n"]) == [whole(tok, "a,\nb. c,\n")] and any("\n" in c for c in taken)


def check(rows, docs, tok):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append(r)
    for pieces in at.values():
        offset = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == offset
            offset += p.length
        assert offset <= LENGTH
    assert sorted(at) == list(range(len(at)))
    want = Counter()
    for d in docs:
        ids = whole(tok, d.text or "") + b"\0\0\0\0"
        for start in range(0, len(ids) // 4, LENGTH):
            piece = ids[4 * start : 4 * (start + LENGTH)]
            want[d.doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids) // 4] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    return sum(r.length for r in rows) / (LENGTH * max(1, len(at)))


def test_pack(spark, documents, tok):
    docs = spark.createDataFrame([(d.doc_id, d.text) for d in documents], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert check(rows, documents, tok) > 0.97


def test_repeated_ids_of_one_length_are_spread(spark):
    """Null and repeated doc_ids share neither a salt nor, then, a task."""
    docs = spark.createDataFrame([(None, "one text")] * 3000 + [(7, "one text")] * 1000, "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 4000
    pieces = packing.materialise(packing.cut_documents(docs).withColumn("piece", packing.F.monotonically_increasing_id()), "t")
    assert pieces.select(packing.F.pmod(packing.F.xxhash64("piece"), packing.F.lit(64)).alias("s")).groupBy("s").count().agg({"count": "max"}).first()[0] < 200


def test_odd_documents(spark, odd_documents, no_documents, tok):
    check(packing.pack_documents(odd_documents, keep_ids=False).collect(), odd_documents.collect(), tok)
    assert packing.pack_documents(no_documents).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 1000), max_size=40))
def test_histogram_is_packed_exactly(histogram):
    used = Counter()
    for count, lengths in packing.pack_histogram(histogram, 64):
        assert count > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += count
    assert used == Counter({k: v for k, v in histogram.items() if v})
    ranks = defaultdict(list)
    for size, lo, hi, _, _ in packing.slots(packing.pack_histogram(histogram, 64)):
        ranks[size].append((lo, hi))
    for size, spans in ranks.items():
        spans.sort()
        assert [a for a, _ in spans] == [0] + [b for _, b in spans[:-1]] and spans[-1][1] == histogram[size]
