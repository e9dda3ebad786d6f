import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from weftline.llm import dac
from weftline.llm.tokens import default_path, pack_ids
from weftline.storage import new_path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=5))
def test_segment_round_trip(docs):
    flat = np.array([x for d in docs for x in d], np.uint32)
    seg = dac.Segment(dac.encode_segment([None if i == 1 else i - 2 for i in range(len(docs))], [len(d) for d in docs], flat))
    assert (seg.ids() == flat).all() and seg.doc_ids == [None if i == 1 else i - 2 for i in range(len(docs))]
    assert [seg[i] for i in range(0, len(flat), 7)] == flat[::7].tolist()
    assert seg.at(np.arange(len(flat))).tolist() == flat.tolist()
    assert np.diff(seg.offsets).tolist() == [len(d) for d in docs]


def expected(docs):
    tok, start, out = Tokenizer.from_file(default_path()), 0, []
    for d in sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id or 0)):
        ids = pack_ids(tok.encode(d.text or "", add_special_tokens=False).ids) + b"\0\0\0\0"
        out.append((d.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_files(spark, documents, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_IDS", 5000)
    path = new_path(spark, "t")
    dac.write_tokens(spark.createDataFrame([(d.doc_id, d.text) for d in documents], "doc_id long, text string"), path)
    got = sorted(map(tuple, dac.read_tokens(spark, path).collect()))
    assert got == expected(documents)
    assert spark.read.parquet(path).count() > 4
    # Random access to the written files: first, last and other tokens, and what is not there.
    tok, every = Tokenizer.from_file(default_path()), {d.doc_id: d.text or "" for d in documents}
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in every.items()}
    wanted = [(i, p) for i in ids for p in {0, len(ids[i]) // 2, len(ids[i]) - 1}]
    frame = spark.createDataFrame(wanted + [(-9, 0), (wanted[0][0], -1), (wanted[0][0], 10**9)], "doc_id long, position long")
    rows = dac.lookup_tokens(spark, path, frame).collect()
    assert sorted(map(tuple, rows)) == sorted((i, p, ids[i][p]) for i, p in wanted)


def test_equal_rows_are_spread(spark):
    path = new_path(spark, "t")
    dac.write_tokens(spark.createDataFrame([(None, "one text of many")] * 4000, "doc_id long, text string").repartition(4), path)
    assert spark.read.parquet(path).count() == 4 and len({r.start for r in dac.read_tokens(spark, path).collect()}) == 4000
    some = spark.createDataFrame([(None, 0)], "doc_id long, position long")
    assert dac.lookup_tokens(spark, path, some).count() == 4000


def test_odd_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        path = new_path(spark, "t")
        dac.write_tokens(docs, path)
        got, want = dac.read_tokens(spark, path).collect(), expected(docs.collect())
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), n, c) for d, _, n, c in want)
        end = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == end
            end += r.n_tokens
