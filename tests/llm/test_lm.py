import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import lm
from weftline.llm.tokens import default_path, encoder

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute_base(docs):
    c = Counter(w for d in docs if not held(d.doc_id) for w in tokens(d.text))
    n, v = sum(c.values()), len(c)
    return n, [(d.doc_id, held(d.doc_id), len(t := tokens(d.text)), sum(w in c for w in t), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d in docs]


def check(docs, rows):
    n, want = brute_base(docs)
    key = lambda r: (str(r[0]), r[2], r[3], r[4])
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in rows], key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6)
    assert all(r.train_tokens == n and r.score < 0 for r in rows)


@pytest.fixture(scope="module")
def scored(spark):
    return lm.op6_lm_scoring(spark, SF).collect()


def test_base_against_brute_force(spark, scored):
    check(spark.read.parquet(f"{SF}/documents.parquet").collect(), scored)


def test_model_beats_the_base_on_held_out_texts(scored):
    out = [r for r in scored if r.held_out]
    assert len(out) > 50 and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_small_head_gives_the_same_base(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    monkeypatch.setattr(lm, "STEPS", 5)
    sf = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{sf}/documents.parquet").collect(), lm.op6_lm_scoring(spark, sf).collect())


def test_head_does_not_change_the_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda r: (r.doc_id, r.n_tokens, r.base_score)
    got = []
    for head in (200_000, 50, 0):
        monkeypatch.setattr(lm, "HEAD", head)
        got.append([r.score for r in sorted(lm.score_documents(df).collect(), key=key)])
    assert got[1] == pytest.approx(got[0], abs=1e-6) and got[2] == pytest.approx(got[0], abs=1e-6)


def test_long_words_are_scored_like_others(spark, monkeypatch):
    """A word of 100 bytes in every text: its bytes and the head change nothing."""
    monkeypatch.setattr(lm, "STEPS", 5)
    docs = spark.createDataFrame([(i, f"{'long' * 25} some words {i % 7} {'rare' * 30}{i}") for i in range(120)], "doc_id long, text string")
    got = []
    for head, size in ((200_000, 64), (200_000, 1000), (0, 0)):
        monkeypatch.setattr(lm, "HEAD", head)
        monkeypatch.setattr(lm, "HEAD_BYTES", size)
        rows = lm.score_documents(docs).collect()
        check(docs.collect(), rows)
        got.append([r.score for r in sorted(rows)])
    assert got[1] == pytest.approx(got[0], abs=1e-6) and got[2] == pytest.approx(got[0], abs=1e-6)
    counts = lm.word_counts(docs)
    assert b"long" * 25 in [bytes(r["word"]) for r in lm.head_words(counts, 1000).collect()]


def test_repeated_ids_give_one_sample(spark):
    rows = [(i % 3, f"text number {i} of an id") for i in range(30)]
    a, b = (lm.sample_windows(spark.createDataFrame(x, "doc_id long, text string").repartition(3), default_path()) for x in (rows, rows[::-1]))
    assert len(a) and a.tolist() == b.tolist()


def test_odd_documents(spark, odd_documents, no_documents):
    check(odd_documents.collect(), lm.score_documents(odd_documents).collect())
    assert lm.score_documents(no_documents).collect() == []
    only = spark.createDataFrame([(i, "held out text") for i in range(30) if held(i)], "doc_id long, text string")
    check(only.collect(), lm.score_documents(only).collect())


@pytest.fixture(scope="module")
def scorer():
    tok = encoder(default_path())
    counts = np.bincount(np.random.default_rng(0).zipf(1.3, 5000) % 50257, minlength=50257)
    v = lm.Vocabulary.of(counts, tok.spaced)
    pairs = np.random.default_rng(1).integers(0, 4, (v.inputs, v.inputs)) * (np.random.default_rng(2).random((v.inputs, v.inputs)) < 0.01)
    return lm.Scorer(default_path(), v, lm.Tables.of(v, pairs, counts, 7), lm.init(v), (pa.array([b"the", b"of"], pa.binary()), np.array([5, 2])), 3, 10, 3)


def plain_hidden(m, x):
    """One window, place by place."""
    h0 = m["e"][x].astype(float) + m["p"]
    q, k, v = np.split(h0 @ m["qkv"], 3, axis=1)
    out = []
    for i in range(len(x)):
        a = np.exp(k[: i + 1] @ q[i] / math.sqrt(lm.WIDTH))
        h = h0[i] + (a @ v[: i + 1] / a.sum()) @ m["o"]
        out.append(h + np.maximum(h @ m["u"], 0) @ m["d"])
    return np.array(out)


def test_hidden_states_against_a_plain_loop(scorer):
    rng = np.random.default_rng(6)
    x = rng.integers(0, scorer.vocabulary.inputs, (3, lm.WINDOW))
    for scale in (1, 30):  # scores so large that they need a shift
        m = scorer.weights | {"qkv": scorer.weights["qkv"] * np.float32(scale)}
        want = np.stack([plain_hidden(m, r) for r in x])
        for first in (0, lm.OVERLAP):
            assert lm.Hidden(m)(x, first) == pytest.approx(want[:, first:], abs=2e-2 if scale > 1 else 1e-4)


def test_classes_are_distributions(scorer):
    v = scorer.vocabulary
    total = np.bincount(v.output, weights=np.exp(v.inside), minlength=v.classes)
    assert total[1:] == pytest.approx(1) and total[0] == 0
    t = scorer.tables
    assert np.exp(t.prior).sum(1) == pytest.approx(1, abs=1e-3) and np.exp(t.first).sum() == pytest.approx(1, abs=1e-3)
    ids = np.arange(len(v.output))
    for c in (0, 1, v.inner, v.classes - 1):
        share = np.exp(np.where(t.single, t.inside[c, v.input], v.inside + t.back[c, v.output]))
        assert np.bincount(v.output[ids], weights=share, minlength=v.classes)[1:] == pytest.approx(1, abs=1e-6)
    spaced = encoder(default_path()).spaced
    assert (v.output[spaced] < v.inner).all() and (v.output[~spaced[: len(v.output)]] >= v.inner).all()


def test_positions_are_causal_and_scored_once(scorer):
    """Windows give what a plain loop over them gives, and a later id changes nothing before it."""
    v, m, t, rng = scorer.vocabulary, scorer.weights, scorer.tables, np.random.default_rng(1)
    texts = [rng.integers(0, 50257, n) for n in (0, 1, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, 300)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    lp, space, on = scorer.positions(np.concatenate(texts), at)
    assert np.exp(space) + np.exp(on) == pytest.approx(1)
    end = 0
    for ids in texts:
        given = np.concatenate([[0], v.input[ids]])
        asked, before = np.concatenate([v.output[ids], [0]]), np.concatenate([[0], v.output[ids]])
        share = [0.0 if i == len(ids) else t.inside[c, v.input[ids[i]]] if t.single[ids[i]] else v.inside[ids[i]] + t.back[c, asked[i]] for i, c in enumerate(np.where(asked < v.inner, 0, before))]
        done, start, want = 0, 0, []
        while done < len(given):
            x = np.zeros(lm.WINDOW, int)
            part = given[start : start + lm.WINDOW]
            x[: len(part)] = part
            h = plain_hidden(m, x)
            z = h @ m["out"] + m["b"] + np.concatenate([np.tile(t.first, (lm.WINDOW, 1)), t.prior[x]], 1)
            go = (h @ m["s"])[:, 0] + t.space[x]
            for i in range(done - start, len(part)):
                c = asked[start + i]
                mine = z[i, : v.inner] if c < v.inner else z[i, v.inner :]
                want.append((z[i, c] - np.log(np.exp(mine).sum()) + share[start + i], -np.log1p(np.exp(-go[i]))))
            done, start = start + len(part), start + lm.WINDOW - lm.OVERLAP
        assert lp[end : end + len(given)] == pytest.approx(np.array([x for x, _ in want]), abs=1e-3)
        assert space[end : end + len(given)] == pytest.approx(np.array([x for _, x in want]), abs=1e-3)
        end += len(given)
    assert end == len(lp)
    other = np.concatenate(texts)
    other[-1] = (other[-1] + 7) % 50257
    changed, _, _ = scorer.positions(other, at)
    assert changed[:-2] == pytest.approx(lp[:-2], abs=1e-4)


def test_every_position_sees_half_a_window_before_it(scorer):
    """A change 32 places back reaches every later score, also where a window's first own position stands."""
    assert lm.WINDOW >= 64 and lm.OVERLAP >= lm.WINDOW // 2 and lm.WIDTH >= 32
    v, rng = scorer.vocabulary, np.random.default_rng(4)
    ids = rng.choice(np.flatnonzero(v.input > v.classes), 200)
    at = np.array([0, len(ids)])
    lp, _, _ = scorer.positions(ids, at)
    for q in (lm.WINDOW, 2 * lm.WINDOW - lm.OVERLAP, 150):
        other = ids.copy()
        other[q - 32] = next(i for i in np.flatnonzero(v.input > v.classes) if v.input[i] != v.input[ids[q - 32]])
        assert abs(scorer.positions(other, at)[0][q] - lp[q]) > 1e-7


def test_places_are_computed_once(scorer, monkeypatch):
    """A text costs its places and what fills its last half window, a short one half a window."""
    computed, rng = [], np.random.default_rng(8)

    class Counted(lm.Hidden):
        def __call__(self, x, first=0):
            out = super().__call__(x, first)
            computed.append(out.shape[0] * out.shape[1])
            return out

    monkeypatch.setattr(lm, "Hidden", Counted)
    for n in (0, 3, lm.OVERLAP - 1, lm.OVERLAP, lm.WINDOW, 300):
        computed.clear()
        scorer.positions(rng.integers(0, 50257, n), np.array([0, n]))
        assert sum(computed) == -(-(n + 1) // lm.OVERLAP) * lm.OVERLAP


def test_training_takes_every_window(spark, scorer, monkeypatch):
    """Every id of every training text is asked for once, also beyond the sample's bounds; the windows' number grows along."""
    line = np.concatenate([[-1], np.arange(20_000), [-2]])
    cut = lm.windows_of(line)
    asked = cut[:, 1:].reshape(-1)
    assert asked[asked > -3].tolist() == line[1:].tolist() and len(cut) > lm.SAMPLE_WINDOWS
    assert lm.windows_of(np.array([-1, -2]))[:, :2].tolist() == [[-1, -2]]
    m, v, t = scorer.weights, scorer.vocabulary, scorer.tables
    text, numbers = " ".join(f"word{i % 50}" for i in range(2000)), {}
    for n in (4, 40):
        df = spark.createDataFrame([(i, text) for i in [i for i in range(200) if not held(i)][:n]], "doc_id long, text string")
        after, numbers[n] = lm.train(df, scorer.tokenizer, v, t, m)
        assert all(np.isfinite(after[k]).all() and (after[k] != m[k]).any() for k in m)
    assert numbers[40] == 10 * numbers[4] > 40 * lm.SAMPLE_WINDOWS
    none = spark.createDataFrame([(i, text) for i in range(30) if held(i)], "doc_id long, text string")
    assert lm.train(none, scorer.tokenizer, v, t, m)[1] == 0


def test_gradients(scorer):
    v, rng = scorer.vocabulary, np.random.default_rng(2)
    m = {k: x.astype(np.float64) for k, x in lm.init(v).items()}
    x, y = rng.integers(0, v.inputs, (2, lm.WINDOW)), rng.integers(0, v.classes, (2, lm.WINDOW))
    w = np.ones((2, lm.WINDOW))
    _, g = lm.gradients(m, v, scorer.tables, x, y, w)
    for k in m:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, step, losses = m[k][i], 1e-4, []
        for s in (step, -step):
            m[k][i] = old + s
            losses.append(lm.gradients(m, v, scorer.tables, x, y, w)[0])
        m[k][i] = old
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(float(g[k][i]), rel=2e-2, abs=1e-5)


def test_gradients_of_queries_keys_and_values(scorer):
    """They are taken through products of weights: each against differences of the loss."""
    v, rng, d = scorer.vocabulary, np.random.default_rng(12), lm.WIDTH
    m = {k: x.astype(np.float64) for k, x in lm.init(v).items()}
    x, y, w = rng.integers(0, v.inputs, (2, lm.WINDOW)), rng.integers(0, v.classes, (2, lm.WINDOW)), np.ones((2, lm.WINDOW))
    _, g = lm.gradients(m, v, scorer.tables, x, y, w)
    for k, part in (("qkv", slice(0, d)), ("qkv", slice(d, 2 * d)), ("qkv", slice(2 * d, 3 * d)), ("o", slice(0, d)), ("e", slice(0, d)), ("p", slice(0, d))):
        mine, own = g[k][:, part], m[k][:, part]
        for i in (np.unravel_index(j, mine.shape) for j in np.argsort(-np.abs(mine), axis=None)[:3]):
            old, losses = own[i], []
            for step in (1e-4, -1e-4):
                own[i] = old + step
                losses.append(lm.gradients(m, v, scorer.tables, x, y, w)[0])
            own[i] = old
            assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(float(mine[i]), rel=2e-2, abs=1e-5)


def test_batches_of_a_column_do_not_matter(scorer):
    texts = ["The of the", None, "", "x" * 300 + " of", "the"] * 3
    a = scorer.texts(pa.array(texts))
    for i in (0, 3, 7):
        b = scorer.texts(pa.array(texts).slice(i, 4))
        assert b["score"].to_pylist() == pytest.approx(a["score"].to_pylist()[i : i + 4])
        assert b["tail"].to_pylist() == a["tail"].to_pylist()[i : i + 4]


def test_a_step_holds_parts_of_its_windows(scorer, monkeypatch):
    import tracemalloc

    v, t, rng = scorer.vocabulary, scorer.tables, np.random.default_rng(8)
    m = {k: x.copy() for k, x in scorer.weights.items()}
    x, y = rng.integers(0, v.inputs, (70, lm.WINDOW)), rng.integers(0, v.classes, (70, lm.WINDOW))
    w = (rng.random((70, lm.WINDOW)) < 0.9).astype(np.float32)
    got, most = [], []
    for part in (8, 70):
        monkeypatch.setattr(lm, "PART", part)
        tracemalloc.start()
        got.append(lm.gradients(m, v, t, x, y, w))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert got[0][0] == pytest.approx(got[1][0], rel=1e-5)
    for k in m:
        assert np.abs(got[0][1][k] - got[1][1][k]).max() <= 1e-5 * np.abs(got[1][1][k]).max() + 1e-9
    assert most[0] < most[1] / 2

    # Adam's rule written out, from the same gradients.
    monkeypatch.setattr(lm, "gradients", lambda *a: (0.0, {k: p * np.float32(0.3) + np.float32(0.01) for k, p in got[0][1].items()}))
    adam, plain = lm.Adam({k: p.copy() for k, p in m.items()}), {k: p.copy() for k, p in m.items()}
    g = lm.gradients()[1]
    first, second = {k: np.zeros_like(p) for k, p in m.items()}, {k: np.zeros_like(p) for k, p in m.items()}
    for i in (1, 2, 3):
        adam.step(v, t, np.zeros((2, lm.WINDOW + 1), np.int32), 0.01)
        for k in m:
            first[k] += (g[k] - first[k]) * np.float32(0.1)
            second[k] += (g[k] * g[k] - second[k]) * np.float32(0.01)
            plain[k] -= np.float32(0.01 / (1 - 0.9**i)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**i)) + np.float32(1e-8))
    assert all((adam.m[k] == plain[k]).all() for k in m)


def test_compiled_loops_give_what_numpy_gives(scorer, monkeypatch):
    """Gradients, Adam's steps and scores, also where exponentials need a shift; no compiler leaves numpy."""
    from dataclasses import replace

    from weftline.llm import kernels

    v, t, rng = scorer.vocabulary, scorer.tables, np.random.default_rng(4)
    sizes = lm.WINDOW, lm.WIDTH, lm.MOST
    assert kernels.native(None, scorer.weights, v, t, *sizes) is None
    made = kernels.compiled()
    if made is None:
        pytest.skip("no Rust compiler, or a processor without its instructions")
    native = kernels.native(made, scorer.weights, v, t, *sizes)
    assert native is not None and kernels.native(made, scorer.weights, v, t, lm.WINDOW, lm.WIDTH * 2, lm.MOST) is None
    texts = [rng.integers(0, 50257, n) for n in (0, 1, lm.OVERLAP - 1, lm.OVERLAP, lm.WINDOW - 1, lm.WINDOW, 300, 0)]
    ids, at = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for scale in (1, 12):
        m = {k: (rng.normal(size=x.shape) * 0.2).astype(np.float32) if k in "bs" else x * np.float32(scale if k in "ep" else 1) for k, x in scorer.weights.items()}
        x, y = rng.integers(0, v.inputs, (37, lm.WINDOW)), rng.integers(0, v.classes, (37, lm.WINDOW))
        w = (rng.random((37, lm.WINDOW)) < 0.8).astype(np.float32)
        y[0], w[1], y[2] = 0, 0, v.classes - 1
        _, want = lm.gradients(m, v, t, x, y, w)
        for _ in range(2):
            got = native.gradients(m, x, y, w)
            assert set(got) == set(want)
            for k in want:
                assert got[k].shape == m[k].shape and np.abs(got[k] - want[k]).max() <= 1e-4 * scale * np.abs(want[k]).max()
        plain, fast = (replace(scorer, weights=m, made=made) for made in (None, made))
        assert plain.native is None and fast.native is not None
        for a, b in zip(plain.positions(ids, at), fast.positions(ids, at), strict=True):
            assert b == pytest.approx(a, abs=1e-4 * scale)
    steps = [lm.Adam({k: x.copy() for k, x in scorer.weights.items()}, n) for n in (None, native)]
    windows = lm.windows_of(np.concatenate([[-1], rng.integers(0, 50257, 5000), [-2]]))
    for i in range(3):
        for adam in steps:
            adam.step(v, t, windows, 0.002)
    for k in scorer.weights:
        assert np.abs(steps[0].m[k] - steps[1].m[k]).mean() < 1e-5
    # Without a compiler the whole job is numpy's.
    monkeypatch.setattr(kernels.shutil, "which", lambda name: None)
    assert kernels.compiled.__wrapped__() is None


def test_compiled_merges_give_the_ids_of_the_library(monkeypatch):
    """Words of letters, digits and marks never reach Python's memo; any other is left to the library, and all ids are its own."""
    import random

    from weftline.llm import kernels
    from weftline.llm.tokens import ChunkEncoder

    made = kernels.compiled()
    if made is None:
        pytest.skip("no Rust compiler, or a processor without its instructions")
    path, rng, left = default_path(), random.Random(5), []
    signs = "abstrevlmd''''.,!019éèßжλ²½_%<|>́ \u0085中😀"
    words = {"".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(5000)}
    words |= {x + chr(c) + y for c in range(33, 0x900) for x, y in (("", ""), ("a", "1"))}
    words |= {"x" * n for n in (1, 300, 511, 512, 513, 700)} | {"".join(rng.choice("abcdefghi") for _ in range(n)) for n in (200, 512, 513)}
    words |= {"<|endoftext|>", "a<|endoftext|>b", "don't", "'s", "a''s", "we'llama", "'", "''ve"}
    words = sorted(words)
    monkeypatch.setattr(ChunkEncoder, "words", lambda self, got, real=ChunkEncoder.words: (left.extend(got), real(self, got))[1])
    column = pa.array([w.encode() for w in words], pa.binary())
    want = [e.ids for e in encoder(path).tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
    for part, expected in ((column, want), (column.slice(7, 90), want[7:97]), (column[:0], [])):
        held, starts, sizes = lm.encoded(part, path, made)
        assert [held[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == expected
    assert "don't" not in left and not any(w.isascii() and w.isalnum() and len(w) <= 512 for w in left)
    assert {"<|endoftext|>", "x" * 513} <= set(left)
    # The numpy way reads the same columns.
    held, starts, sizes = lm.encoded(column, path)
    assert [held[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == want


def test_matrix_tiles_and_vectors_give_what_numpy_gives(scorer, monkeypatch):
    """The same gradients and scores by either kind of instructions, and whole columns as without compiled loops."""
    from dataclasses import replace

    from weftline.llm import kernels

    made = kernels.compiled()
    if made is None:
        pytest.skip("no Rust compiler, or a processor without its instructions")
    v, t, rng = scorer.vocabulary, scorer.tables, np.random.default_rng(14)
    tiled = kernels.loaded(made)
    monkeypatch.setattr(kernels, "flags", lambda: frozenset(kernels.NEEDS))
    plain = kernels.loaded.__wrapped__(made)
    m = {k: x if k not in "bs" else (rng.normal(size=x.shape) * 0.2).astype(np.float32) for k, x in scorer.weights.items()}
    x, y, w = rng.integers(0, v.inputs, (9, lm.WINDOW)), rng.integers(0, v.classes, (9, lm.WINDOW)), np.ones((9, lm.WINDOW), np.float32)
    y[0], y[1], y[2, :15], w[3], w[4, 17:] = 0, v.classes - 1, 0, 0, 0
    _, want = lm.gradients(m, v, t, x, y, w)
    ids, at = rng.integers(0, 50257, 500), np.array([0, 0, 1, 32, 96, 96, 401, 500])
    scores = replace(scorer, weights=m).positions(ids, at)
    for library in (plain, tiled):
        native = kernels.Native(library, v, t, lm.MOST)
        for k, g in native.gradients(m, x, y, w).items():
            assert np.abs(g - want[k]).max() <= 1e-4 * np.abs(want[k]).max()
        other = replace(scorer, weights=m)
        other.__dict__["native"] = native
        for a, b in zip(scores, other.positions(ids, at), strict=True):
            assert b == pytest.approx(a, abs=1e-4)
    texts = pa.array(["The of the", None, "", "x" * 300 + " of", "ünlike 中文 the the"] * 3)
    a, b = (replace(scorer, weights=m, made=made).texts(texts) for made in (None, made))
    for k in a:
        if pa.types.is_floating(a[k].type):
            assert b[k].to_pylist() == pytest.approx(a[k].to_pylist(), abs=1e-3)
        elif k != "models":
            order = [sorted(r, key=str) if isinstance(r, list) else r for r in a[k].to_pylist()]
            assert [sorted(r, key=str) if isinstance(r, list) else r for r in b[k].to_pylist()] == order
    assert [[len(p) for p in r] for r in a["models"].to_pylist()] == [[len(p) for p in r] for r in b["models"].to_pylist()]


def test_a_list_finds_its_words_only():
    from weftline.llm import kernels

    library = kernels.loaded(kernels.compiled())
    if library is None:
        pytest.skip("no Rust compiler, or a processor without its instructions")
    words = pa.array([f"w{i}".encode() for i in range(5000)], pa.binary())
    listed = kernels.Listed(library, words)
    assert listed(words).tolist() == list(range(5000)) and listed(words[40:50]).tolist() == list(range(40, 50))
    assert listed(pa.array([b"w5000", b"w", b"w77", b"w7 "], pa.binary())).tolist() == [-1, -1, 77, -1]
    assert kernels.Listed(library, words[:0])(words[:3]).tolist() == [-1, -1, -1]
