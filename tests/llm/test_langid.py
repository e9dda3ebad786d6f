import math
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    import zlib

    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} == set(held) and len(got) == len(lang)
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.98
    assert sum(r.rejected for r in got.values()) / len(got) < 0.02
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learning_reads_no_held_out_labels(spark, model):
    """Wrong labels and texts in the held-out fold change nothing."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = langid.fit(docs.withColumn("lang", F.when(fold, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(fold, "zzz").otherwise(F.col("text"))))
    assert other.languages == model.languages and (other.table == model.table).all() and other.threshold == model.threshold


def test_whole_text_decides(model):
    texts = ["le de la et que les pour", "the of and to in is that", "der die und zu ist das"]
    assert [x[0] for x in langid.predict_texts(model, texts)] == ["fr", "en", "de"]
    assert langid.predict_texts(model, ["the " + "de la et que les pour une dans " * 4000])[0][0] == "fr"


def test_odd_documents(spark, model, odd_documents, no_documents):
    got = langid.predict(odd_documents, model).collect()
    assert len(got) == odd_documents.count()
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in model.languages
    assert langid.fit(no_documents) is None and langid.predict(no_documents, None).collect() == []
    assert {r.lang_pred for r in langid.predict(odd_documents, None).collect()} == {"und"}
    kept = langid.identify(odd_documents, model)
    assert kept.columns[:-3] == odd_documents.columns


def test_counts_against_plain_loops():
    rng = random.Random(3)
    for text in ("", "a", "ab", "Déjà vu, 12!", "".join(rng.choice("abcé \n中Z9") for _ in range(500)), "x" * 70_000):
        b = (" " + text.lower() + " ").encode()
        want = Counter()
        for n in langid.GRAMS:
            for i in range(len(b) - n + 1):
                h = 0
                for c in b[i : i + n]:
                    h = (h * 0x01000193 + c + 1) % 2**32
                want[((h ^ h >> 15) * 0x85EBCA6B) % 2**32 >> 32 - 13] += 1
        got = langid.counts(text)
        assert {i: int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.random((5, 8)), rng.integers(0, 3, 5)
    m = [rng.normal(size=s) for s in ((8, 4), (4, 3), (3,))]

    def loss():
        z = x @ m[0] @ m[1] + m[2]
        return (np.log(np.exp(z).sum(1)) - z[np.arange(5), y]).mean()

    for part, g in zip(m, langid.gradients(x, y, *m), strict=True):
        for i in np.ndindex(part.shape):
            old, both = part[i], []
            for step in (1e-5, -1e-5):
                part[i] = old + step
                both.append(loss())
            part[i] = old
            assert (both[0] - both[1]) / 2e-5 == pytest.approx(g[i], abs=1e-6)


def test_calibration_against_plain_loops():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    x = np.stack([langid.counts("abc"[k] * 30 + "".join(rng.choice(list("abcdef"), 40))) for k in y])
    held = np.arange(300) % 5 == 0
    model = langid.train(x, y, ["a", "b", "c"], held)
    p = model.scores(x)
    for row, counts in zip(p[:20], x[:20], strict=True):
        z = [sum(counts[i] / counts.sum() * model.table[i, k] for i in np.flatnonzero(counts)) + model.bias[k] for k in range(3)]
        assert row == pytest.approx([math.exp(v) / sum(map(math.exp, z)) for v in z])
    # No other temperature of the grid gives the held rows a smaller loss, and few of them fall below the threshold.
    z = np.log(p[held])
    loss = lambda t: -np.mean([v[k] / t - math.log(sum(math.exp(u / t) for u in v)) for v, k in zip(z, y[held], strict=True)])
    steps = np.geomspace(0.05, 20, 60)
    assert loss(1) <= min(loss(steps[1] / steps[0]), loss(steps[0] / steps[1])) + 1e-9
    assert model.threshold <= langid.SURE and (p[held].max(1) < model.threshold).mean() <= 0.02


def test_long_training_texts_are_not_clipped(spark):
    docs = spark.createDataFrame([(i, "ab " * 80_000 if i % 2 else "xy z " * 30, "l1" if i % 2 else "l2") for i in range(12)], "doc_id long, text string, lang string")
    seen = []
    real, langid_train = langid.train, langid
    langid_train.train = lambda x, *rest: seen.append(x) or real(x, *rest)
    try:
        langid.fit(docs)
    finally:
        langid_train.train = real
    assert seen[0].max() > 65535 and max(r.sum() for r in seen[0]) == langid.counts("ab " * 80_000).sum()


def test_columns_of_any_name_stay(spark, model):
    docs = spark.createDataFrame([(1, "the of and to in is that", "u", 2.0, True, "w")], "doc_id long, text string, lang_pred string, score double, rejected boolean, __score string")
    out = langid.identify(docs, model)
    assert out.columns[:-3] == docs.columns and out.select(*docs.columns).collect() == docs.collect()


def test_no_letter():
    assert [langid.has_letter(t) for t in (None, "", "12 !", "中", "a", "é")] == [False, False, False, True, True, True]


def test_the_driver_holds_counts_without_their_zeros(spark):
    import tracemalloc
    import zlib

    rng = np.random.default_rng(4)
    languages = ["a", "b", "c"]
    y = np.arange(600) % 3
    dense = np.stack([langid.counts("abc"[k] * 20 + "".join(rng.choice(list("abcdef"), 60))) for k in y])
    held = np.arange(600) % 5 == 0
    # As the features of texts come to the driver.
    seen, real = [], langid.train
    langid.train = lambda x, *rest: seen.append(x) or real(x, *rest)
    try:
        langid.fit(spark.createDataFrame([(i, "en", "some words of text " * 3) for i in range(40)], "doc_id long, lang string, text string"))
    finally:
        langid.train = real
    assert not isinstance(seen[0], np.ndarray)
    x = type(seen[0])([zlib.compress(r.astype("<u4").tobytes(), 1) for r in dense])
    assert (np.stack(list(x)) == dense).all() and x.max() == dense.max() and type(x)([]).max() == 0
    tracemalloc.start()
    model = langid.train(x, y, languages, held)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    same = langid.train(dense, y, languages, held)
    assert (model.table == same.table).all() and (model.bias == same.bias).all() and model.threshold == same.threshold
    assert most < 600 * langid.BUCKETS * 4
