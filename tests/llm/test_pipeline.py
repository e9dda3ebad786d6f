"""The pipeline against a brute-force version: plain Python for every stage but the learned one, whose model is shared."""

import re
import zlib
from collections import Counter

import pytest
from test_pii import RULES, base
from test_simhash import brute_components, brute_print

import corpus_pipeline
from weftline.llm import langid
from weftline.llm.tokens import ChunkEncoder, default_path

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (text or "").split()) if w]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        out[name] = docs
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [df.columns == columns for df in stages.values()] == [True] * 4 + [False]


def test_language_id(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, every = langid.fit(docs), texts(docs)
    rejected = {i for i, (_, _, no) in zip(every, langid.predict_texts(model, list(every.values())), strict=True) if no}
    assert set(texts(stages["language_id"])) == set(every) - rejected and len(rejected) < 0.05 * len(every)


def test_near_duplicates(stages):
    before = texts(stages["language_id"])
    prints = {i: brute_print(t) for i, t in before.items()}
    component, least = brute_components(prints.values()), {}
    for i in sorted(before):
        least.setdefault(component[prints[i]], i)
    assert texts(stages["near_duplicates"]) == {i: before[i] for i in least.values()} and len(least) < len(before)


def test_decontamination(spark, stages):
    before, bad = texts(stages["near_duplicates"]), set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for i, t in before.items():
            v = words(t)
            mine = {tuple(v[j : j + 5]) for j in range(len(v) - 4)}
            if windows and sum(x in mine for x in windows) >= 0.8 * len(windows):
                bad.add(i)
    assert texts(stages["decontamination"]) == {i: t for i, t in before.items() if i not in bad} and bad


def secrets(text):
    """Long words of letters and digits after a credential's name, found in plain Python."""
    for m in re.finditer(r"(?:token|secret|password|api_key)\s*[:=]\s*[\"']?([A-Za-z0-9]{20,})", text or "", re.I):
        if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
            yield m.start(1), 4, m.end(1)


def test_personal_data(stages):
    before, after = texts(stages["decontamination"]), texts(stages["personal_data"])
    assert set(before) == set(after)
    masked = 0
    for i, text in before.items():
        out, at = "", 0
        for a, k, b in sorted([*base(text), *secrets(text)]):
            if a >= at:
                out += text[at:a] + f"[{[*(r[0] for r in RULES), 'secret'][k].upper()}]"
            at = max(at, b)
        assert after[i] == out + text[at:]
        masked += after[i] != text
    assert masked


def test_packing(stages):
    tok, want = ChunkEncoder(default_path()), Counter()
    for i, t in texts(stages["personal_data"]).items():
        ids = tok.encode([t])[0] + b"\0\0\0\0"
        for start in range(0, len(ids) // 4, 1024):
            want[i, start, zlib.crc32(ids[4 * start : 4 * (start + 1024)])] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in stages["packing"].collect()) == want


def test_run_and_odd_documents(spark, odd_documents, no_documents, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"].count()
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
    assert docs.count() == 0


def test_only_members_of_a_group_remove_one_another(spark):
    """Null and repeated doc_ids on unrelated texts, against plain Python over fingerprints."""
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omikron pi rho sigma tau ypsilon".split()
    unrelated = [" ".join(names[(i * 7 + j * (i + 1)) % 20] for j in range(12)) for i in range(9)]
    ids = [None, None, None, 7, 7, 7, 7, 2, 1]
    rows = list(zip(ids, unrelated)) + [(None, unrelated[3]), (9, unrelated[0]), (5, unrelated[4]), (None, unrelated[1]), (7, unrelated[5]), (8, unrelated[8])]
    rows = [(i, t, f"s{n}", n, n / 2, f"u{n}", n) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, __n int, __score double, row string, component int")
    component = brute_components([brute_print(t) for t in unrelated])
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(component[brute_print(t)], set()).add((i is None, i or 0, t))
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == len(groups) > 7
    assert {component[brute_print(r.text)] for r in got} == set(groups)
    for r in got:
        least = min(x[:2] for x in groups[component[brute_print(r.text)]])
        assert (r.doc_id is None, r.doc_id or 0) == least
        assert tuple(r) in rows


def test_columns_of_any_name_survive_every_stage(spark):
    rows = [(1, "the of and to in is that write to a@b.cd please", "x", 1, 0.5, True), (2, "the of and to in is that other words", "y", 2, 1.5, False)]
    docs = spark.createDataFrame([(*r, "en", "s", 9) for r in rows], "doc_id long, text string, spans string, __n int, __score double, __rejected boolean, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
    assert sorted((r.doc_id, r.spans, r["__n"], r["__score"]) for r in docs.collect()) == [(1, "x", 1, 0.5), (2, "y", 2, 1.5)]


def test_one_document_of_each_group(spark):
    rows = [(5, "same text as the other"), (3, "same text as the other"), (3, "same text as the other"), (None, "same text as the other"), (None, "lonely words over here now"), (None, "lonely words over here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("3", "same text as the other"), ("None", "lonely words over here now")]
