import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import pii

SF = "/root/testdata/sf0.01"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base(text):
    out = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m.group())]
    return sorted(out)


def written(spans):
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], "doc_id long, text string, start int, kind string, base int")


def check(rows, got):
    assert Counter((str(r.doc_id), str([tuple(s) for s in r.base])) for r in got) == Counter((str(i), str(base(t))) for i, t in rows)
    for r in got:
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = pii.op10_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        n = Counter(k for _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n[0], n[1], n[2], n[3])
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert set(filter(None, written(spans).split(","))) <= set(filter(None, r.spans.split(",")))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("012345 .-+@()a%_\né\U0001f600")), max_size=60), min_size=1, max_size=120))
def test_base_spans_against_brute_force(spark, texts):
    rows = list(enumerate(texts))
    check(rows, pii.mentions(frame(spark, rows)).selectExpr("doc_id", "transform(base, x -> struct(x.start, x.kind, x.end)) as base", "transform(base, x -> struct(x.start, x.kind, x.end)) as spans").collect())


def test_odd_documents(spark, odd_documents, no_documents):
    long = "1 " * 20_000 + "a" * 200_000 + "@" + "b." * 20_000 + "c " + "4111 1111 1111 1111 " + "9" * 50_000
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (3, "a@b.c+d@e.f 1.2.3.4.5.6.7.8"), (3, "a@b.c+d@e.f 1.2.3.4.5.6.7.8"), (4, long), (5, "4111-1111-1111-1111 +1 (555) 010-2030 256.1.1.1 001.2.3.255"), (6, "\U0001f600 x@y.z")]
    check(rows, pii.find_pii(frame(spark, rows)).collect())
    check([(d.doc_id, d.text) for d in odd_documents.collect()], pii.find_pii(odd_documents).collect())
    assert pii.find_pii(no_documents).collect() == []


def test_patterns_discover_what_the_base_misses(spark):
    """After 'my card number' stand good cards in many documents, so a number there that fails Luhn is one too."""
    good = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "4012888888881881"]
    rows = [(i, f"w{i} said my card number {c} is, v{i} and more") for i, c in enumerate(good * 2)]
    rows += [(100, "hm said my card number 4111111111111112, ok"), (101, "the serial of it 4111111111111112 here"), (102, "my card number twelve")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    text = dict(rows)[100]
    at = text.index("4111")
    assert got[100] == [(at, 2, at + 16)] and got[101] == [] and got[102] == [] and all(len(got[i]) == 1 for i in range(10))


def test_redact(spark, no_documents):
    rows = [(1, "write to a@b.cd, or +1 (555) 010-2030."), (2, None), (3, "nothing"), (None, "\U0001f600 at 1.2.3.4"), (4, "nothing")]
    df = frame(spark, rows)
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("1", "write to [EMAIL], or [PHONE]."), ("2", "None"), ("3", "nothing"), ("4", "nothing"), ("None", "\U0001f600 at [IP]")]
    assert pii.redact(no_documents).columns == no_documents.columns


def test_discovery_takes_runs_hops_and_rounds(spark):
    good = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "4012888888881881"]
    bad = [f"41111111111{i:02}112" for i in range(20)]
    bad = [b for b in bad if not luhn(b)][:10]
    # Two thirds of the identifiers fail Luhn, so two rounds do not reach the confidence.
    rows = [(i, f"w{chr(97 + i)} said my card number {c} is, vv and more") for i, c in enumerate(good + bad)]
    rows += [(100, "hm said my card number 4111 1111 1111 1112, ok")]
    # Instances of the first pattern support a second one that no base seed has.
    rows += [(200 + i, f"we then charged plastic {c} twice") for i, c in enumerate(bad[:4])] + [(300, "they charged plastic 4222222222222222 now")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    text = dict(rows)
    at = text[100].index("4111")
    assert got[100] == [(at, 2, at + 19)]
    assert all(len(got[i]) == 1 for i in range(15)) and not luhn("4222222222222222")
    at = text[300].index("4222")
    assert got[300] == [(at, 2, at + 16)]


def test_scores_against_plain_python(spark):
    """Patterns and instances of a random graph: the same confidences as plain loops over it give."""
    import random

    rng = random.Random(12)
    good = [f"4111{i:012}" for i in range(60)]
    seeds = {c for c in good if rng.random() < 0.6}
    edges = {(f"p{rng.randrange(12)}", c) for c in good for _ in range(3)} | {("p1", "a word1"), ("p2", "a word1")}
    df = spark.createDataFrame([(p, c, 2 if c in seeds else None) for p, c in edges], "pattern string, instance string, seed int")
    got, instances = pii.scores(df)
    held, before = {c: 1.0 for c in seeds}, None
    while True:
        patterns = {}
        for p in sorted({p for p, _ in edges}):
            mine = [c for q, c in edges if q == p]
            if sum(held.get(c, 0) >= pii.CONFIDENT for c in mine) >= pii.SUPPORT:
                patterns[p] = min(1.0, sum(held.get(c, 0) for c in mine) / (len(mine) + 1))
        now = (len(patterns), sum(patterns.values()))
        if before and now[0] == before[0] and now[1] - before[1] < pii.SETTLED or not patterns:
            break
        before, held = now, {c: 1.0 for c in seeds}
        for c in set(good) - seeds:
            miss = 1.0
            for p, d in edges:
                if d == c and p in patterns:
                    miss *= 1 - min(patterns[p], 0.999)
            if any(d == c and p in patterns for p, d in edges):
                held[c] = 1 - miss
    assert {r.pattern: r.score for r in got.collect()} == pytest.approx(patterns) and len(patterns) > 5
    assert {r.instance: r.score for r in instances.collect()} == pytest.approx(held)


def test_secrets(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'then token = "{key}"### and on'), (2, f"api_key: {key[:24]}, so"), (3, f"a digest {key} of no one"), (4, "token = short1 and password = alllettersbutnodigitshere"), (5, f"PASSWORD='{key}x'")]
    rows += [(10 + i, f"set the deploy value to {key[:30]}{i:03}z now, token = {key[:30]}{i:03}z") for i in range(6)]
    rows += [(30, f"set the deploy value to {key[::-1]} now")]  # only its context gives it away
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    cut = {i: [dict(rows)[i][a:b] for a, k, b in got[i] if k == pii.SECRET] for i in got}
    assert cut[1] == [key] and cut[2] == [key[:24]] and cut[3] == [] and cut[4] == [] and cut[5] == [key + "x"]
    assert cut[30] == [key[::-1]] and all(len(cut[10 + i]) == 2 for i in range(6))
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert out[1] == 'then token = "[SECRET]"### and on'


def test_very_many_matches_in_one_text(spark):
    """A log file in one row: positions are exact, and work grows in proportion to the matches."""
    import time

    lines = [f"{i} user{i}@host{i % 97}.example from 10.{i % 256}.{i // 256 % 256}.7 ref A{i:09}" for i in range(50_000)]
    text, began = "\n".join(lines), time.perf_counter()
    df = frame(spark, [(1, text)])
    got = pii.mentions(df).selectExpr("transform(base, x -> struct(x.start, x.kind, x.end)) as base", "size(other) as others").collect()[0]
    assert [tuple(x) for x in got.base] == base(text) and len(got.base) == 100_000 and got.others == 100_000
    assert time.perf_counter() - began < 60
    spans = [tuple(x) for x in got.base]
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out.append(text[at:a] + f"[{RULES[k][0].upper()}]")
        at = max(at, b)
    rows = pii.redact(df).collect()
    assert rows[0].text == "".join(out) + text[at:]


def test_running_values(spark):
    import random

    rng = random.Random(1)
    for n in (0, 1, pii.STRETCH - 1, pii.STRETCH, pii.STRETCH + 1, 3 * pii.STRETCH + 5):
        values = [rng.randrange(100) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, most = df.select(pii._before(pii.F.col("v"), lambda a, b: a + b), pii._before(pii.F.col("v"), lambda a, b: pii.F.greatest(a, b))).first()
        assert sums == [sum(values[:i]) for i in range(n + 1)] and most == [max([0, *values[:i]]) for i in range(n + 1)]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "to a@b.cd", "s", "k", 3)], "doc_id long, text string, spans string, k_id string, k_hash int")
    assert pii.redact(df).collect() == [(1, "to [EMAIL]", "s", "k", 3)]
