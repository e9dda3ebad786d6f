import random

import oracle
import pytest

from weftline.functions.normalize import COUNTRY_ALIASES
from weftline.operators import link, merge
from weftline.operators.components import connected_components
from weftline.schemas import RAW_PROFILE


def country(raw):
    s = raw.strip()
    for code, names in COUNTRY_ALIASES.items():
        if s.lower() in names:
            return code
    return s.upper() if len(s) == 2 and s.isascii() and s.isalpha() else None


def record(rng, i):
    blank = lambda *xs: rng.choice([*xs, None, "", "  "])
    return {
        "ordinal": i,
        "full_name": blank("Ann Lee", "ann lee ", "A. Lee", "Bob"),
        "emails": [rng.choice([f"E{rng.randrange(40)}@x.com ", f"e{rng.randrange(40)}@x.com", " ", None]) for _ in range(rng.randrange(3))],
        "phones": [rng.choice([f"(555) 000-00{rng.randrange(10, 40)}", f"+1555000{rng.randrange(10, 40):04d}", "12", None]) for _ in range(rng.randrange(2))],
        "location": {"city": blank("Rome", "rome", "Bonn"), "region": blank("R"), "country": blank("italy", "de", "Atlantis", "atlantis")},
        "links": {"linkedin": blank("l1", "L1", "l2"), "github": blank("g"), "portfolio": None, "other": [rng.choice(["o1", "o2 ", "o1", ""]) for _ in range(rng.randrange(4))]},
        "skills": [rng.choice(["Python", "python ", "Go", "", "R"]) for _ in range(rng.randrange(4))],
        "experience": [{"company": blank("Acme", "ACME", "Beta"), "title": blank("Dev", "dev"), "start": blank("Oct 2020", "2020/13", "2019"), "end": blank("now", "2021-02"), "summary": blank("s")} for _ in range(rng.randrange(3))],
        "education": [{"institution": blank("Uni", "uni", "Tech"), "degree": blank("BSc"), "field_of_study": None, "start": blank("2015"), "end": blank("later")} for _ in range(rng.randrange(3))],
        "_source_id": f"s{rng.randrange(3) if i % 7 == 0 else i}",
        "_source_type": rng.choice(["ats", "recruiter_notes", "other", None]),
    }


def plain(x):
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    return [plain(v) for v in x] if isinstance(x, list) else x


@pytest.fixture(scope="module")
def records():
    rng = random.Random(4)
    return [record(rng, i) for i in range(150)]


@pytest.fixture(scope="module")
def frame(spark, records):
    return spark.createDataFrame(records, RAW_PROFILE)


def test_greedy_linkage(frame, records):
    got = {r.ordinal: r.cluster_id for r in link.link(frame).collect()}
    want = {p["ordinal"]: c[0]["ordinal"] for c in oracle.greedy(records) for p in c}
    assert got == want and max(map(len, oracle.greedy(records))) >= 5


@pytest.mark.parametrize("seed, replayed, span", [(0, 10_000, 100_000), (1, 10_000, 100_000), (2, 0, 7), (3, 0, 1), (4, 0, 100_000)])
def test_greedy_linkage_of_bridges(spark, monkeypatch, seed, replayed, span):
    """Few keys, so that later records often bridge clusters; by replay and by rounds, with split keys."""
    monkeypatch.setattr(link, "REPLAYED", replayed)
    monkeypatch.setattr(link, "SPAN", span)
    rng = random.Random(seed)
    rows = [{**record(rng, i), "emails": [f"e{rng.randrange(12)}@x" for _ in range(rng.randrange(3))], "phones": [f"+1000000{rng.randrange(6)}"] * rng.randrange(2)} for i in range(60)]
    frame = spark.createDataFrame(rows, RAW_PROFILE)
    assert {r.ordinal: r.cluster_id for r in link.link(frame).collect()} == {p["ordinal"]: c[0]["ordinal"] for c in oracle.greedy(rows) for p in c}


def test_order_decides_greedy_clusters(spark):
    def clusters(order, linkage="greedy"):
        keys = {"A": (["a@x"], []), "B": ([], ["+15550001111"]), "C": (["a@x"], ["+15550001111"])}
        rows = [{**record(random.Random(1), i), "emails": keys[n][0], "phones": keys[n][1]} for i, n in enumerate(order)]
        out = {}
        for r in link.link(spark.createDataFrame(rows, RAW_PROFILE), linkage).collect():
            out.setdefault(r.cluster_id, set()).add(order[r.ordinal])
        return sorted(map(sorted, out.values()))

    assert clusters("ABC") == [["A", "C"], ["B"]]
    assert clusters("ACB") == clusters("ABC", "transitive") == [["A", "B", "C"]]


def test_merge(frame, records):
    got = {r.cluster_id: r for r in merge.consolidate(frame).collect()}
    clusters = oracle.greedy(records)
    assert len(got) == len(clusters)
    for rows in clusters:
        want, have = oracle.merge(rows, country), got[rows[0]["ordinal"]]
        if want["candidate_id"] is None:
            want["candidate_id"] = have.candidate_id
            assert len(have.candidate_id) == 17 and have.candidate_id.startswith("cand-")
        for name, value in want.items():
            assert plain(have[name]) == value, (name, rows[0]["ordinal"])


def test_empty(spark):
    none = spark.createDataFrame([], RAW_PROFILE)
    assert merge.consolidate(none).collect() == [] and link.link(none).collect() == []


def test_unknown_linkage(frame):
    with pytest.raises(ValueError, match="linkage"):
        link.link(frame, "other")


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200) if i % 40 != 39] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}


def test_resolve_scalar(spark):
    from pyspark.sql import functions as F

    rows = [(None, 0.0, "x", 0.5), ("a", 0.5, " ", 0.9), ("a", 0.5, "A", 0.9), ("a", 0.5, "b ", 0.9), ("a", 0.9, "b", 0.9)]
    df = spark.createDataFrame(rows, "c string, cw double, i string, iw double")
    out = df.select(*[c.alias(k) for k, c in merge.resolve_scalar(F.col("c"), F.col("cw"), F.col("i"), F.col("iw")).items()]).collect()
    assert [tuple(r) for r in out] == [("x", 0.5, "initial_write", "x"), ("a", 0.5, None, None), ("a", 0.5, None, None), ("b", 0.9, "confidence_override", "b"), ("a", 0.9, "confidence_held", "a")]


def test_upserts_equal_one_run(spark, tmp_path):
    """Batches in any order of ordinals, one of them replayed, give the entities of one run over all records."""
    from weftline.streaming import upsert

    rng = random.Random(9)
    rows = [{**record(rng, i), "emails": [f"e{rng.randrange(60)}@x" for _ in range(rng.randrange(1, 3))]} for i in range(60)]
    everything = spark.createDataFrame(rows, RAW_PROFILE)
    order = [2, 0, 3, 1]
    for n in order:
        spark.createDataFrame(rows[n * 15 : n * 15 + 15], RAW_PROFILE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    query = upsert.upsert_entities(stream, store).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()

    def state(frame):
        return {r.cluster_id: plain(r) for r in frame.select(*sorted(frame.columns)).collect()}

    want = state(merge.consolidate(everything))
    assert state(upsert.latest_entities(spark, store)) == want and len(want) < 60
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "store" / "profiles").glob("batch=*"))
    assert last >= 3
    again = spark.read.parquet(str(next(iter(sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime, reverse=True)))))
    upsert._add(again, last, store, "greedy")
    assert state(upsert.latest_entities(spark, store)) == want
