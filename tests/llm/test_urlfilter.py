import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import urlfilter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    rule = next(h + p for v, h, p in rules if h == best[1] and len(h + p) == best[0] and path.startswith(p))
    return host, path, rule, best[2]


URLS = [None, "", "no scheme", "http://", "https://Example.ORG/en/1?x", "http://a.b.example.org/en/12#y", "x://y://org/", "http://org", "http://org/", "http://notexample.org/es/", "http://a..org//", "http://com/de/", "https://m.x.com/fr/1", "http://x.net/de/", "http://\u00c4.com/de/\n?q", "http://" + "a." * 3000 + "org/" + "p/" * 3000, "http://com/de/", "http://com/de/"]


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h", "r", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, digest string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, urlfilter.rules_frame(spark, rules)).collect()}


@pytest.mark.parametrize("bound", [50_000, 1])
def test_cases(spark, monkeypatch, bound):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", bound)
    assert run(spark, URLS, urlfilter.RULES) == {i: brute(u, urlfilter.RULES) for i, u in enumerate(URLS)}


def test_empty(spark):
    assert run(spark, [], urlfilter.RULES) == {}
    assert run(spark, ["http://a.org/"], [])[0] == ("a.org", "/", None, "allow")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=4), st.lists(st.sampled_from(["x", "y", "/"]), max_size=5)), min_size=1, max_size=60), st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from(["a", "a.b", "b", "c.a", "b.c.a"]), st.sampled_from(["", "/", "/x", "/x/y", "/y/"])), max_size=8, unique_by=lambda r: r[1:]))
def test_against_brute_force(spark, urls, rules):
    urls = ["http://" + ".".join(h) + "/" + "".join(p) for h, p in urls]
    assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}
