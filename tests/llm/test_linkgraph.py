"""URL parts, rules, and propagation against a dense PageRank."""
import numpy as np
import pytest
from conftest import SF_SMALL

from vacanta.llm import linkgraph as L
from vacanta.llm import queries

URLS = [(None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"), ("x://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/"),
        ("http://example.com?x=/en/", "example.com", "", None), ("http://example.com", "example.com", "", None), ("http://b.com/", "b.com", "/", "com/"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/"), ("http://a.net/en/1", "a.net", "/en/1", None), ("http://telecom/es/", "telecom", "/es/", None),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("http://a.net/fr/#x", "a.net", "/fr/", "net/fr/"), ("", "", "", None),
        ("http://ÀB.net/fr/é", "Àb.net", "/fr/é", "net/fr/"), ("a://b://c/d", "b:", "//c/d", None)]


def test_rules(spark):
    pages = spark.createDataFrame([(k, u, None, "x") for k, (u, *_) in enumerate(URLS)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in L.judge(pages, queries.URL_RULES).collect()}
    verdicts = {t: v for v, t in queries.URL_RULES}
    for k, (url, host, path, rule) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        if rule:
            assert got[k].verdict == verdicts[rule]
        elif not host:
            assert got[k].verdict == "allow"


def dense(n, edges, trusted, blocked, damping=0.85):
    def rank(pairs, seeds):
        m, v = np.zeros((n, n)), np.array(seeds, float)
        v = v / v.sum() if v.sum() else v
        for s, d, w in pairs:
            m[d, s] += w
        out = m.sum(axis=0)
        m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        x = v.copy()
        for _ in range(300):
            y = m @ x
            x = damping * y + (1 - damping * y.sum()) * v
        return x
    return rank(edges, trusted), rank([(d, s, w) for s, d, w in edges], blocked)


def test_propagation_equals_dense_pagerank(spark):
    rng = np.random.default_rng(3)
    n = 25
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 60), rng.integers(0, n, 60), rng.integers(1, 4, 60)) if a != b]
    edges += [(0, k, 1) for k in range(1, n)]  # a hub
    merged = {}
    for s, d, w in edges:
        merged[s, d] = merged.get((s, d), 0) + w
    trusted, blocked = [int(k < 4) for k in range(n)], [int(k > 20) for k in range(n)]
    hosts = spark.createDataFrame([(f"h{k}", trusted[k], blocked[k]) for k in range(n)], "host string, trusted int, blocked int")
    flow = spark.createDataFrame([(f"h{s}", f"h{d}", w) for (s, d), w in merged.items()] + [("h1", "elsewhere", 5)], "src string, dst string, n int")
    got = {r.host: (r.trust, r.distrust) for r in L.propagate(hosts, flow, tolerance=1e-10, max_rounds=120).collect()}
    t, d = dense(n, [(s, q, w) for (s, q), w in merged.items()], trusted, blocked)
    for k in range(n):
        assert abs(got[f"h{k}"][0] - t[k]) < 1e-6 and abs(got[f"h{k}"][1] - d[k]) < 1e-6


def test_distrust_reaches_who_links_to_blocked(spark):
    link = '<a href="http://{}/en/1">x</a>'
    rows = [(1, "http://bad.example.com/en/1", ""), (2, "http://friend.org/1", link.format("Bad.example.com")),
            (3, "http://good.com/1", link.format("fine.org")), (4, "http://fine.org/1", "<a href='//good.com/'>"), (5, "http://alone.org/", None),
            (5, "http://alone.org/", None)]
    got = {r.page_id: r.verdict for r in L.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_empty_and_query(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert L.judge(none, queries.URL_RULES).count() == 0
    got = queries.queries()["op7_url_verdicts"](spark, SF_SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    assert {r.verdict for r in got} <= {"allow", "block"}


def test_distrust_goes_along_a_long_chain(spark):
    """Each host links to the one before, the first is blocked: all of them are distrusted."""
    n = 10
    hosts = spark.createDataFrame([(f"h{k}", 0, int(k == 0)) for k in range(n)], "host string, trusted int, blocked int").coalesce(1)
    flow = spark.createDataFrame([(f"h{k + 1}", f"h{k}", 1) for k in range(n - 1)], "src string, dst string, n int").coalesce(1)
    got = {r.host: (r.trust, r.distrust) for r in L.propagate(hosts, flow, tolerance=1.0).collect()}
    assert all(t == 0 and d > 0 for t, d in got.values()) and len(got) == n
    with pytest.raises(RuntimeError):
        L.propagate(hosts, flow, max_rounds=3)
