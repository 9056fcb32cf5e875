import math

import pytest
from compare import compare
from pyspark.sql import functions as F

from trialspark.llm.common import REGISTRY
from trialspark.llm.reputation import LIMIT, Rule, first_paragraph, host_of, host_reputation, judge, page_outcomes, path_of, public_suffix, registered_domain

URLS = {
    "http://Blog.Example.NET/en/1?x#y": ("blog.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.net/de/1": ("example.net", "/de/1", "net/", "block"),
    "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
    "http://net": ("net", "", None, "allow"),
    "http://net?a/b": ("net", "", None, "allow"),
    "http://a.net#/x": ("a.net", "", None, "allow"),
    "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    "https://example.com/de": ("example.com", "/de", None, "allow"),
    "https://example.com.org/fr/a://b": ("example.com.org", "/fr/a://b", "org/fr/", "allow"),
    "https://example.org/frx": ("example.org", "/frx", None, "allow"),
    "ÜBER://Ünï.ORG/fr/": ("Ünï.org", "/fr/", "org/fr/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "http://u@a.net:80/": ("u@a.net:80", "/", None, "allow"),
    "x" * 100000 + "://long.net/" + "p" * 100000: ("long.net", "/" + "p" * 100000, "net/", "block"),
}


def test_query_equals_sql(spark, con, sf):
    assert compare(spark, con, REGISTRY["op12_host_reputation"], sf) == ""


def no_counts(spark):
    return spark.createDataFrame([], "host string, n long, k long")


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    out = judge(df, no_counts(spark))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "n_labelled", "n_bad", "bound"]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == URLS
    assert judge(df.limit(0), no_counts(spark)).count() == 0
    twice = df.filter("page_id = 0").union(df.filter("page_id = 0"))
    assert judge(twice, no_counts(spark)).count() == 2


def test_longest_rule_wins_and_ties_have_an_order(spark):
    df = spark.createDataFrame([(1, "http://b.a.net/xx")], "page_id long, url string")
    rules = [Rule("block", "net", "/"), Rule("allow", "a.net", "/"), Rule("block", "net", "/xx")]  # a.net/ and net/xx have six letters each
    assert judge(df, no_counts(spark), rules).first()["rule"] == "a.net/"
    assert judge(df, no_counts(spark), []).first()["rule"] is None


@pytest.mark.parametrize(
    ("host", "domain", "suffix"),
    [("a.b.com", "b.com", "com"), ("x.y.co.uk", "y.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("me@a.b.com:8080", "b.com", "com"), ("10.0.0.1:80", "10.0.0.1", ""), ("localhost", "localhost", ""), ("", "", "")],
)
def test_domains(spark, host, domain, suffix):
    row = spark.range(1).select(registered_domain(F.lit(host)).alias("d"), public_suffix(F.lit(host)).alias("s")).first()
    assert (row.d, row.s) == (domain, suffix)


def slow_bounds(counts):
    """The same shrinkage with plain loops."""

    def sums(keys):
        out = {}
        for (h, n, k), key in zip(counts, keys, strict=True):
            a, b = out.get(key, (0, 0))
            out[key] = (a + n, b + k)
        return out

    def strength(members):
        pairs = sum(n * (n - 1) * p * (1 - p) for n, _, p in members)
        if not pairs:
            return 1.0
        rho = (sum((k - n * p) ** 2 for n, k, p in members) - sum(n * p * (1 - p) for n, _, p in members)) / pairs
        return 1 / min(max(rho, 0.001), 0.999) - 1

    domain = {h: ".".join(h.split(".")[-2:]) for h, _, _ in counts}
    suffixes, domains = sums([h.split(".")[-1] for h, _, _ in counts]), sums([domain[h] for h, _, _ in counts])
    n, k = sum(c[1] for c in counts), sum(c[2] for c in counts)
    top = (k + 0.5) / (n + 1)
    s = strength([(*v, top) for v in suffixes.values()])
    p_suffix = {x: (k + s * top) / (n + s) for x, (n, k) in suffixes.items()}
    s = strength([(*v, p_suffix[x.split(".")[-1]]) for x, v in domains.items()])
    p_domain = {x: (k + s * p_suffix[x.split(".")[-1]]) / (n + s) for x, (n, k) in domains.items()}
    s = strength([(n, k, p_domain[domain[h]]) for h, n, k in counts])
    out = {}
    for h, n, k in counts:
        a, b = k + s * p_domain[domain[h]], n - k + s * (1 - p_domain[domain[h]])
        out[h] = max(0.0, a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))
    return out


def test_bounds_equal_plain_loops_and_block_bad_hosts(spark):
    counts = [(f"h{i}.d{i % 7}.{'com' if i % 3 else 'org'}", (i * 37) % 60, min((i * 37) % 60, (i * 11) % 9)) for i in range(80)]
    counts += [("bad.d1.com", 80, 70), ("few.d1.com", 1, 1), ("new.d1.com", 0, 0)]
    got = {r.host: r.bound for r in host_reputation(spark.createDataFrame(counts, "host string, n long, k long")).collect()}
    want = slow_bounds(counts)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[h], want[h], rel_tol=1e-9, abs_tol=1e-12) for h in want)
    assert got["bad.d1.com"] > LIMIT > max(got["few.d1.com"], got["new.d1.com"])
    pages = spark.createDataFrame([(1, "http://bad.d1.com/a"), (2, "http://few.d1.com/a"), (3, "http://unseen.d1.com/")], "page_id long, url string")
    verdicts = judge(pages, spark.createDataFrame(counts, "host string, n long, k long"))
    assert {r.page_id: r.verdict for r in verdicts.collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_outcomes_follow_documents_and_skip_disagreement(spark):
    docs = spark.createDataFrame([(1, "Bad & worse line\nmore"), (2, "fine line"), (3, "split line"), (4, "split line"), (5, None), (None, "fine line")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 1), (6, None)], "doc_id long, toxic int")
    html = ["<article><h1>t</h1><p><b>Bad &amp; worse line<br><p>x</p>", "<article>\n<p>fine <i>line</i></p>", "<article><p>split line</p>", "<p>fine line</p>", None, "<article><p></p>"]
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.com/", h) for i, h in enumerate(html * 2)], "page_id long, url string, html string")
    got = {r.host: (r.n, r.k) for r in page_outcomes(pages, docs, labels).collect()}
    assert got == {"h0.com": (2, 2), "h1.com": (2, 0)}
    assert page_outcomes(pages.limit(0), docs, labels).count() == 0 and page_outcomes(pages, docs, labels.limit(0)).count() == 0
    assert pages.select(first_paragraph(F.col("html")).alias("p")).first()["p"] == "Bad & worse line"
    assert spark.range(1).select(host_of(F.lit("a://B/c")).alias("h"), path_of(F.lit("a://B/c")).alias("p")).first()[:] == ("b", "/c")
