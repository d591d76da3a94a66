"""op1: hosts, rules, domains and reputation on odd rows, against plain Python."""

import pytest
from pyspark.sql import functions as F

from cadenza.llm import op1_urls as op1

PAGES = "page_id long, url string, host string, n long"


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def rule(host, path):
    fits = [r for _, r in op1.RULES if (host == (top := r.partition("/")[0]) or host.endswith("." + top)) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en/", "http://example.com/en", "http://aexample.com/en/", "https://a.net/es/x", "https://net/fr/",
    "http://com", "http://x.com?q=/en/", "http://x.org#f", "a://b://c.com/", "http://u:p@www.example.com:8080/en/", "http://10.0.0.1/x", "http://ÉCOLE.fr/é", "http://a\nb.net/fr/", "http://" + "x" * 50_000 + ".com/" + "y" * 50_000,
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(None, "http://x.net/es/", None, None), (0, None, None, None)]
    got = op1.judge_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame([], "page_id long, bad int")).collect()
    want = []
    for i, u, *_ in rows:
        host, path = host_and_path(u)
        r = rule(host, path)
        want.append((i, host, path, r, {x: v for v, x in op1.RULES}.get(r, "allow")))
    assert sorted(map(str, [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize("host,domain,suffix", [
    ("www.example.com", "example.com", "com"), ("u@www.example.com:8080", "example.com", "com"), ("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("localhost:80", "localhost", "localhost"),
    ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("10.0.0.1:81", "10.0.0.1", "10.0.0.1"), ("[::1]:80", "[::1]", "[::1]"), ("example.com.", "example.com", "com"), ("", "", ""),
])
def test_domains(spark, host, domain, suffix):
    r = spark.createDataFrame([(host,)], "h string").select(op1.domain_of(F.col("h")), op1.suffix_of(F.col("h"))).first()
    assert tuple(r) == (domain, suffix)


def test_a_suffix_table_replaces_the_default(spark):
    table = spark.createDataFrame([("github.io",), ("io",), ("github.io",)], "suffix string")
    assert op1.listed(table) == ("github.io",)
    assert op1.listed(None) == op1.LONG_SUFFIXES


def test_bad_hosts_are_blocked_and_their_siblings_lean_on_the_domain(spark):
    pages = [(i, f"http://h{i % 4}.bad.org/{i}", None, None) for i in range(200)] + [(1000 + i, f"http://h{i % 40}.good{i % 7}.org/", None, None) for i in range(200)]
    pages += [(5000, "http://new.bad.org/", None, None), (5001, "http://new.good1.org/", None, None), (5002, "http://h1.bad.org/", None, None)]
    outcomes = [(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(200)] + [(None, 1), (1, None)]
    got = {r["page_id"]: r for r in op1.judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert all(got[i]["verdict"] == got[i]["reputation"] == "block" for i in range(200)) and got[5002]["verdict"] == "block"
    assert all(got[1000 + i]["verdict"] == "allow" for i in range(200)) and got[5001]["verdict"] == "allow"
    hosts = spark.createDataFrame([("h.bad.org", 50, 50), ("new.bad.org", 0, 0), ("new.other.org", 0, 0), ("x.other.org", 50, 0)], "host string, n long, bad long")
    mean = {r["host"]: r["a"] / (r["a"] + r["b"]) for r in op1.host_reputation(hosts).collect()}
    assert mean["h.bad.org"] > mean["new.bad.org"] > mean["new.other.org"] > mean["x.other.org"]


def test_empty(spark):
    none = spark.createDataFrame([], PAGES)
    assert op1.judge_urls(none, spark.createDataFrame([], "page_id long, bad int")).count() == 0
