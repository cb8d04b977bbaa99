"""URL rules against a plain reading of them."""

import time

from spendgrid.llm.q_mix import URL_RULES
from spendgrid.llm.url_filter import build_filter, judge_pages

URLS = [
    "http://example.com/en/1", "https://www.example.com/en/", "https://WWW.Example.COM/en/x?y#z", "http://a.example.com/en", "http://com/", "http://com",
    "http://x.net/es/1", "http://x.net/fr/", "http://net/fr/?q", "http://x.net/de/", "http://net.org/fr/", "http://xcom/", "http://example.com",
    "http://example.com?en/", "http://example.com#/en/", "http://b.www.example.com/en/q", "ftp://u@h.com:80/p", "no scheme", "", None, "://com/", "http:///en/",
    "a://b.com/://c.net/fr/", "http://É.com/", "http://example.com/EN/1", "http://x.com/" + "p" * 100_000, "x\ny://z.com/a\nb",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "k", "r", "v") for i, u in rows], "page_id bigint, url string, key string, rule string, verdict string")


def judged(spark, rows):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_pages(pages(spark, rows), rules).collect()), key=str)


def test_matches_plain_reading(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (0, URLS[6]), (None, URLS[6])]
    assert judged(spark, rows) == sorted(((i, *brute(u)) for i, u in rows), key=str)


def test_empty_pages_and_rules(spark):
    assert judged(spark, []) == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = judge_pages(pages(spark, [(1, URLS[0])]), none).first()
    assert (got.rule, got.verdict) == (None, "allow")


def test_full_filter_only_passes_more(spark):
    rules = spark.createDataFrame(URL_RULES + [(f"h{i}.org", "/", "block") for i in range(500)], "host string, path string, verdict string")
    p = pages(spark, list(enumerate(URLS + ["http://a.h7.org/x", "http://h8.org"])))
    small = build_filter(rules.selectExpr("concat_ws(' ', host, path) AS key"), max_bytes=64)
    assert len(small) == 8
    got = {r.page_id: r.rule for r in judge_pages(p, rules).collect()}
    assert got[len(URLS)] == "h7.org/" and got[len(URLS) + 1] is None and got[0] == "example.com/en/"


def test_hosts_of_any_length_and_rules_of_any_depth(spark):
    """A host of 100,000 dots is probed as often as the list has label counts, not once per label."""
    long = "a." * 100_000 + "x.net"
    rules = spark.createDataFrame([("net", "/es/", "block"), ("b.c.d.e.com", "/", "block"), ("x.", "/", "block")], "host string, path string, verdict string")
    urls = [f"http://{long}/es/1", f"http://{long}/", "http://d.e.com/", "http://z.b.c.d.e.com/", "http://x./", "http://.x./", "http://b.c.d.e.com", "http://...net/es/"]
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in judge_pages(pages(spark, list(enumerate(urls))), rules).collect()}
    assert time.time() - start < 20
    assert [got[i][0] for i in range(len(urls))] == ["net/es/", None, None, "b.c.d.e.com/", "x./", "x./", None, "net/es/"]
    assert got[0] == ("net/es/", "block", len(long)) and got[2][1] == "allow"
