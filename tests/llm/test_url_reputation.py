import math
import re

import pytest

from presswire.llm.url_reputation import RULES, judge, located

URLS = [None, "", "no scheme", "http://", "HTTP://User@WWW.Example.COM:80/en/x?y#z", "https://example.com/en/",
        "https://www.example.com/en/a", "http://a.net/es/1", "http://net/fr/", "http://b.a.net/fr?x", "ftp://x.com",
        "http://x.com/", "http://É.example.org/a/b#c/d", "http://h?q", "http://notexample.com/en/", "x://y://z/p?",
        "http://" + "a." * 500 + "org/" + "p" * 5000]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):])[0]
    best = None
    for rule in RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path):
            if best is None or len(rule.place) > len(best.place):
                best = rule
    return host, path, best and best.place, best and best.verdict


def test_rules_on_awkward_urls(spark):
    pages = spark.createDataFrame([(i if i else None, u, "h", "x") for i, u in enumerate(URLS)] + [(1, "", "h", "x")],
                                  "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = judge(pages, none).collect()
    assert len(rows) == len(URLS) + 1
    for row in rows:
        host, path, rule, verdict = brute(URLS[row.page_id or 0])
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict or "allow")
    assert judge(pages.limit(0), none).count() == 0


def strength(children):
    n, bad = sum(c[0] for c in children), sum(c[1] for c in children)
    p, k = bad / n, len(children)
    room = n - sum(c[0] ** 2 for c in children) / n - (k - 1)
    share = 0.1
    if room > 0 and 0 < p < 1:
        share = ((sum(c[1] ** 2 / c[0] for c in children) - bad * bad / n) / (p * (1 - p)) - (k - 1)) / room
    share = min(0.9, max(0.001, share))
    return n, bad, 1 / share - 1


def test_posterior_bounds(spark):
    hosts = {"bad.one.org": (40, 38), "good.one.org": (40, 0), "new.one.org": (1, 1), "a.two.org": (30, 30),
             "b.two.org": (20, 19), "c.three.fr": (10, 1)}
    pages, outcomes, i = [], [], 0
    for host, (n, bad) in hosts.items():
        for k in range(n):
            pages.append((i, f"http://{host}/p{k}"))
            outcomes.append((i, int(k < bad)))
            i += 1
    pages += [(i, "http://unseen.two.org/"), (i + 1, "http://unseen.four.org/"), (i + 2, "http://q.zz/")]
    outcomes += [(0, None)]
    rows = judge(spark.createDataFrame(pages, "page_id long, url string"),
                 spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    got = {r.host: r for r in rows}
    domains = {}
    for host, c in hosts.items():
        domains.setdefault(host.split(".", 1)[1], []).append(c)
    d = {k: strength(v) for k, v in domains.items()}
    suffixes = {}
    for k, v in d.items():
        suffixes.setdefault(k.split(".")[1], []).append(v[:2])
    s = {k: strength(v) for k, v in suffixes.items()}
    w = strength([v[:2] for v in s.values()])
    mean_w = (w[1] + 1) / (w[0] + 2)
    mean_s = {k: (v[1] + w[2] * mean_w) / (v[0] + w[2]) for k, v in s.items()}
    mean_d = {k: (v[1] + s[k.split(".")[1]][2] * mean_s[k.split(".")[1]]) / (v[0] + s[k.split(".")[1]][2])
              for k, v in d.items()}

    def bound(m, n):
        return m - 1.645 * math.sqrt(m * (1 - m) / (n + 1))

    for host, (n, bad) in hosts.items():
        up = d[host.split(".", 1)[1]][2]
        m = (bad + up * mean_d[host.split(".", 1)[1]]) / (n + up)
        assert got[host].bad_bound == pytest.approx(bound(m, n + up))
    assert got["unseen.two.org"].bad_bound == pytest.approx(bound(mean_d["two.org"], d["two.org"][2]))
    assert got["unseen.four.org"].bad_bound == pytest.approx(bound(mean_s["org"], s["org"][2]))
    assert got["q.zz"].bad_bound == pytest.approx(bound(mean_w, w[2]))
    assert (got["bad.one.org"].verdict, got["good.one.org"].verdict) == ("block", "allow")
    assert got["unseen.two.org"].verdict == "block"


def test_no_pages_split_of_hosts(spark):
    pages = spark.createDataFrame([(1, "http://u:p@a.b.example.org:8080/x")], "page_id long, url string")
    row = located(pages).first()
    assert (row.domain, row.suffix) == ("example.org", "org")


def test_wide_suffixes_and_addresses(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.x.com.au:80": ("x.com.au", "com.au"),
             "uk": ("uk", "uk"), "10.0.0.1:8080": ("10.0.0.1", ""), "u@10.0.0.2": ("10.0.0.2", ""), "1.2.3": ("2.3", "3"),
             "notco.uk": ("notco.uk", "uk"), "[::1]:80": ("[::1]", "")}
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.page_id: (r.domain, r.suffix) for r in located(pages).collect()}
    assert [got[i] for i in range(len(hosts))] == list(hosts.values())


def test_a_page_given_three_times_counts_three_times(spark):
    pages = [(1, "http://a.org/x")] * 3 + [(2, "http://b.org/y"), (3, "http://c.org/z"), (None, "http://a.org/q")]
    outcomes = [(1, 1)] * 3 + [(2, 0), (3, None)]
    place = spark.createDataFrame(pages, "page_id long, url string")
    once = spark.createDataFrame(outcomes, "page_id long, bad int")
    got = {r.host: r.bad_bound for r in judge(place, once).collect()}
    apart = [(i, u) for i, (_, u) in enumerate(pages)]
    alone = spark.createDataFrame(apart, "page_id long, url string")
    each = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0)], "page_id long, bad int")
    assert got == {r.host: r.bad_bound for r in judge(alone, each).collect()}
    assert len(judge(place, once).collect()) == len(pages)
