import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import empty

from presswire.llm import language_id as G
from presswire.llm.queries import QUERIES


def test_pages_of_known_language(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = QUERIES["op8_language_id"](spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    right = [r.lang == langs[int(re.search(r"/[a-z]+/([0-9]+)", pages[r.page_id].url)[1])] for r in rows]
    assert np.mean(right) >= 0.95


def documents_of(spark):
    return spark.createDataFrame(
        [(1, "the cat and the dog with the thing " * 20, "en"), (2, "der hund und die katze mit dem ding " * 20, "de"),
         (3, None, "en"), (4, "text ohne sprache", None)], "doc_id long, text string, lang string")


def test_evidence_beyond_text(spark):
    pages = [(i, f"http://a.example.de/{i}", "<html lang='de'><p>der hund und die katze mit dem ding</p></html>") for i in range(20)]
    pages += [(50, "http://a.example.de/x", "<html lang=\"de\"><p></p></html>"), (51, None, None), (52, "bad", ""),
              (53, "http://b.example.com/", "<html lang=en><script>der die und</script>the cat and the dog</html>"),
              (54, "http://b.example.com/", "<html lang=en>the dog with the thing"), (None, "http://a.example.de/1", "x" * 100_000)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in G.identify(table, documents_of(spark)).collect()}
    assert len(got) == len(pages)
    assert got[50].lang == "de" and got[50].declared == "de"  # no text: host, suffix and markup decide
    assert got[53].lang == "en" and got[54].lang == "en" and got[3].lang == "de"
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.confidence == max(r.posterior) for r in got.values())


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id long, url string, html string")
    assert [r.lang for r in G.identify(pages, empty(spark)).collect()] == [None]
    assert G.identify(pages.limit(0), documents_of(spark)).count() == 0


def fused_by_hand(pages, docs, temper=0.25, strength=5.0):
    """The posterior of every page by plain loops."""
    langs = sorted({lang for _, lang in docs if lang is not None})
    counts = {lang: Counter() for lang in langs}
    for text, lang in docs:
        if lang is not None:
            counts[lang].update(G.slots((text or "").encode()).tolist())
    totals = {lang: sum(counts[lang].values()) + 0.5 * G.SLOTS for lang in langs}

    def normal(logs):
        raw = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(raw) for x in raw]

    facts = []
    for url, html in pages:
        host = url.split("://")[1].split("/")[0]
        found = Counter(G.slots(G.visible(html.encode())).tolist())
        logs = [temper * sum(k * math.log((counts[lang][s] + 0.5) / totals[lang]) for s, k in found.items()) for lang in langs]
        declared = re.search("<html lang=([a-z]+)", html)
        facts.append((host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared[1] if declared else "", logs, normal(logs)))

    def sums(at, i):
        out = Counter()
        for f in facts:
            out[f[at]] += f[5][i]
        return out

    n = len(langs)
    hosts, domains, suffixes, said = ([sums(at, i) for i in range(n)] for at in (0, 1, 2, 3))
    everything = [sum(f[5][i] for f in facts) for i in range(n)]
    out = []
    for host, domain, suffix, declared, logs, own in facts:
        weights = []
        for i in range(n):
            top = (everything[i] + 1) / (sum(everything) + n)
            near = (max(domains[i][domain] - own[i], 0) + strength * top) / (sum(d[domain] for d in domains) - 1 + strength)
            at_host = (max(hosts[i][host] - own[i], 0) + strength * near) / (sum(h[host] for h in hosts) - 1 + strength)
            room = everything[i] - own[i] + 1
            says = (max(said[i][declared] - own[i], 0) + (0.5 if declared == langs[i] else 0.05)) / room
            ends = (max(suffixes[i][suffix] - own[i], 0) + 0.1) / room
            weights.append(logs[i] + math.log(at_host) + math.log(says) + math.log(ends))
        out.append(normal(weights))
    return langs, out


def many_languages(n):
    rng = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(" ".join("".join(rng.choices(letters, k=3)) for _ in range(8)), f"l{i:03d}") for i in range(n)]
    docs += [(None, "l000"), ("no language", None)]
    pages = []
    for i in range(40):
        lang = rng.randrange(n)
        words = docs[lang][0] if i % 4 else ""
        tag = f"<html lang=l{rng.choice('ab')}>" if i % 3 else "<p>"
        pages.append((f"http://{rng.choice('abc')}.{rng.choice(['one', 'two'])}.{rng.choice(['de', 'org'])}/{i}", f"{tag}{words}"))
    return docs, pages


@pytest.mark.parametrize("n, block", [(3, 256), (9, 4)])
def test_posterior_against_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(G, "BLOCK_LANGUAGES", block)
    docs, pages = many_languages(n)
    langs, expected = fused_by_hand(pages, docs)
    got = {r.page_id: r for r in G.identify(
        spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string"),
        spark.createDataFrame(docs, "text string, lang string")).collect()}
    for i, posterior in enumerate(expected):
        assert got[i].posterior == pytest.approx(posterior, rel=1e-4, abs=1e-9)
        assert got[i].confidence == max(got[i].posterior)
        assert got[i].lang == langs[list(got[i].posterior).index(got[i].confidence)]


def test_more_languages_than_a_worker_holds(spark):
    docs, pages = many_languages(260)
    rows = G.identify(
        spark.createDataFrame([(i, *p) for i, p in enumerate(pages[:6])], "page_id long, url string, html string"),
        spark.createDataFrame(docs, "text string, lang string")).select("posterior").collect()
    assert [len(r.posterior) for r in rows] == [260] * 6
