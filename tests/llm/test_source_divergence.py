"""The divergence audit against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from fixtures import TEXTS, documents, empty, lower
from presswire.llm import source_divergence as audit_of


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def by_hand(rows, top=200, min_docs=3):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", Counter(terms_of(text))
        sources[lang].add(source)
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
    out = []
    for lang, names in sources.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        whole = Counter()
        for s in names:
            whole.update(counts[lang, s])

        def scaled(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: scaled(counts[lang, s]) for s in names}, scaled(whole)
        for s in names:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in names - {s}]
            marks = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values, limit in (("pair", pairs, None), ("term", marks, top)):
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(values[:limit], 1)]
    return sorted(out)


def ours(df, **options):
    found = audit_of.audit(df, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def test_translate_table_splits_like_the_pattern():
    for text in [*TEXTS, "a1b A_B É x y\tz"]:
        assert term_counter(text) == Counter(terms_of(text))


def term_counter(text):
    return Counter({k.decode(): n for k, n in audit_of.term_counter((text or "").encode()).items()})


def test_long_texts_are_split_at_separators(monkeypatch):
    monkeypatch.setattr(audit_of, "SPLIT_BYTES", 3)
    text = "alpha beta alpha gamma, é" * 7
    assert term_counter(text) == Counter(terms_of(text))


def test_awkward_documents(spark):
    rows = [(t, lang, source) for i, t in enumerate(TEXTS * 3)
            for lang, source in [([None, "en", "de"][i % 3], [None, "a", "b", "é", "c d"][i % 5])]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr(
        "*", "1 AS term", "2 AS n", "3 AS number", "4 AS value")
    assert ours(df) == by_hand(rows)
    assert ours(df, top=2, min_docs=1) == by_hand(rows, top=2, min_docs=1)


def test_no_rows_no_terms_one_source(spark):
    assert ours(empty(spark)) == []
    rows = [("1 2", "en", "a"), (None, "en", "b"), ("rare", "en", "c"), ("x x", "de", "a")]
    assert ours(spark.createDataFrame(rows, "text string, lang string, source string")) == by_hand(rows)


def test_repeated_rows_and_hot_terms(spark):
    rows = [("the the cat", "en", f"s{i % 7}") for i in range(60)] + [(f"the word{chr(97 + i % 26)}", "en", "s1") for i in range(90)]
    assert ours(spark.createDataFrame(rows, "text string, lang string, source string")) == by_hand(rows)


def test_blocks_of_sources_and_groups_of_terms_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(audit_of, "GROUP_CELLS", 20)
    monkeypatch.setattr(audit_of, "SOURCE_BLOCK", 3)
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 4, 2)) for _ in range(40)]
    rows = [(" ".join(rng.choice(words, 9)), ["en", "de"][i % 2], f"s{rng.integers(0, 8)}") for i in range(80)]
    groups = spark.createDataFrame(rows, "text string, lang string, source string")
    block, parts = audit_of.SOURCE_BLOCK, audit_of.GROUP_CELLS

    def summed(part: pd.DataFrame) -> pd.DataFrame:  # workers import the module afresh
        audit_of.SOURCE_BLOCK, audit_of.GROUP_CELLS = block, parts
        return audit_of_sums(part)

    audit_of_sums = audit_of._pair_sums
    monkeypatch.setattr(audit_of, "_pair_sums", summed)
    assert ours(groups) == by_hand(rows)
