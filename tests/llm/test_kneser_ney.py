import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import TEXTS, documents, empty, lower

from presswire.llm import kneser_ney as K


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + ["\n"]


def brute(train):
    """Model and base by plain counting; returns a function from text to the four results."""
    words, pairs = Counter(), Counter()
    for t in train:
        ts = tokens(t)
        words.update(ts)
        pairs.update(zip(["<start>"] + ts[:-1], ts))
    n, v = sum(words.values()), len(words)
    before = Counter(b for _, b in pairs)
    context = defaultdict(Counter)
    for (a, b), c in pairs.items():
        context[a][b] = c

    def discounts(counter):
        kinds = Counter(counter.values())
        return K.discounts([kinds[k] for k in (1, 2, 3, 4)])

    d1, d2 = discounts(before), discounts(pairs)
    pick = lambda d, c: 0 if c == 0 else d[min(c, 3) - 1]
    taken = sum(pick(d1, c) for c in before.values())

    def single(w):
        return max(before[w] - pick(d1, before[w]), 0) / len(pairs) + taken / len(pairs) / (v + 1)

    def score(text):
        ts, total, base = tokens(text), 0.0, 0.0
        for a, b in zip(["<start>"] + ts[:-1], ts):
            p, c = single(b), context.get(a)
            if c:
                whole = sum(c.values())
                p = max(c[b] - pick(d2, c[b]), 0) / whole + sum(pick(d2, x) for x in c.values()) / whole * p
            total += math.log10(p)
            base += math.log10((words[b] + 1) / (n + 1 * (v + 1)))
        return len(ts), sum(words[t] > 0 for t in ts), n, base, total

    return score, words, context, single


def test_scores_match_plain_counting(spark):
    extra = ["the cat sat on the mat", "the cat sat", "the dog sat on the cat", "a dog", "the the the"] * 3
    docs = documents(spark, TEXTS + extra)
    scored, model = K.score_held_out(docs)
    rows, source = scored.collect(), docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    score, *_ = brute([r.text for r in source if not held(r.doc_id)])
    expected = sorted((repr(r.doc_id), held(r.doc_id), *score(r.text)) for r in source)
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, model.n_tokens, r.base_score, r.score) for r in rows)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a", "a b d", "c c c b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    score, words, context, single = brute(texts)
    # the brute-force model sums to one over all words and the unknown; the operator equals it
    assert sum(map(single, words)) + single("unknown") == pytest.approx(1)
    model = K.train(docs)
    rows = K.score_texts(docs, model, keep=["doc_id"]).collect()
    for r in rows:
        assert r.score == pytest.approx(score(texts[r.doc_id])[4])
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_arrays_survive_compression():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (np.cumsum(K.expand(K.squeeze(K.steps(keys))), dtype=np.uint64) == keys).all()
    assert (K.unspread(K.spread(keys)) == keys).all()
    assert len(np.unique(K.spread(np.arange(10_000, dtype=np.uint64)))) == 10_000


def test_empty_tables(spark):
    scored, _ = K.score_held_out(empty(spark))
    assert scored.count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    untrained = K.train(docs.limit(0))
    row = K.score_texts(docs, untrained, keep=["doc_id"]).first()
    assert (row.n_tokens, row.n_known, row.score, row.base_score) == (3, 0, 0.0, 0.0)


def test_more_words_than_ids_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    monkeypatch.setattr(K, "START_ID", np.uint64(5))
    with pytest.raises(ValueError, match="5 distinct words"):
        K.train(docs)
