import math
from collections import Counter

import pytest
from fixtures import count_words, documents, empty
from pyspark.sql import functions as F

from presswire.llm import quality_rules as Q


def measures(text):
    words = count_words(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if count_words(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_measures_on_awkward_rows(spark):
    docs = documents(spark)
    got = Q.with_measures(docs).select("doc_id", *Q.MEASURES, "base_failed", "source").collect()
    expected = []
    for row in docs.collect():
        m = measures(row.text)
        expected.append((row.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0], "src"))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 200, 0.02), (20, 5000, 0.004), (900, 100_000, 0.01)])
def test_binomial_sum(spark, k, n, p):
    got = spark.range(1).select(Q.log_binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    exact = math.fsum(math.exp(
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        for i in range(k + 1))
    assert got == pytest.approx(math.log(exact), abs=1e-6)


def calibration(spark, good: int, noisy_good: int):
    clean, junk = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}##" for i in range(60))
    rows = [(i, junk if i < noisy_good else clean, "en") for i in range(good)]
    rows += [(good + i, junk, "en") for i in range(50)] + [(good + 50 + i, junk, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i < good else 0) for i in range(good + 50)] + [(None, 1), (1, None)],
                                   "doc_id long, quality int")
    return docs, labels


def test_cutoffs_follow_the_proof(spark):
    docs, labels = calibration(spark, 2000, 1)
    judged = {r.doc_id: r.kept for r in Q.score_documents(docs, labels).collect()}
    assert sum(judged[i] for i in range(2000)) == 1999  # the single noisy one goes
    assert not any(judged[i] for i in range(2000, 2050))
    assert all(judged[i] for i in range(2050, 2055))  # a stratum without labels keeps its documents
    kept = {r.doc_id for r in Q.keep_good(docs, labels).collect()}
    assert kept == {i for i, ok in judged.items() if ok}


def test_no_proof_no_cutoff(spark):
    docs, labels = calibration(spark, 40, 0)  # too few labels
    assert Q.score_documents(docs, labels).filter("kept").count() == 95
    docs, labels = calibration(spark, 2000, 200)  # too many good ones would go
    assert Q.score_documents(docs, labels).filter("kept").count() == 2055


def test_empty_tables_and_clashing_names(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score_documents(empty(spark), labels).count() == 0
    docs = documents(spark)
    assert Q.keep_good(docs, labels).columns == docs.columns
    assert Q.score_documents(docs, labels).count() == docs.count()
