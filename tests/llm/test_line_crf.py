import itertools
import zlib

import numpy as np
import pytest
from fixtures import documents, empty

from presswire.llm import line_crf as L


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 1, 4])
    good, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    p, expected, total = L.Chains(sizes).marginals(good, moves)
    at, all_moves, logs = 0, np.zeros((2, 2)), 0.0
    for n in sizes:
        weights, on = 0.0, np.zeros(n)
        moved = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(good[at + i] for i in range(n) if path[i]) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            weights += w
            on += w * np.array(path)
            for a, b in zip(path, path[1:]):
                moved[a, b] += w
        if n:
            assert p[at:at + n] == pytest.approx(on / weights)
            logs += np.log(weights)
        all_moves += moved / weights
        at += n
    assert expected == pytest.approx(all_moves)
    assert total == pytest.approx(logs)


def test_neighbours_stop_at_documents():
    own = np.arange(4 * L.OWN, dtype=np.float32).reshape(4, L.OWN) + 1
    x = L.with_neighbours(own, np.array([0, 3]))
    assert (x[0, L.OWN:2 * L.OWN] == 0).all() and (x[3, L.OWN:2 * L.OWN] == 0).all()
    assert (x[2, 2 * L.OWN:3 * L.OWN] == 0).all() and (x[1, 2 * L.OWN:3 * L.OWN] == own[2]).all()


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    field = L.train(docs, labels)
    rows = L.score_texts(docs, field, keep=["doc_id"]).join(labels, "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 40
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in out]) >= 0.95


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 0, 1), (None, 1, 0), (8, None, 0), (99, 1, 0), (9, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    field = L.train(docs, labels)
    rows = L.score_texts(docs, field, keep=docs.columns).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.text or "").strip()} == {field.prior}
    assert L.keep_good(docs, labels).columns == docs.columns
    nothing = L.train(docs, labels.limit(0))
    assert nothing.prior == 0.5
    assert L.score_texts(empty(spark), field, keep=["doc_id"]).count() == 0
