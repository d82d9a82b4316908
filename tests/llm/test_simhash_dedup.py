import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import TEXTS, documents, empty, lower
from pyspark.sql import functions as F

from presswire.llm import simhash_dedup as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
    return " ".join(words)


def test_whole_operator_against_brute_force(spark):
    rng = random.Random(3)
    texts = [t for t in TEXTS if t is None or len(t) < 5000]
    for g in range(6):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(300)]
        texts += [edited(rng, words, k) for k in (0, 0, 1, 1, 2, 4, 40)]
    docs = documents(spark, texts)
    rows = S.near_components(docs, keep=["doc_id", "source"]).collect()
    by_row = docs.collect()
    fps = [brute_fingerprint(r.text) for r in by_row]
    groups = brute_components(fps)
    least = {}
    for r, g in zip(by_row, groups):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    expected = sorted((repr(r.doc_id), f, least.get(g)) for r, f, g in zip(by_row, fps, groups))
    assert sorted((repr(r.doc_id), r.fp % 2**64, r.component_id) for r in rows) == expected


@pytest.mark.parametrize("bucket_rows", [20, 8192])
def test_every_link_of_random_clusters_is_found(spark, bucket_rows):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40)
    fps = [int(s) for s in seeds]
    for s in seeds.tolist():  # clusters of many different near fingerprints, chained outwards
        at = s
        for _ in range(40):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                at ^= 1 << int(b)
            fps.append(at % 2**64)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    n, both = S.bit_counts(table)
    assert n == len(fps) and int(both[3, 3]) == sum(x >> 3 & 1 for x in fps)
    plan = S.allocate(n, both, 4)
    assert sum(t + 1 for _, t in plan) == 5
    found = S.links(S.split_buckets(S.probe_rows(table, plan), bucket_rows), 4)
    roots = {r.node: r.root for r in S.components(found).collect()}
    groups = brute_components(fps)
    ours = [roots.get(x - 2**64 if x >= 2**63 else x, x) for x in fps]
    pairs = lambda g: {i: frozenset(j for j in range(len(fps)) if g[j] == g[i]) for i in range(len(fps))}
    assert pairs(ours) == pairs(groups)


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**10])
def test_thresholds_satisfy_the_pigeonhole_at_every_size(n):
    both = np.full((64, 64), n // 4) + np.diag(np.full(64, n // 4))
    plan = S.allocate(n, both, 4)
    assert sum(t + 1 for _, t in plan) == 5
    bits = [b for part, _ in plan for b in part]
    assert len(bits) == len(set(bits))


def test_empty_table(spark):
    assert S.near_components(empty(spark)).count() == 0


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(7)
    texts, group = [], []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(3000)}" for _ in range(400)]
        for k in (0, 0, 1, 2, 3, 60):  # the last is another document
            texts.append(edited(rng, words, k))
            group.append(g if k < 60 else 100 + g)
    texts += [None, None, ""]
    group += [200, 200, 200]
    rows = [(i if i != 30 else None, t, "en", "s", 1, 2, "x", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:1], documents(spark).schema)
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert len({group[i] for i in got}) == len(got) == len(set(group))
    for g in set(group):
        members = [i for i in range(len(texts)) if group[i] == g and i != 30]
        assert min(members) in got
    assert S.keep_first(empty(spark)).count() == 0


def test_unlike_texts_with_near_fingerprints_stay(spark):
    pairs = spark.createDataFrame([
        (1, 2, np.arange(10, dtype=np.uint64).tobytes(), np.arange(2, 12, dtype=np.uint64).tobytes()),
        (1, 3, np.arange(10, dtype=np.uint64).tobytes(), np.arange(1, 10, dtype=np.uint64).tobytes())],
        "lo long, hi long, a binary, b binary")
    assert [tuple(r) for r in S.alike(pairs, 0.8).collect()] == [(1, 3)]


def kept_by_brute_force(texts, distance=12):
    """Smallest index of each group of texts linked by fingerprint and shingle sets."""
    sets = [shingles(t) for t in texts]
    fps = [int(S.fingerprint(np.array(h, np.uint64), np.array([len(h)]))[0])
           for h in (S.text_hashes(t.encode(), 5) for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= distance and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i in range(len(texts))})


def test_large_groups_of_not_mutually_alike_copies(spark):
    rng = random.Random(11)
    texts = []
    for g in range(3):  # each copy is about 0.86 like the original, two copies about 0.75 like each other
        words = [f"g{g}w{rng.randrange(5000)}" for _ in range(600)]
        texts += [edited(rng, words, rng.choice((6, 9, 12))) for _ in range(120)]
        at = words
        for _ in range(60):  # a chain away from the original
            at = edited(rng, at, 10).split()
            texts.append(" ".join(at))
        texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in S.keep_first(docs, distance=12, views=1).collect())
    assert got == kept_by_brute_force(texts)


@pytest.mark.parametrize("block_rows", [40, 2048])
def test_families_are_joined_across_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    rows = []
    for fp in range(150):  # all up to 8 bits apart; chains of alike sets at random places
        chain, step = divmod(fp, 50)
        rows.append((7, fp, fp, (base + np.uint64(1000 * chain + 8 * step)).tobytes()))
    rng.shuffle(rows)
    rows = [(7, int(fp), int(label), shown) for _, fp, label, shown in rows]
    members = spark.createDataFrame(rows, "root long, fp long, label long, shingles binary").withColumn("node", F.col("fp"))
    found = S.components(S.family_links(members, 12, 0.8, block_rows)).collect()
    assert {r.node: r.root for r in found} == {fp: fp // 50 * 50 for fp in range(150)}


def test_unlike_texts_with_equal_fingerprints_stay(spark):
    rng = random.Random(13)
    line = "the same short line again and again for ever " * 100
    texts = []
    for g in range(4):  # nearly all of it is one line, the rest differs from text to text
        words = [f"g{g}w{rng.randrange(5000)}" for _ in range(60)]
        texts += [line + " ".join(words), line + " ".join(words), line + edited(rng, words, 1)]
    texts += [line + " ".join(f"x{rng.randrange(5000)}" for _ in range(40)) for _ in range(40)]
    fps = [int(S.fingerprint(np.array(h, np.uint64), np.array([len(h)]))[0])
           for h in (S.text_hashes(x.encode(), 5) for x in texts)]
    assert len(set(fps)) < len(texts) // 2
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in S.keep_first(docs, distance=12, views=1).collect())
    assert got == kept_by_brute_force(texts)


def exact_groups(texts):
    """Index of the first text of each group that links of Jaccard 0.8 or more connect, by an exact prefix filter."""
    sets = [frozenset(shingles(t)) for t in texts]
    often = Counter(x for s in sets for x in s)
    root, met = list(range(len(texts))), {}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, s in sorted(enumerate(sets), key=lambda p: len(p[1])):
        rare = sorted(s, key=lambda x: (often[x], hash(x)))[:len(s) - math.ceil(0.8 * len(s)) + 1]
        for j in {j for x in rare for j in met.get(x, ())}:
            if find(i) != find(j) and len(sets[j]) >= 0.8 * len(s):
                both = len(s & sets[j])
                if both >= 0.8 * (len(s) + len(sets[j]) - both):
                    root[max(find(i), find(j))] = min(find(i), find(j))
        for x in rare:
            met.setdefault(x, []).append(i)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_near_copies_of_the_given_documents_against_exact_jaccard(spark, sf_dir, size):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", size) + "/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.select("text").collect()]
    groups = exact_groups(texts)
    assert len(texts) > len(set(groups))
    kept = S.keep_first(docs).count()
    assert kept >= len(set(groups))  # nothing is joined that exact links do not connect
    copies = len(texts) - len(set(texts))
    near = len(texts) - copies - len(set(groups))
    assert len(texts) - copies - kept >= 0.9 * near


def test_links_of_barely_enough_similarity_are_found(spark):
    rng = random.Random(17)
    texts = []
    for g in range(150):  # 11 to 14 of 600 words changed: similarities just above and below 0.8
        words = [f"g{g}w{rng.randrange(50_000)}" for _ in range(600)]
        texts += [" ".join(words), edited(rng, words, rng.randrange(11, 15))]
    sets = [shingles(t) for t in texts]
    due = [i for i in range(0, len(texts), 2)
           if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(due) > 50
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in S.keep_first(docs).collect()}
    found = [i for i in due if i + 1 not in kept]
    assert len(found) >= 0.9 * len(due)
    assert not [i for i in range(0, len(texts), 2) if i not in due and i + 1 not in kept]


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, "a b c d e f g", 5, True, 7, 8), (2, "a b c d e f g", 6, False, 7, 8), (3, None, 1, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, __null boolean, __hash long, fps long")
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_narrow_searches_of_many_views_for_many_texts():
    for n in (100, 10**5, 10**7, 10**9):
        distance, views = S.plan_views(n, 0.8, 0.92)
        assert 1 - (1 - S.found_share(0.8, distance)) ** views >= 0.92
    assert S.plan_views(10**9, 0.8, 0.92)[0] < S.plan_views(10**5, 0.8, 0.92)[0]
