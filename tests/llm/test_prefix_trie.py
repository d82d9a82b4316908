"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from presswire.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, ids int, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def by_hand(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append(((turn is not None, turn or 0), digest(role, text), role, text))
    convs = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in convs.items()}
    members = defaultdict(list)
    whole = {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = convs.get(first, [])[:h] + convs[c][h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(inside) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted((
        min(inside), len(node), members[node[:-1]][0] if node else None, len(inside), children[node], leaves[node],
        saved[node], hashlib.sha256(",".join(str(c) for c in inside if len(whole[c]) == len(node)).encode()).hexdigest())
        for node, inside in members.items())


def ours(df):
    found = trie.prefix_nodes(df)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                             "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in found.collect())


def talks(n, seed, kinds=4, longest=7):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), "é" * r.randrange(kinds)) for c in range(n) for t in range(r.randrange(1, longest))]


AWKWARD = [
    (None, 0, "user", "lost"), (0, None, None, None), (0, None, "user", "a"), (0, 1, "user", "b"), (0, 1, "user", "b"),
    (0, 1, "user", "c"), (1, 0, "user", ""), (1, 0, "", "user"), (2, 5, "x", "NUL \x00"), (3, 0, "u", "long " * 50_000),
    (4, 0, "u", "long " * 50_000), (-3, 0, "u", "v"), (-5, 0, "u", "v"), (-5, 1, "u", "w"), (7, 0, "u", "only own"),
    (2**62, 0, "u", "v"), (-2**63, 0, "u", "v"), *[(11, t, "r", f"t{t % 3}") for t in range(300)],
]


@pytest.mark.parametrize("shard_turns", [5, 200_000])
def test_awkward_conversations(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard_turns)
    assert ours(frame(spark, AWKWARD)) == by_hand(AWKWARD)


def test_empty(spark):
    assert ours(frame(spark, [])) == []
    assert ours(frame(spark, [(None, 1, "a", "b")])) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_cut_into_shards_gives_the_same_nodes(spark, monkeypatch, seed):
    rows = talks(120, seed)
    expected = by_hand(rows)
    for shard_turns in (3, 11, 90):
        monkeypatch.setattr(trie, "SHARD_TURNS", shard_turns)
        assert ours(frame(spark, rows)) == expected


def test_a_sequence_of_most_conversations_spans_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 40)
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 400, 5) for t in range(3)] + talks(60, 4)
    assert ours(frame(spark, rows)) == by_hand(rows)


def test_siblings_are_balanced():
    tree = trie.TernaryTree()
    for i in trie._median_first(1023):
        tree.insert([i], [1], (i, i + 1))
    depth, level = 0, [tree.down[0]]
    while level:
        depth, level = depth + 1, [x for n in level for x in (tree.less[n], tree.more[n]) if x >= 0]
    assert depth == 10
