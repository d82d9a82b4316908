"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprint: every shingle of `shingle` words (repeats included) is hashed by XXH64 with
seed 42; a bit of the 64-bit fingerprint is 1 if more than half of the hashes set it. A text
with fewer words is one shingle; a text without words has fingerprint zero and links like any
other. Two fingerprints link if they differ in at most `distance` bits.

Search: exact copies collapse to one fingerprint first. The 64 bits are grouped into parts,
bits that vary together in one part. If the thresholds t_i of the parts satisfy
sum(t_i + 1) = distance + 1, two linked fingerprints differ in at most t_i bits in some part,
so it suffices to probe each part with all values up to t_i bits away (t_i = -1: the part is
not probed). A dynamic program chooses the thresholds with the least estimated cost: probes
plus candidate pairs, estimated from how often each bit differs over all fingerprints. Probes
meet in buckets (shuffle by bucket), and each bucket is verified there: small buckets pair by
pair, large ones by a search that leaves a spanning forest of the links, never all pairs.
A bucket above `bucket_rows` is cut into blocks, and each pair of blocks is its own task
group, so no group grows beyond twice the limit and none is dropped.

Components come from rounds of star contraction over the link table, written to the shared
folder each round; nothing but counters returns to the driver.

Defined cases: null text counts as empty; a null doc_id takes part and gets the smallest id
of its component (null if it has none); repeated rows give repeated results; an empty table
gives an empty result. A text of any length is hashed whole (8 bytes a word in its task); the other columns
are the caller's choice (`keep`) or kept whatever their names (`keep_first`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from presswire.llm.common import map_texts, written

SHINGLE = 4
DISTANCE = 4
SEED = 42
BUCKET_ROWS = 8192
#: Cost of one probe row (generated, shuffled and sorted) in compared pairs.
PROBE_COST = 40.0
#: Cost per text of one more view (its fingerprint and its tables) in compared pairs.
VIEW_COST = 2000.0
BITS = 64

FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])
ONE = np.uint64(1)


def fingerprint(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive groups of hashes; a group of none gives zero."""
    out, full = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if not len(full):
        return out
    ends = np.cumsum(sizes)
    for a, b in _row_slices(sizes[full]):
        group = full[a:b]
        lo, hi = ends[group[0]] - sizes[group[0]], ends[group[-1]]
        bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, ends[group] - sizes[group] - lo, axis=0, dtype=np.int32)
        on = (2 * counts > sizes[group][:, None]).astype(np.uint8)
        out[group] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _row_slices(sizes: np.ndarray, limit: int = 200_000) -> Iterator[tuple[int, int]]:
    """Groups with about `limit` hashes each (64 bytes of bits per hash)."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    yield start, len(sizes)


def text_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle; bytes.lower() changes A-Z only, bytes.split() cuts at ASCII white space."""
    words = text.lower().split()
    if not words:
        return []
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= shingle:
        return [digest(b" ".join(words), SEED)]
    return [digest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """`keep` columns plus fp, the fingerprint as a signed long."""
    def make():
        def work(texts: list[bytes], _) -> list:
            groups = [np.array(text_hashes(t, shingle), np.uint64) for t in texts]
            sizes = np.array([len(g) for g in groups], np.int64)
            return [pa.array(fingerprint(np.concatenate(groups), sizes).view(np.int64))]

        return work

    return map_texts(docs, text, keep, FINGERPRINT, make)


def set_fingerprints(docs: DataFrame, text: str, keep: list[str], shingle: int, views: int = 1) -> DataFrame:
    """`keep` columns, fps (a fingerprint per view) and __set, the hash of the set of distinct shingles.

    The first view is the fingerprint of `fingerprints`; each other one takes the bits of the same hashes
    mixed anew, so views err independently.
    """
    fields = T.StructType([T.StructField("fps", T.ArrayType(T.LongType())), T.StructField("__set", T.LongType())])

    def make():
        def work(texts: list[bytes], _) -> list:
            groups = [np.array(text_hashes(t, shingle), np.uint64) for t in texts]
            sizes = np.array([len(g) for g in groups], np.int64)
            whole = np.concatenate(groups)
            fps = np.empty((len(texts), views), np.int64)
            for v in range(views):
                fps[:, v] = fingerprint(whole if v == 0 else mixed(whole ^ np.uint64(v)), sizes).view(np.int64)
            sets = [xxhash.xxh64_intdigest(np.unique(g).tobytes(), SEED) for g in groups]
            ends = pa.array(np.arange(0, fps.size + 1, views, dtype=np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(fps.ravel())),
                    pa.array(np.array(sets, np.uint64).view(np.int64))]

        return work

    return map_texts(docs, text, keep, fields, make)


# --- plan of the search -----------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set, over all of them."""

    def run(batches):
        both = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            rows += len(pdf)
        yield pd.DataFrame({"place": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), rows)})

    # 4,097 sums, however many fingerprints there are
    sums = fps.select("fp").mapInPandas(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for row in sums:
        flat[row.place] = row.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of about equal size; each starts at the first free bit and takes those most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        seed = free[0]
        chosen = sorted(sorted(free, key=lambda b: (b != seed, -corr[seed, b], b))[:size])
        out.append(chosen)
        free = [b for b in free if b not in chosen]
    return out


def near_share(differ: np.ndarray, most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0..most of some bits, each differing on its own."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist).tolist()


def allocate(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, of least estimated cost over the numbers of parts."""
    return _cheapest(n, both, distance)[1]


def _cheapest(n: int, both: np.ndarray, distance: int) -> tuple[float, list[tuple[list[int], int]]]:
    n = max(n, 1)
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)
    best_cost, best = float("inf"), []
    for parts in range(1, distance + 2):
        groups = group_bits(n, both, parts)
        # cheapest[s]: least cost of the parts so far with sum(t + 1) = s
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            share = near_share(differ[bits], distance)
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in cheapest.items():
                for t in range(-1, distance - used + 1):
                    probes = sum(_choose(len(bits), d) for d in range(t + 1))
                    pairs = n * n / 2 * share[t] if t >= 0 else 0.0
                    total = cost + n * probes * PROBE_COST + pairs
                    if total < step.get(used + t + 1, (float("inf"),))[0]:
                        step[used + t + 1] = (total, [*chosen, t])
            cheapest = step
        cost, chosen = cheapest[distance + 1]
        if cost < best_cost:
            best_cost, best = cost, list(zip(groups, chosen))
    return best_cost, [(bits, t) for bits, t in best if t >= 0]


def found_share(similarity: float, distance: int) -> float:
    """Chance that texts of this Jaccard similarity are up to `distance` bits apart: each bit of their
    fingerprints differs with the angle between their shingle vectors over pi."""
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return near_share(np.full(BITS, differ), distance)[distance]


def plan_views(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Distance and number of views of least estimated cost that find links of this similarity with this recall.

    Wide distances need few views but meet chance pairs with the square of `n`, narrow ones the
    other way round: the more texts, the narrower and the more views.
    """
    ideal = np.full((BITS, BITS), n // 4) + np.diag(np.full(BITS, n // 2 - n // 4))
    best = (float("inf"), 0, 0)
    for distance in range(2, 17):
        found = found_share(similarity, distance)
        views = 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))
        best = min(best, (views * (_cheapest(n, ideal, distance)[0] + n * VIEW_COST), distance, views))
    return best[1:]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


# --- probes and buckets -----------------------------------------------------------------


def probe_rows(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Bucket and fingerprint for every value probed; the bucket of a value is a hash of part and value."""
    tables = []
    for part, (bits, t) in enumerate(plan):
        mask = np.bitwise_or.reduce([ONE << np.uint64(b) for b in bits])
        flips = [np.uint64(0)]
        for d in range(1, t + 1):
            flips += [np.bitwise_or.reduce([ONE << np.uint64(b) for b in c]) for c in combinations(bits, d)]
        tables.append((np.uint64((part + 1) * 0x9E3779B97F4A7C15 % 2**64), mask, np.array(flips, np.uint64)))

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for salt, mask, flips in tables:
                step = max(1, 400_000 // len(flips))
                for a in range(0, len(fp), step):
                    some = fp[a:a + step]
                    values = ((some & mask)[:, None] ^ flips[None, :]).ravel()
                    buckets = mixed(values ^ salt)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buckets.view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))],
                        names=["bucket", "fp"])

    return fps.select("fp").mapInArrow(run, "bucket long, fp long")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them (two multiply-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split_buckets(probes: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds `a` and `b`: the pair of blocks of its bucket that a row is compared in (0, 0 for
    most). A bucket of up to `bucket_rows` rows is one block; the rows of a larger one go to
    every pair of blocks with their own."""
    # written first, so that Spark knows how few they are before it plans the join
    large = written(
        probes.groupBy("bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > bucket_rows)
        .select("bucket", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("blocks")), "large-buckets")
    zero = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    return (
        probes.join(large, "bucket", "left")
        .select("bucket", "fp", F.explode(F.when(F.col("blocks").isNull(), zero).otherwise(block_pairs("fp"))).alias("pair"))
        .select("bucket", "fp", "pair.a", "pair.b")
    )


def block_pairs(member: str) -> Column:
    """Every pair of the `blocks` blocks that holds the own block of a member."""
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(own, other).alias("a"), F.greatest(own, other).alias("b")),
    )


def links(rows: DataFrame, distance: int, few: int | None = None) -> DataFrame:
    """Links (lo, hi) of every bucket: all of a small one, a spanning forest of a large one.

    With `few`, all links of a large bucket with an end that has up to `few` of them there, and a
    spanning forest of those between its other members, marked by `dense`.
    """
    dealt = rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.any([c[1:] != c[:-1] for c in (cols[0], cols[2], cols[3])], axis=0)
            last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            held = [c[last:] for c in cols]
            if last:
                yield from _found(np.flatnonzero(change[:last]) + 1, cols[1][:last].view(np.uint64), distance, few)
        if held is not None and len(held[0]):
            yield from _found(np.array([len(held[0])]), held[1].view(np.uint64), distance, few)

    fields = "lo long, hi long" + ("" if few is None else ", dense boolean")
    return dealt.select("bucket", "fp", "a", "b").mapInArrow(run, fields)


def _found(ends: np.ndarray, fp: np.ndarray, distance: int, few: int | None = None, small: int = 32):
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    group = np.repeat(np.arange(len(sizes)), sizes)
    lo, hi, dense = [], [], []
    in_small = (sizes <= small)[group]
    for lag in range(1, min(small, int(sizes.max())) if len(sizes) else 0):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & in_small[lag:])
        if not len(i):
            break
        near = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance]
        lo.append(fp[near])
        hi.append(fp[near + lag])
        dense.append(np.zeros(len(near), bool))
    for g in np.flatnonzero(sizes > small):
        members = fp[starts[g]:ends[g]]
        if few is not None:
            a, b, members = thin_links(members, distance, few)
            lo.append(a)
            hi.append(b)
            dense.append(np.zeros(len(a), bool))
        a, b = forest(members, distance)
        lo.append(a)
        hi.append(b)
        dense.append(np.ones(len(a), bool))
    if lo:
        a, b = np.concatenate(lo).view(np.int64), np.concatenate(hi).view(np.int64)
        other = a != b
        out = [pa.array(np.minimum(a, b)[other]), pa.array(np.maximum(a, b)[other])]
        if few is None:
            yield pa.RecordBatch.from_arrays(out, names=["lo", "hi"])
        else:
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(np.concatenate(dense)[other])], names=["lo", "hi", "dense"])


def thin_links(fp: np.ndarray, distance: int, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of the members with up to `few` of them, and the other members."""
    fp = np.unique(fp)
    thin, a, b = np.zeros(len(fp), bool), [], []
    step = max(1, 1_000_000 // max(len(fp), 1))
    for s in range(0, len(fp), step):
        near = np.bitwise_count(fp[s:s + step, None] ^ fp[None, :]) <= distance
        own = near.sum(axis=1) - 1 <= few
        thin[s:s + step] = own
        i, j = np.nonzero(near & own[:, None])
        a.append(i + s)
        b.append(j)
    i, j = np.concatenate(a), np.concatenate(b)
    once = (i < j) | ((i != j) & ~thin[j])
    return fp[i[once]], fp[j[once]], fp[~thin]


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the link graph: each member is met once, so a dense group costs little."""
    rest = np.unique(fp)
    a, b = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                met = rest[near]
                queue.extend(met)
                a.append(np.full(len(met), at, np.uint64))
                b.append(met)
                rest = rest[~near]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


# --- components -------------------------------------------------------------------------


def components(edges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node it is connected to.

    Each round joins every node to its smallest neighbour (larger neighbours first, then the
    smaller ones), until the table no longer changes; about log(n) rounds.
    """
    now = written(edges.select(F.col(lo).alias("u"), F.col(hi).alias("v")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        )
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(down, "v")
            .select(F.explode(F.array(
                F.struct(F.col("m").alias("u"), F.col("v")),
                F.struct(F.least("m", "u").alias("u"), F.greatest("m", "u").alias("v")),
            )).alias("e"))
            .select("e.*").filter("u < v").distinct()
        )
        now = written(small, "links")


def near_components(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: list[str] | None = None,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """`keep` columns (doc_id by default), fp (long), component_id and root (the component's smallest
    fingerprint), one row per document."""
    keep = [doc_id] if keep is None else keep
    marked = written(fingerprints(docs, text=text, keep=list(dict.fromkeys([*keep, doc_id])), shingle=shingle),
                     "fingerprints")
    distinct = _distinct(marked, doc_id)
    return _labelled(marked, distinct, near_links(distinct, distance, bucket_rows), keep)


def _distinct(marked: DataFrame, doc_id: str) -> DataFrame:
    return written(marked.groupBy("fp").agg(F.min(F.col(f"`{doc_id}`")).alias("first_id")), "distinct-fingerprints")


def near_links(distinct: DataFrame, distance: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (lo, hi) that connect all fingerprints up to `distance` bits apart."""
    plan = allocate(*bit_counts(distinct), distance)
    return links(split_buckets(probe_rows(distinct, plan), bucket_rows), distance)


def _labelled(marked: DataFrame, distinct: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    roots = written(components(found), "components")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(of_fp, "fp").select(*[F.col(f"`{c}`") for c in keep], "fp", "component_id", "root")


# --- one document of each group ---------------------------------------------------------

#: Near copies: five-word shingles, alike in 0.8 of them. Texts just so alike differ in 9.7 bits on average;
#: the search is planned to find this share of them, more of the closer ones, and the shingles decide.
COPY_SHINGLE, COPY_SIMILARITY, COPY_RECALL = 5, 0.8, 0.92
#: Links that a member of a large bucket may have there to be verified one by one, and pairs of
#: shingle sets that a link of fingerprints may stand for.
FEW_LINKS = 32
#: Rows and bytes of shingles in a block of a family.
FAMILY_ROWS, FAMILY_BYTES = 2048, 16 << 20
KEY = ["__null", "__id", "__hash"]


def shingle_sets(docs: DataFrame, text: str, keep: list[str], shingle: int) -> DataFrame:
    """`keep` columns and `shingles`, the distinct shingle hashes of each text, ascending."""
    fields = T.StructType([T.StructField("shingles", T.BinaryType())])

    def make():
        def work(texts: list[bytes], _) -> list:
            return [[np.unique(np.array(text_hashes(t, shingle), np.uint64)).tobytes() for t in texts]]

        return work

    return map_texts(docs, text, keep, fields, make)


def alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """(lo, hi) of the pairs whose shingle sets `a` and `b` have at least this Jaccard similarity."""

    def run(batches):
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("lo", "hi", "a", "b").mapInArrow(run, "lo long, hi long")


def joins(fp: np.ndarray, label: np.ndarray, sets: list[np.ndarray], distance: int,
          similarity: float) -> list[tuple[int, int]]:
    """Index pairs of alike members up to `distance` bits apart that connect all labels so connected."""
    sizes = [len(s) for s in sets]
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    lengths, group = np.array(sizes), label.copy()
    held, out = np.zeros(sum(sizes) + 1, bool), []
    for i in range(len(fp) - 1):
        rest = slice(i + 1, None)
        near = (np.bitwise_count(fp[rest] ^ fp[i]) <= distance) & (group[rest] != group[i])
        near &= np.minimum(lengths[rest], sizes[i]) >= similarity * np.maximum(lengths[rest], sizes[i])
        held[codes[i]] = True
        for k in (np.flatnonzero(near) + i + 1).tolist():
            if group[k] != group[i]:
                both = np.count_nonzero(held[codes[k]])
                if both >= similarity * (sizes[i] + sizes[k] - both):
                    out.append((i, k))
                    group[group == group[k]] = group[i]
        held[codes[i]] = False
    return out


def family_links(members: DataFrame, distance: int, similarity: float,
                 block_rows: int = FAMILY_ROWS, block_bytes: int = FAMILY_BYTES) -> DataFrame:
    """Links (lo, hi) between the labels of a family, from its members (root, node, fp, label, shingles).

    Every pair of a family is looked at: a large family is cut into blocks, each pair of blocks
    is its own task group. A family of one label needs no more links.
    """
    left = written(
        members.groupBy("root")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("rows"),
             F.sum(F.length("shingles")).alias("bytes"))
        .filter("least < most")
        .select("root", F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("bytes") / block_bytes), F.lit(1))
                .cast("int").alias("blocks")), "open-families")
    dealt = (
        members.join(left, "root")
        .select("root", "node", "fp", "label", "shingles", F.explode(block_pairs("node")).alias("pair"))
        .select("root", "pair.a", "pair.b", "node", "fp", "label", "shingles")
        .repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    )

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, fp, label = (
            np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (3, 4, 5))
        sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.column(6).to_pylist()]
        found = joins(fp.view(np.uint64), label, sets, distance, similarity)
        i, k = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(node[i], node[k])), pa.array(np.maximum(node[i], node[k]))], names=["lo", "hi"])

    def run(batches):
        at, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s < e:
                    if parts and keys[s] != at:
                        yield joined(parts)
                        parts = []
                    at = keys[s]
                    parts.append(batch.slice(s, e - s))
        if parts:
            yield joined(parts)

    return dealt.mapInArrow(run, "lo long, hi long")


def _view_links(nodes: DataFrame, view: int, distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of one view: the fingerprints of all nodes, those of several nodes, and links (lo, hi, dense, crowded)."""
    own = nodes.select("node", F.get("fps", F.lit(view)).alias("fp"))
    distinct = written(own.groupBy("fp").agg(F.count("*").alias("sets")), "distinct-fingerprints")
    shared = written(distinct.filter("sets > 1"), "shared-fingerprints")
    plan = allocate(*bit_counts(distinct), distance)
    close = (
        links(split_buckets(probe_rows(distinct, plan), BUCKET_ROWS), distance, FEW_LINKS)
        .groupBy("lo", "hi").agg(F.max("dense").alias("dense")))
    pairs_of = F.coalesce("lo_sets", F.lit(1)) * F.coalesce("hi_sets", F.lit(1))
    found = written(
        close.join(shared.select(F.col("fp").alias("lo"), F.col("sets").alias("lo_sets")), "lo", "left")
        .join(shared.select(F.col("fp").alias("hi"), F.col("sets").alias("hi_sets")), "hi", "left")
        .select("lo", "hi", "dense", (pairs_of > FEW_LINKS).alias("crowded")), "candidate-links")
    return own, shared, found


def keep_first(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = COPY_SHINGLE,
    similarity: float = COPY_SIMILARITY,
    recall: float = COPY_RECALL,
    distance: int | None = None,
    views: int | None = None,
) -> DataFrame:
    """One document of each group of near copies, with all its columns.

    Texts with the same fingerprints and the same set of shingles are copies and one node. Candidates
    come from searches of `views` independent fingerprints up to `distance` bits apart (planned
    for the number of documents and `recall` unless given) and are verified on the shingle sets of
    their nodes. Where links are so many that a search gives a spanning forest only (dense ones), or
    fingerprints have so many nodes that a link stands for many pairs, the trees are families; so
    are the nodes of one fingerprint. Within a family every pair up to `distance` bits apart is
    verified that verified links do not connect already. The document with the smallest id stays,
    among texts with that id the one with the smallest hash; rows that repeat it go. Columns of
    any name are kept.
    """
    if distance is None or views is None:
        planned = plan_views(docs.count(), similarity, recall)
        distance, views = distance or planned[0], views or planned[1]
    plain = [f"c{i}" for i in range(len(docs.columns))]
    id_column, text_column = (F.col(plain[docs.columns.index(c)]) for c in (doc_id, text))
    keyed = docs.toDF(*plain).withColumns({
        "__id": F.coalesce(id_column, F.lit(0)), "__null": id_column.isNull(),
        "__hash": F.xxhash64(F.coalesce(text_column, F.lit("")))}).withColumn("__shown", text_column)
    nodes = written(
        set_fingerprints(keyed, "__shown", KEY, shingle, views).withColumn("node", F.xxhash64("fps", "__set"))
        .groupBy("node").agg(F.min("fps").alias("fps"), F.min(F.struct(*KEY)).alias("first")), "distinct-sets")
    searched = [_view_links(nodes, v, distance) for v in range(views)]
    linked = [
        own.join(found.select(F.explode(F.array("lo", "hi")).alias("fp")).unionByName(shared.select("fp")).distinct(), "fp")
        .select("node") for own, shared, found in searched]
    shown = nodes.join(reduce(DataFrame.unionByName, linked).distinct(), "node").select("node", "fps", "first.*")
    texts = keyed.select(*KEY, "__shown").join(shown, KEY).dropDuplicates(["node"])
    sets = written(shingle_sets(texts, "__shown", ["node", "fps"], shingle), "shingle-sets")

    def node_pairs(own: DataFrame, found: DataFrame) -> DataFrame:
        lo, hi = (own.select(F.col("fp").alias(f"{c}_fp"), F.col("node").alias(c)) for c in ("lo", "hi"))
        few = found.filter("not crowded").select(F.col("lo").alias("lo_fp"), F.col("hi").alias("hi_fp"))
        return few.join(lo, "lo_fp").join(hi, "hi_fp").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))

    pairs = reduce(DataFrame.unionByName, [node_pairs(own, found) for own, _, found in searched]).distinct()
    pairs = (
        pairs.join(sets.select(F.col("node").alias("lo"), F.col("shingles").alias("a")), "lo")
        .join(sets.select(F.col("node").alias("hi"), F.col("shingles").alias("b")), "hi"))
    copies = written(components(alike(pairs, similarity)), "copies")

    def family(view: int, shared: DataFrame, found: DataFrame) -> DataFrame:
        trees = components(found.filter("dense or crowded")).select(F.col("node").alias("fp"), "root")
        alone = shared.join(trees, "fp", "left_anti").select("fp", F.col("fp").alias("root"))
        own = sets.select("node", F.get("fps", F.lit(view)).alias("fp"), "shingles")
        return trees.unionByName(alone).withColumn("root", F.xxhash64("root", F.lit(view))).join(own, "fp")

    members = reduce(DataFrame.unionByName, [family(v, shared, found) for v, (_, shared, found) in enumerate(searched)])
    members = members.join(copies.withColumnRenamed("root", "label"), "node", "left").select(
        "root", "node", "fp", F.coalesce("label", "node").alias("label"), "shingles")
    more = family_links(members, distance, similarity)
    roots = written(
        components(copies.select(F.col("root").alias("lo"), F.col("node").alias("hi")).unionByName(more)), "components")
    first = (
        nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("first").alias("first")).select("first.*")
    )
    return keyed.join(first, KEY, "left_semi").dropDuplicates(KEY).select(*plain).toDF(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
