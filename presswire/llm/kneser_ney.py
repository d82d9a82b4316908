"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs.

Three passes over the training texts, each a Spark job whose tasks send compressed sorted arrays
to buckets, so a frequent word is a number in one row of each task and never a group of rows:

1. words: XXH64 of every distinct token and its count. A word's id is its rank among the hashes.
2. pairs: the two ids in one 64-bit number, put through a bijection that spreads them over the
   buckets; a bucket merges its arrays into a sorted array of pair hashes and their counts.
3. per word id: as a context, the pairs' total and how many occur once, twice and more often; as
   a second word, the number of distinct words before it (its continuation count).

The model is these arrays as .npy files in the shared folder. Scoring maps them into memory in
every worker, where the pages are shared, and looks up a batch's pairs in sorted order, so
neighbouring needles touch neighbouring pages. On a store that can't be mapped a worker fetches
a file into its own temporary folder when it first needs it.

p(c | b) = max(n(bc) - D(n(bc)), 0) / n(b.) + gamma(b) p(c), and p(c) is the same over continuation
counts, interpolated with the uniform 1 / (V + 1); discounts D1, D2, D3+ come from the counts of
counts of each order. The first word follows a start mark; the last token of each text is an end
mark, counted and predicted like a word.

Defined cases: a null text counts as empty and has the end token only; a null doc_id is training
data; unknown words have the uniform share and are no context; repeated rows train and score each;
with no training text every token is unknown (score and base: uniform); an empty table has no rows;
a long text is taken in slices; only the named columns are read, so others may have any name. 2^32 - 1 distinct
words or more are an error before any pair is counted, since a pair of ids is held in 64 bits.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presswire.llm.common import map_texts, open_store, pieces
from presswire.session import ship_package, work_path

#: The end mark; no word can be white space.
END = b"\n"
START_ID = np.uint64(0xFFFFFFFF)
HELD_OUT = (7, 2)
#: Tokens gathered in a task before they are reduced; distinct words remembered by a worker.
TASK_TOKENS = 1 << 22
REMEMBERED = 600_000
SLICE_BYTES = 4 << 20
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end mark."""
    words = text.lower().split()
    words.append(END)
    return words


def held_out(doc_id: str = "doc_id", fold: tuple[int, int] = HELD_OUT):
    """Whether a document is held out: crc32 of its id's text modulo fold[0] is fold[1]."""
    remainder = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % fold[0]
    return F.coalesce(remainder == fold[1], F.lit(False))


# --- sorted arrays as compressed bytes --------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys; their cumulative sum (modulo 2^64) is the keys."""
    return np.diff(keys, prepend=np.uint64(0))


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the columns per key."""
    if not len(keys):
        return (keys, *columns)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[starts], *(np.add.reduceat(c[order], starts) for c in columns))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys))).astype(np.uint64)


def dealt(table: str, edges: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(table, bucket, arrays ...) rows of ascending keys cut at the buckets' lower edges."""
    cuts = np.append(np.searchsorted(keys, edges), len(keys))
    for b in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[b], cuts[b + 1])
        yield (table, int(b), squeeze(steps(keys[part])), [squeeze(c[part]) for c in columns])


ROWS = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("keys", T.BinaryType()), T.StructField("columns", T.ArrayType(T.BinaryType())),
])
ARROW_ROWS = pa.schema([("table", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()),
                        ("columns", pa.list_(pa.binary()))])


def row_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(row, ARROW_ROWS)], schema=ARROW_ROWS)


def merged(group: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """The arrays of a bucket as one."""
    keys = [np.cumsum(expand(k), dtype=np.uint64) for k in group["keys"]]
    columns = [[expand(c[i]) for c in group["columns"]] for i in range(width)]
    empty = [np.zeros(0, np.uint64)]
    return summed(np.concatenate(keys or empty), *(np.concatenate(c or empty) for c in columns))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_HALF = np.uint64(32)


def spread(pairs: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers: multiply, fold the upper half into the lower, multiply again."""
    x = pairs * _MIX
    return (x ^ (x >> _HALF)) * _MIX


def unspread(hashes: np.ndarray) -> np.ndarray:
    x = hashes * _UNMIX
    return (x ^ (x >> _HALF)) * _UNMIX


# --- model ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Where the arrays are and the few numbers that all workers need."""

    folder: str
    buckets: int
    sizes: tuple[int, ...]  # words per bucket
    n_tokens: int
    word_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    continuations: int  # distinct pairs
    leftover: float  # share of the uniform distribution in p(c)

    @property
    def n_words(self) -> int:
        return sum(self.sizes)


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the number of items seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = counts_of_counts
    if not (n1 and n2 and n3):
        return DEFAULT_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.01), k)) for k, d in enumerate(raw, 1))


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    """Written under a name of its own and moved into place: a repeated task replaces it whole."""
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    out = io.BytesIO()
    np.save(out, values)
    part = f"{base}/{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(part) as stream:
        stream.write(out.getbuffer())
    store.move(part, f"{base}/{name}")


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def mapped(folder: str, name: str) -> np.ndarray:
    """An array of the model, mapped into memory."""
    key = (folder, name)
    if key not in _MAPPED:
        if len(_MAPPED) and next(iter(_MAPPED))[0] != folder:
            _MAPPED.clear()
        store, base = open_store(folder)
        path = f"{base}/{name}"
        if store.type_name != "local":
            own = os.path.join(tempfile.mkdtemp(prefix="model-"), name)
            with store.open_input_stream(path) as source, open(own, "wb") as target:
                while block := source.read(1 << 22):
                    target.write(block)
            path = own
        found = np.load(path, mmap_mode="r")
        _MAPPED[key] = found
    return _MAPPED[key]


def before_of(ids: np.ndarray, texts: list[list[bytes]], start) -> np.ndarray:
    """The id before each one, `start` at the begin of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.append(0, np.cumsum([len(t) for t in texts]))[:-1]] = start
    return before


class Words:
    """Ids of words in a worker: a bounded memory in front of the mapped hashes."""

    def __init__(self, folder: str, sizes: tuple[int, ...]):
        self.folder, self.known = folder, {}
        self.offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        self.shift = np.uint64(64 - (len(sizes) - 1).bit_length()) if len(sizes) > 1 else None

    def ids(self, texts: list[list[bytes]]) -> np.ndarray:
        """Ids of the words of all texts in a row, -1 for words that were never counted."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        if new:
            self.known.update(zip(new, self.search(new).tolist()))
        get, size = self.known.__getitem__, sum(map(len, texts))
        return np.fromiter(map(get, chain.from_iterable(texts)), np.int64, size)

    def search(self, words: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for w in words], np.uint64)
        out = np.full(len(words), -1, np.int64)
        bucket = (hashes >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(words), np.int64)
        order = np.argsort(hashes)
        cuts = np.searchsorted(bucket[order], np.arange(len(self.offsets)))
        for b in np.flatnonzero(np.diff(cuts)):
            if self.offsets[b] == self.offsets[b + 1]:
                continue
            table, mine = mapped(self.folder, f"words-{b}.npy"), order[cuts[b]:cuts[b + 1]]
            at = np.minimum(np.searchsorted(table, hashes[mine]), len(table) - 1)
            same = table[at] == hashes[mine]
            out[mine[same]] = at[same] + self.offsets[b]
        return out


_WORDS: dict[str, Words] = {}


def words_of(folder: str, sizes: tuple[int, ...]) -> Words:
    if folder not in _WORDS:
        _WORDS.clear()
        _WORDS[folder] = Words(folder, sizes)
    return _WORDS[folder]


def bucket_count(spark: SparkSession) -> int:
    """Buckets, a power of two: as many as the session shuffles into, 16 at least."""
    return 1 << max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def hash_edges(buckets: int) -> np.ndarray:
    return np.arange(buckets, dtype=np.uint64) << np.uint64(64 - (buckets - 1).bit_length())


def train(texts: DataFrame, *, text: str = "text") -> Model:
    """Counts a table of training texts into a model in the shared folder."""
    spark = texts.sparkSession
    ship_package(spark)
    folder, buckets = work_path(spark, "kneser-ney"), bucket_count(spark)
    edges = hash_edges(buckets)
    source = texts.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def count_words(batches):
        def reduced(counts: Counter):
            keys = np.array([xxhash.xxh64_intdigest(w) for w in counts], np.uint64)
            return dealt("words", edges, *summed(keys, np.fromiter(counts.values(), np.uint64, len(counts))))

        counts: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts.update(tokens_of(raw))
                if len(counts) > REMEMBERED:
                    yield from row_batches(reduced(counts))
                    counts = Counter()
        yield from row_batches(reduced(counts))

    def store_words(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = merged(group, 1)
        save_array(folder, f"words-{key[1]}.npy", hashes)
        save_array(folder, f"counts-{key[1]}.npy", counts)
        return pd.DataFrame({"bucket": [key[1]], "n": [len(hashes)], "total": [int(counts.sum())]})

    stored = (
        source.mapInArrow(count_words, ROWS).groupBy("table", "bucket")
        .applyInPandas(store_words, "bucket int, n long, total long").collect()  # a row per bucket
    )
    sizes = [0] * buckets
    for row in stored:
        sizes[row.bucket] = row.n
    sizes, n_words = tuple(sizes), sum(sizes)
    if n_words >= int(START_ID):
        raise ValueError(f"{n_words} distinct words: a pair of ids is held in 64 bits, so there may be {int(START_ID) - 1}")
    n_tokens = sum(row.total for row in stored)
    id_edges = np.array([n_words * b // buckets for b in range(buckets)], np.uint64)

    def count_pairs(batches):
        words, held, size = words_of(folder, sizes), [], 0

        def reduced():
            return dealt("pairs", edges, *counted(np.concatenate(held))) if held else iter(())

        for batch in batches:
            for a, b in pieces(batch.column(0), SLICE_BYTES):
                texts = [tokens_of(raw) for raw in batch.column(0).slice(a, b - a).to_pylist()]
                ids = words.ids(texts).astype(np.uint64)
                held.append(spread((before_of(ids, texts, START_ID) << _HALF) | ids))
                size += len(ids)
                if size > TASK_TOKENS:
                    yield from row_batches(reduced())
                    held, size = [], 0
        yield from row_batches(reduced())

    def store_pairs(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = merged(group, 1)
        save_array(folder, f"pairs-{key[1]}.npy", hashes)
        save_array(folder, f"pair-counts-{key[1]}.npy", counts.astype(np.uint32 if counts.max() < 2**32 else np.uint64))
        pairs = unspread(hashes)
        first, second = pairs >> _HALF, pairs & np.uint64(0xFFFFFFFF)
        one, two, more = ((counts == 1), (counts == 2), (counts > 2))
        contexts = summed(first, counts, *(x.astype(np.uint64) for x in (one, two, more)))
        own = contexts[0] != START_ID
        nothing = np.zeros(0, np.uint64)
        rows = list(dealt("contexts", id_edges, *(c[own] for c in contexts)))
        if not own.all():
            rows += [("contexts", buckets, squeeze(contexts[0][~own]), [squeeze(c[~own]) for c in contexts[1:]])]
        rows += dealt("before", id_edges, *counted(second))
        kinds = np.array([np.count_nonzero(counts == k) for k in (1, 2, 3, 4)] + [len(hashes)], np.uint64)
        rows.append(("kinds", 0, squeeze(nothing), [squeeze(kinds)]))
        return pd.DataFrame(rows, columns=ROWS.names)

    def store_stats(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        b = key[0]
        blocks = {t: merged(g, w) for t, w in (("contexts", 4), ("before", 1))
                  if len(g := group[group["table"] == t])}
        low = int(id_edges[b]) if b < buckets else int(START_ID)
        high = (int(id_edges[b + 1]) if b + 1 < buckets else n_words) if b < buckets else low + 1
        stats = np.zeros((5, high - low), np.uint64)
        if "contexts" in blocks:
            at = (blocks["contexts"][0] - np.uint64(low)).astype(np.int64)
            stats[:4, at] = np.stack(blocks["contexts"][1:])
        if "before" in blocks:
            stats[4, (blocks["before"][0] - np.uint64(low)).astype(np.int64)] = blocks["before"][1]
        kinds = [int(np.count_nonzero(stats[4] == k)) for k in (1, 2, 3, 4)]
        save_array(folder, f"stats-{b}.npy", stats.astype(np.uint32) if stats.max() < 2**32 else stats)
        return pd.DataFrame({"part": ["stats"], "kinds": [[*kinds, int(np.count_nonzero(stats[4] > 2))]]})

    def sum_kinds(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([expand(c[0]) for c in group["columns"]], axis=0)
        return pd.DataFrame({"part": ["pairs"], "kinds": [total.astype(np.int64).tolist()]})

    def by_bucket(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return sum_kinds(group) if key[1] == "kinds" else store_stats(key, group)

    pairs = source.mapInArrow(count_pairs, ROWS).groupBy("table", "bucket").applyInPandas(store_pairs, ROWS)
    sums = (
        pairs.withColumn("kind", F.when(F.col("table") == "kinds", "kinds").otherwise("stats"))
        .groupBy("bucket", "kind").applyInPandas(by_bucket, "part string, kinds array<long>").collect()  # a row per bucket
    )
    pair_kinds = np.sum([r.kinds for r in sums if r.part == "pairs"] or [[0] * 5], axis=0)
    word_kinds = np.sum([r.kinds for r in sums if r.part == "stats"] or [[0] * 5], axis=0)
    word_d = discounts(word_kinds[:4].tolist())
    distinct = int(pair_kinds[4])
    taken = word_d[0] * word_kinds[0] + word_d[1] * word_kinds[1] + word_d[2] * word_kinds[4]
    return Model(folder, buckets, sizes, n_tokens, word_d, discounts(pair_kinds[:4].tolist()), distinct,
                 float(taken / distinct) if distinct else 1.0)


class Scorer:
    """Log probabilities of batches of texts under a model, in a worker."""

    def __init__(self, model: Model):
        self.model, self.words = model, words_of(model.folder, model.sizes)
        n = model.n_words
        self.id_edges = np.array([n * b // model.buckets for b in range(model.buckets)], np.int64)
        self.uniform = model.leftover / (n + 1)

    def _by_bucket(self, keys: np.ndarray, edges: np.ndarray):
        """(bucket, rows) for ascending keys."""
        cuts = np.append(np.searchsorted(keys, edges), len(keys))
        for b in np.flatnonzero(np.diff(cuts)):
            yield int(b), slice(cuts[b], cuts[b + 1])

    def word_stats(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stats rows and counts of ascending ids of known words."""
        stats, counts = np.zeros((5, len(ids)), np.float64), np.zeros(len(ids), np.float64)
        for b, rows in self._by_bucket(ids, self.id_edges):
            stats[:, rows] = mapped(self.model.folder, f"stats-{b}.npy")[:, ids[rows] - self.id_edges[b]]
        for b, rows in self._by_bucket(ids, self.words.offsets[:-1]):
            counts[rows] = mapped(self.model.folder, f"counts-{b}.npy")[ids[rows] - self.words.offsets[b]]
        return stats, counts

    def pair_counts(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.float64)
        for b, rows in self._by_bucket(hashes, hash_edges(self.model.buckets)):
            try:
                table = mapped(self.model.folder, f"pairs-{b}.npy")
            except FileNotFoundError:  # no pair fell into this bucket
                continue
            at = np.minimum(np.searchsorted(table, hashes[rows]), len(table) - 1)
            counts = mapped(self.model.folder, f"pair-counts-{b}.npy")[at]
            out[rows] = np.where(table[at] == hashes[rows], counts, 0)
        return out

    def discount(self, counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, model score."""
        m = self.model
        words = [tokens_of(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        starts = np.append(0, np.cumsum(sizes)[:-1])
        ids = self.words.ids(words)
        before = before_of(ids, words, int(START_ID))
        known = ids >= 0
        # statistics once per distinct word, then by place; place 0 is for unknown words
        vocabulary, own = np.unique(ids, return_inverse=True)
        at = np.flatnonzero(vocabulary >= 0)
        stats, counts = np.zeros((5, len(vocabulary))), np.zeros(len(vocabulary))
        stats[:, at], counts[at] = self.word_stats(vocabulary[at])
        count, seen = counts[own], stats[4][own]
        base = np.log10((count + 1) / (m.n_tokens + 1 * (m.n_words + 1)))
        # p(c)
        p = np.maximum(seen - self.discount(seen, m.word_discounts), 0) / max(m.continuations, 1) + self.uniform
        # contexts: the statistics of the token before; the start mark has its own file
        context = np.empty((4, len(ids)))
        context[:, 1:] = stats[:4, own[:-1]]
        context[:, starts] = mapped(m.folder, f"stats-{m.buckets}.npy")[:4] if m.n_tokens else 0
        total = context[0]
        used = total > 0
        both = np.flatnonzero(used & known)
        pairs, back = np.unique(
            spread((before[both].astype(np.uint64) << _HALF) | ids[both].astype(np.uint64)), return_inverse=True)
        n = np.zeros(len(ids))
        n[both] = self.pair_counts(pairs)[back]
        safe = np.where(used, total, 1.0)
        d = m.pair_discounts
        gamma = np.where(used, (d[0] * context[1] + d[1] * context[2] + d[2] * context[3]) / safe, 1.0)
        p = np.where(used, np.maximum(n - self.discount(n, d), 0) / safe, 0.0) + gamma * p
        add = lambda x: np.add.reduceat(x, starts)
        return sizes, add((count > 0).astype(np.int64)), add(base), add(np.log10(p))


SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("perplexity", T.DoubleType()),
])


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str]) -> DataFrame:
    """`keep` columns, token counts, base and model log10 probability, perplexity of every text."""

    def make():
        scorer = Scorer(model)

        def work(texts: list[bytes], _) -> list:
            if not texts:
                return [[], [], [], [], []]
            sizes, known, base, score = scorer.score(texts)
            return [pa.array(x) for x in (sizes.astype(np.int64), known, base, score, 10 ** (-score / sizes))]

        return work

    return map_texts(docs, text, keep, SCORES, make)


def score_held_out(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                   fold: tuple[int, int] = HELD_OUT) -> tuple[DataFrame, Model]:
    """All documents scored by a model of those that are not held out."""
    model = train(docs.filter(~held_out(doc_id, fold)), text=text)
    marked = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).withColumn("held_out", held_out(doc_id, fold))
    return score_texts(marked, model, text=text, keep=[doc_id, "held_out"]), model
