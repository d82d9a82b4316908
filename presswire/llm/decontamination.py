"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of `window` consecutive words of the benchmark items; an item
with fewer words is one window. Patterns of one length share a shift table over blocks of
two words: a block that no pattern holds moves the search on by almost a whole window, so
most words of a clean document are never looked at. A block that ends some pattern selects
a bucket, and the window is compared with the bucket's strings directly.

The benchmark is sent to the workers in blocks of bounded size (`block_bytes` of text, one
item at least); documents pass through one search per block and carry a bitmap of the words
hit so far, so a benchmark of any size works without a shuffle.

Defined cases: a null or empty text has no words and is never contaminated; a null or empty
item has no window; an item without id is searched for and named by the empty string; items
with the same id count once; repeated documents are each searched; an empty benchmark marks
nothing. A document column that has the name of an output column is replaced by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from presswire.llm.common import folded_words, map_texts

WINDOW = 10
BLOCK_BYTES = 16 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_STATE = T.StructType([
    T.StructField("__hits", T.BinaryType()),
    T.StructField("__found", T.ArrayType(T.StringType())),
])
_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class WuManber:
    """Search for patterns of one length `m` in a list of words."""

    def __init__(self, m: int, patterns: dict[bytes, set[str]]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, set[str]]] = {}
        for joined, items in patterns.items():
            words = joined.split(b" ")
            for end in range(self.block, m + 1):
                block = b" ".join(words[end - self.block:end])
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
            self.buckets.setdefault(block, {})[joined] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of every occurrence."""
        m, far, shift, i, n = self.m, self.far, self.shift, self.m - 1, len(words)
        while i < n:
            block = words[i - 1] + b" " + words[i] if m > 1 else words[i]
            step = shift.get(block, far)
            if step:
                i += step
                continue
            items = self.buckets[block].get(b" ".join(words[i - m + 1:i + 1]))
            if items is not None:
                yield i - m + 1, items
            i += 1


def build(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    """One searcher per pattern length."""
    patterns: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        words = folded_words(text.encode())
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            patterns.setdefault(m, {}).setdefault(b" ".join(words[i:i + m]), set()).add(item)
    return [WuManber(m, p) for m, p in sorted(patterns.items())]


_BUILT: dict[str, list[WuManber]] = {}


def _searchers(name: str, shared: Broadcast, window: int) -> list[WuManber]:
    """Built once per worker process; only the latest block is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(shared.value, window)
    return _BUILT[name]


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of about `block_bytes`, fetched one block at a time."""
    named = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    held, size = [], 0
    for row in named.toLocalIterator():
        if held and size + len(row.text) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row.item, row.text))
        size += len(row.text)
    yield held


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`keep` columns (all by default) plus n_words, n_hit, spans (runs of hit words, end
    exclusive) and items (distinct ids found, sorted as strings)."""
    state, spark = docs, docs.sparkSession
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in _RESULT.names]
    carried = list(dict.fromkeys([*wanted, text]))
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        through = wanted if after is None else carried
        before = [] if first else [f"{c}_before" for c in _STATE.names]
        state = state.drop(*before).withColumnsRenamed(dict(zip(_STATE.names, before)))
        state = map_texts(
            state, text, [*through, *before], _RESULT if after is None else _STATE,
            _search(spark.sparkContext.broadcast(block), uuid.uuid4().hex, window, before, after is None),
        )
        block, first = after, False
    return state.select(*[F.col(f"`{c}`") for c in wanted], *_RESULT.names)


def keep_clean(docs: DataFrame, items: DataFrame, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any window of an item, with their own columns."""
    names = {c: f"__own_{c}" for c in docs.columns}
    found = find_contamination(docs.withColumnsRenamed(names), items, text=names[text], window=window)
    return found.filter("n_hit = 0").select(*[F.col(f"`{o}`").alias(c) for c, o in names.items()])


def _search(shared: Broadcast, name: str, window: int, before: list[str], last: bool):
    def make():
        searchers = _searchers(name, shared, window)

        def work(texts: list[bytes], batch: pa.RecordBatch) -> list[list]:
            earlier = [batch.column(c).to_pylist() for c in before] or [[None] * len(texts)] * 2
            out = []
            for raw, bits, ids in zip(texts, *earlier):
                words, found = folded_words(raw), set(ids or ())
                hit = np.zeros(len(words), np.bool_)
                if bits:
                    hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).view(np.bool_)
                for s in searchers:
                    for at, names in s.search(words):
                        hit[at:at + s.m] = True
                        found |= names
                if last:
                    out.append((len(words), int(hit.sum()), _runs(hit), sorted(found)))
                else:
                    out.append((np.packbits(hit).tobytes(), sorted(found)))
            return list(map(list, zip(*out)))

        return work

    return make


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
