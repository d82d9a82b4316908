"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A text, its spaces written as the space mark and one put before it, is cut in front of every
space mark (no piece crosses such a place). The distinct cuts of a batch are concatenated and
their suffixes sorted; a binary search of every piece gives the range of its occurrences, all of
them edges of the lattice. The edges are sorted by end position, the longest first, and relaxed
in that order for all cuts at once: an edge is taken if its piece may follow the piece that ends
where it starts. Two pieces may stand side by side if undoing their merges, the latest first,
never meets a pair at the seam that would have been merged before; exactly one edge into every
position passes, and the path through these edges is the encoding that merging in order of score
gives. Characters without a piece separate the lattice and become byte pieces. Cuts with several
space marks hold pieces of equal score, where the place decides; they are merged one by one.

A worker remembers the ids of the cuts it has seen (bounded). Texts never leave their partition.

Defined cases: null and empty texts have no ids; a space mark in a text is a space (as the
library treats it), so `round_trip` compares with that replaced; repeated rows repeat their
result; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from presswire.llm.common import map_texts
from presswire.session import ship_package

MARK = "▁"
REMEMBERED = 600_000
BATCH_CHARS = 200_000
#: Characters whose cuts are held at once.
GROUP_CHARS = 1 << 20
NONE = np.int64(1 << 40)


class PieceModel:
    """Pieces of a model file, with what is needed to tell which may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        n = source.get_piece_size()
        self.pieces = [source.id_to_piece(i) for i in range(n)]
        special = [source.is_control(i) or source.is_unknown(i) or source.is_unused(i) for i in range(n)]
        self.byte_id = np.full(256, source.unk_id(), np.int64)
        normal = []
        for i, piece in enumerate(self.pieces):
            if source.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not special[i]:
                normal.append(i)
        self.output = [
            bytes([int(p[3:5], 16)]) if source.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.id_of = {self.pieces[i]: i for i in normal}
        self.score = [source.get_score(i) for i in range(n)]
        # merge order: single characters stand from the start, then by falling score
        self.rank = np.zeros(n, np.int64)
        longer = sorted((i for i in normal if len(self.pieces[i]) > 1), key=lambda i: (-self.score[i], i))
        self.rank[longer] = np.arange(1, len(longer) + 1)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        own = []
        for i in longer:
            if MARK in self.pieces[i][1:]:
                continue  # runs of space marks
            split = self._last_merge(self.pieces[i])
            if split is not None:
                self.left[i], self.right[i] = split
                own.append(i)
        own_set = {*own, *(i for i in normal if len(self.pieces[i]) == 1)}
        self.reachable = np.array(sorted(own_set), np.int64)
        pairs = {}
        for i in own:
            text = self.pieces[i]
            for k in range(1, len(text)):
                a, b = self.id_of.get(text[:k]), self.id_of.get(text[k:])
                if a in own_set and b in own_set:
                    pairs[a << 32 | b] = self.rank[i]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_rank = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.letters = {c for i in self.reachable.tolist() if self.length[i] == 1 for c in self.pieces[i]}
        self.longest = int(self.length[self.reachable].max())
        self.letters_of = np.zeros((len(self.reachable), self.longest), np.uint32)
        for row, i in zip(self.letters_of, self.reachable.tolist()):
            row[:self.length[i]] = [ord(c) for c in self.pieces[i]]

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        parts = self.merge(text, stop=2)
        if len(parts) == 2 and all(p in self.id_of for p in parts):
            return self.id_of[parts[0]], self.id_of[parts[1]]
        return None

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Merges the best-scored neighbours, the first of equals, until none or `stop` parts are left."""
        parts: list[str | None] = list(text)
        n = left = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            piece = self.id_of.get(parts[i] + parts[j]) if j < n else None
            if piece is not None:
                heapq.heappush(heap, (-self.score[piece], i, j, len(parts[i]) + len(parts[j])))

        for i in range(n):
            offer(i)
        while heap and left > stop:
            _, i, j, size = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i], parts[j], left = parts[i] + parts[j], None, left - 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def side_by_side(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each second piece may follow each first one (-1: nothing before)."""
        ok = np.ones(len(first), np.bool_)
        at = np.flatnonzero(first >= 0)
        a, b, limit = first[at], second[at], np.full(len(at), NONE)
        while len(at):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = np.where(self.pair_keys[place] == key, self.pair_rank[place], NONE)
            clash = merged < limit
            ok[at[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            more = ~clash & ((ra > 0) | (rb > 0))
            at, a, b, ra, rb = at[more], a[more], b[more], ra[more], rb[more]
            undo_first = ra > rb
            limit = np.where(undo_first, ra, rb + 1)
            a, b = np.where(undo_first, self.right[a], a), np.where(undo_first, b, self.left[b])
        return ok


class SuffixMatcher:
    """Encodes batches of cuts."""

    def __init__(self, model: PieceModel):
        self.model = model

    def encode(self, cuts: list[str]) -> list[np.ndarray]:
        """Ids of every cut."""
        m, text = self.model, "\0".join(cuts) + "\0"
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes, width, of_pieces = self._codes(chars)
        inside = codes > 0
        tokens, ends = self._path(codes, inside, width, of_pieces)
        # characters without a piece, as bytes
        stray = np.flatnonzero(~inside & (chars != 0))
        where, ids = [ends - 1], [tokens]
        for i in stray.tolist():
            raw = np.frombuffer(text[i].encode("utf-8", "surrogatepass"), np.uint8)
            ids.append(m.byte_id[raw])
            where.append(np.full(len(raw), i))
        where, ids = np.concatenate(where), np.concatenate(ids)
        order = np.argsort(where, kind="stable")
        where, ids = where[order], ids[order]
        stops = np.searchsorted(where, np.flatnonzero(chars == 0))
        return np.split(ids, stops[:-1])

    def _codes(self, chars: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """Small numbers for the characters that have a piece, 0 for the others: of the text, their
        width in bits, and of the characters of every piece."""
        m = self.model
        present, where = np.unique(chars, return_inverse=True)
        known = np.array([chr(c) in m.letters for c in present.tolist()], np.bool_)
        number = np.zeros(len(present), np.uint64)
        number[known] = np.arange(1, np.count_nonzero(known) + 1)
        at = np.minimum(np.searchsorted(present, m.letters_of), len(present) - 1)
        of_pieces = np.where(present[at] == m.letters_of, number[at], np.uint64(0))
        return number[where], 8 if np.count_nonzero(known) < 256 else 16, of_pieces

    def _keys(self, codes: np.ndarray, width: int) -> list[np.ndarray]:
        """The next `longest` codes from every place, packed into 64-bit numbers."""
        n, per = len(codes), 64 // width
        count = -(-self.model.longest // per)
        padded = np.append(codes, np.zeros(count * per, np.uint64))
        out = []
        for j in range(count):
            key = np.zeros(n, np.uint64)
            for t in range(per):
                key = (key << np.uint64(width)) | padded[j * per + t:j * per + t + n]
            out.append(key)
        return out

    def _edges(self, codes, inside, width, of_pieces) -> tuple[np.ndarray, np.ndarray]:
        """(piece, start) of every occurrence: a range of the suffix array per piece."""
        m, per = self.model, 64 // width
        suffixes = np.flatnonzero(inside)
        keys = [k[suffixes] for k in self._keys(codes, width)]
        order = np.argsort(keys[-1], kind="stable")
        for k in reversed(keys[:-1]):
            order = order[np.argsort(k[order], kind="stable")]
        suffixes, keys = suffixes[order], [k[order] for k in keys]
        # pieces whose characters all occur, as the least and greatest keys that begin with them
        within = np.arange(m.letters_of.shape[1]) < m.length[m.reachable][:, None]
        whole = ((of_pieces > 0) | ~within).all(axis=1)
        names, letters, within = m.reachable[whole], of_pieces[whole], within[whole]
        low = np.zeros((len(keys), len(names)), np.uint64)
        high = np.zeros((len(keys), len(names)), np.uint64)
        full = np.uint64((1 << width) - 1)
        for j in range(len(keys)):
            for t in range(j * per, (j + 1) * per):
                low[j] <<= np.uint64(width)
                high[j] <<= np.uint64(width)
                if t < letters.shape[1]:
                    low[j] |= letters[:, t]
                    high[j] |= np.where(within[:, t], letters[:, t], full)
                else:
                    high[j] |= full
        start = np.searchsorted(keys[0], low[0], "left")
        stop = np.searchsorted(keys[0], high[0], "right")
        for i in np.flatnonzero((m.length[names] > per) & (stop > start)):
            a, b = int(start[i]), int(stop[i])
            for j in range(1, -(-int(m.length[names[i]]) // per)):
                part = keys[j][a:b]
                a, b = a + int(np.searchsorted(part, low[j, i], "left")), a + int(np.searchsorted(part, high[j, i], "right"))
            start[i], stop[i] = a, b
        size = stop - start
        first = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size)
        return np.repeat(names, size), suffixes[first + np.arange(size.sum())]

    def _path(self, codes, inside, width, of_pieces) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the encoding and the places where they end."""
        m, n = self.model, len(codes)
        piece, start = self._edges(codes, inside, width, of_pieces)
        end = start + m.length[piece]
        order = np.argsort(end * 64 + (63 - np.minimum(m.length[piece], 63)))
        piece, start, end = piece[order], start[order], end[order]
        first = np.searchsorted(end, np.arange(n + 1))
        # runs of characters that have pieces, longest first
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = stop - begin
        by_size = np.argsort(-size, kind="stable")
        begin, stop, size = begin[by_size], stop[by_size], size[by_size]
        last = np.full(n + 1, -1, np.int64)
        for d in range(1, int(size[0]) + 1 if len(size) else 1):
            here = begin[:np.searchsorted(-size, -d, "right")] + d
            at = first[here]
            while len(here):
                fits = m.side_by_side(last[start[at]], piece[at])
                last[here[fits]] = piece[at[fits]]
                here, at = here[~fits], at[~fits] + 1
        taken = np.zeros(n + 1, np.bool_)
        here, low = stop, begin
        while len(here):
            taken[here] = True
            here = here - m.length[last[here]]
            here, low = here[here > low], low[here > low]
        ends = np.flatnonzero(taken)
        return last[ends], ends


class PieceCodec:
    """Texts to ids and back, in a worker."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.matcher = SuffixMatcher(self.model)
        self.kind = np.dtype("<u2") if len(self.model.pieces) <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}

    def _learn(self, cuts: set[str]) -> None:
        new = sorted(c for c in cuts if c not in self.known)
        runs = [c for c in new if MARK in c[1:]]
        for c in runs:
            self.known[c] = self._merged(c)
        new = [c for c in new if MARK not in c[1:]]
        a = 0
        while a < len(new):
            b, held = a, 0
            while b < len(new) and (b == a or held + len(new[b]) < BATCH_CHARS):
                held += len(new[b]) + 1
                b += 1
            # a null character is the separator and has no piece: such cuts are done by themselves
            plain = [c for c in new[a:b] if "\0" not in c]
            for c, ids in zip(plain, self.matcher.encode(plain) if plain else []):
                self.known[c] = ids.astype(self.kind).tobytes()
            for c in new[a:b]:
                if "\0" in c:
                    self.known[c] = self._merged(c)
            a = b

    def _merged(self, cut: str) -> bytes:
        """Ids of a cut by merging; the characters after the space marks join in as far as pieces reach."""
        m, ids = self.model, []
        for run in re.split(r"(\0)", cut):
            for part in m.merge(run):
                known = m.id_of.get(part)
                ids += [known] if known is not None else m.byte_id[list(part.encode("utf-8", "surrogatepass"))].tolist()
        return np.array(ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; the cuts of a group of texts are held at once, not those of all."""
        out, group, held = [], [], 0
        for t in texts:
            if group and held + len(t) > GROUP_CHARS:
                out += self._encode(group)
                group, held = [], 0
            group.append(t)
            held += len(t)
        return out + self._encode(group) if group else out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = []
        for t in texts:
            parts = t.replace(MARK, " ").split(" ")
            if not t:
                cuts.append([])
            elif "" in parts:
                cuts.append(re.findall(f"{MARK}+[^{MARK}]*", MARK + MARK.join(parts)))
            else:
                cuts.append([MARK + p for p in parts])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(set().union(*cuts))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), self.kind) for c in cuts]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.model.output.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One per worker process, so that what it remembers serves all tasks."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DIGEST = T.StructType([
    T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("n_decoded", T.LongType()), T.StructField("round_trip", T.BooleanType()),
])


def encode_texts(docs: DataFrame, *, model: str, text: str = "text", keep: list[str], with_ids: bool = True) -> DataFrame:
    """`keep` columns, ids (if wanted), n_ids, ids_crc32 (of the ids as little-endian 32-bit numbers),
    n_decoded (characters of the ids decoded again) and round_trip (whether they are the text)."""

    def make():
        work_on = codec(model)

        def work(texts: list[bytes], _) -> list:
            plain = [t.decode("utf-8") for t in texts]
            ids = work_on.encode(plain)
            back = [work_on.decode(x.tolist()) for x in ids]
            digest = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([len(t) for t in back], pa.int64()),
                pa.array([b == t.replace(MARK, " ") for b, t in zip(back, plain)], pa.bool_()),
            ]
            if not with_ids:
                return digest
            ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *digest]

        return work

    fields = T.StructType([IDS, *DIGEST]) if with_ids else DIGEST
    return map_texts(docs, text, keep, fields, make)


def decode_ids(rows: DataFrame, *, model: str, ids: str = "ids", keep: list[str]) -> DataFrame:
    """`keep` columns and the text of an array of ids; null ids give a null text."""
    schema = T.StructType([*[rows.schema[c] for c in keep if c != "text"], T.StructField("text", T.StringType())])
    kept = [f.name for f in schema][:-1]

    def run(batches):
        work_on = codec(model)
        for batch in batches:
            texts = [None if x is None else work_on.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    ship_package(rows.sparkSession)
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)
