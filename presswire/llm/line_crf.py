"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. Its features are shares of symbols, upper case,
exclamation marks, digits and other characters, length, repetition within the line and of the
whole line, and the same of the line before and after; the chain adds weights for moving from one
label to the next. Forward and backward sums over the chain give each line's probability of being
good, and a document's score is their mean weighted by the lines' lengths.

The field is fitted on a bounded sample: labelled documents outside the held-out fold, in the
order of a hash of their id, whole documents until `sample_docs` of them or `sample_lines` lines
are reached; a line is trained with the label of its document. Features are worked out by the
tasks, so only numbers reach the driver. Scoring is one pass over the texts without a shuffle.

Defined cases: a null or empty text, or one without words, has the score of the prior (the share
of good documents in the sample, smoothed); a null doc_id is not held out; a null label, or one
without document, does not train; of several labels for one document each trains; without training
rows every score is the prior 0.5; repeated rows repeat their score; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from presswire.llm.common import map_texts, written

FOLD = (5, 0)
THRESHOLD = 0.3
SAMPLE_DOCS = 6000
SAMPLE_LINES = 150_000
ROUNDS = 250
RATE = 0.05
PENALTY = 1e-4

SYMBOLS = b"#*$%&|<>"
OWN = 10  # features of a line by itself; then those of the line before and after, and a constant
WIDTH = 3 * OWN + 1

_UPPER, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_PUNCTUATION = bytes(b for b in range(0x21, 0x80) if not chr(b).isalnum() and b not in SYMBOLS + b"!")


def lines_of(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line and not line.isspace()]


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN) features and the lines' lengths in bytes."""
    lines = lines_of(text)
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    rows, sizes = [], []
    for line in lines:
        n, words = len(line), line.split()
        count = len(words) or 1
        rows.append((
            n - len(line.translate(None, SYMBOLS)), n - len(line.translate(None, _UPPER)), line.count(b"!"),
            n - len(line.translate(None, _DIGITS)), n - len(line.translate(None, _PUNCTUATION)),
            n, count, len(set(words)), seen[line] > 1, len(line.translate(None, b" \t\r\x0b\x0c")),
        ))
        sizes.append(n)
    if not rows:
        return np.zeros((0, OWN), np.float32), np.zeros(0, np.float32)
    raw = np.array(rows, np.float64)
    n, count = raw[:, 5], raw[:, 6]
    out = np.stack([
        np.sqrt(raw[:, 0] / n), np.sqrt(raw[:, 1] / n), np.sqrt(raw[:, 2] / n), np.sqrt(raw[:, 3] / n),
        np.sqrt(raw[:, 4] / n), np.log1p(n) / 5, np.log1p(count) / 4,
        (1 - raw[:, 7] / count) * np.minimum(count / 8, 1), raw[:, 8], raw[:, 9] / count / 10,
    ], axis=1)
    return out.astype(np.float32), np.array(sizes, np.float32)


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its document (0 outside), and 1."""
    zero = np.zeros((1, OWN), np.float32)
    before, after = np.concatenate([zero, own[:-1]]), np.concatenate([own[1:], zero])
    before[starts] = 0
    after[np.append(starts[1:], len(own)) - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1)


@dataclass(frozen=True)
class LineField:
    weights: np.ndarray  # score of good against bad
    moves: np.ndarray  # (2, 2) from label to label; 1 is good
    prior: float


class Chains:
    """Documents of a batch side by side, so that one step serves all of them."""

    def __init__(self, sizes: np.ndarray):
        self.starts = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)
        full = np.flatnonzero(sizes)
        order = full[np.argsort(-sizes[full], kind="stable")]
        self.begin, self.size = self.starts[order], sizes[order]

    def _steps(self):
        for d in range(1, int(self.size[0]) if len(self.size) else 0):
            yield d, self.begin[:np.searchsorted(-self.size, -d, "left")] + d

    def marginals(self, good: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of good per line, expected moves, and the sum of log normalizers."""
        n = len(good)
        unary = np.stack([np.zeros(n), good], axis=1)
        forward, backward = unary.copy(), np.zeros((n, 2))
        steps = list(self._steps())
        for _, at in steps:
            forward[at] += np.logaddexp(forward[at - 1, :1] + moves[0], forward[at - 1, 1:] + moves[1])
        for _, at in reversed(steps):
            ahead = unary[at] + backward[at]
            backward[at - 1] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        both = forward + backward
        total = np.logaddexp(both[:, 0], both[:, 1])
        expected = np.zeros((2, 2))
        inner = np.concatenate([at for _, at in steps]) if steps else np.zeros(0, np.int64)
        for i in (0, 1):
            for j in (0, 1):
                expected[i, j] = np.exp(
                    forward[inner - 1, i] + moves[i, j] + unary[inner, j] + backward[inner, j] - total[inner]).sum()
        return np.exp(both[:, 1] - total), expected, float(total[self.begin].sum())


def fit(features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, prior: float) -> LineField:
    """Maximum likelihood with a quadratic penalty, by full-batch Adam."""
    chains = Chains(sizes)
    x = with_neighbours(features, chains.starts[sizes > 0])
    target = np.repeat(labels, sizes).astype(np.float64)
    inner = np.ones(len(target), np.bool_)
    inner[chains.starts[sizes > 0]] = False
    kept = np.zeros((2, 2))
    for j in (0, 1):
        kept[j, j] = np.count_nonzero(target[inner] == j)
    point, mean, square = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, ROUNDS + 1):
        moves = point[WIDTH:].reshape(2, 2)
        p, expected, _ = chains.marginals(x @ point[:WIDTH], moves)
        slope = np.append(x.T @ (target - p), (kept - expected).ravel()) / len(target) - PENALTY * point
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        point = point + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return LineField(point[:WIDTH], point[WIDTH:].reshape(2, 2), prior)


FEATURES = T.StructType([T.StructField("features", T.BinaryType()), T.StructField("n_lines", T.IntegerType())])


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", fold=FOLD,
          sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> LineField:
    """Fits the field on the sample; `labels` has doc_id and quality (1 good, 0 bad)."""
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("of"), F.col("quality"))
        .filter(~held_out("of", fold))
        .orderBy(F.xxhash64("of"), "of", "quality").limit(sample_docs)
    )
    sample = docs.select(F.col(f"`{doc_id}`").alias("of"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(known), "of")  # `sample_docs` short rows

    def make():
        def work(texts: list[bytes], _) -> list:
            made = [line_features(t)[0] for t in texts]
            return [[m.tobytes() for m in made], [len(m) for m in made]]

        return work

    rows = written(map_texts(sample, "text", ["of", "quality"], FEATURES, make), "crf-sample")
    features, sizes, targets = [], [], []
    for row in rows.orderBy(F.xxhash64("of"), "of", "quality").toLocalIterator():
        if sum(sizes) + row.n_lines > sample_lines and sizes:
            break
        features.append(np.frombuffer(row.features, np.float32).reshape(-1, OWN))
        sizes.append(row.n_lines)
        targets.append(row.quality)
    targets, sizes = np.array(targets, np.int64), np.array(sizes, np.int64)
    prior = float((targets.sum() + 1) / (len(targets) + 2))
    if not sizes.sum():
        return LineField(np.zeros(WIDTH), np.zeros((2, 2)), prior)
    return fit(np.concatenate(features), sizes, targets, prior)


SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_lines", T.LongType()),
                      T.StructField("n_bad_lines", T.LongType())])


def score_texts(docs: DataFrame, field: LineField, *, text: str = "text", keep: list[str]) -> DataFrame:
    """`keep` columns, score, number of lines and of those more likely bad than good."""

    def make():
        def work(texts: list[bytes], _) -> list:
            made = [line_features(t) for t in texts]
            sizes = np.array([len(s) for _, s in made], np.int64)
            score, bad = np.full(len(texts), field.prior), np.zeros(len(texts), np.int64)
            full = np.flatnonzero(sizes)
            if len(full):
                chains = Chains(sizes)
                starts = chains.starts[full]
                x = with_neighbours(np.concatenate([f for f, _ in made]), starts)
                p, _, _ = chains.marginals(x @ field.weights, field.moves)
                length = np.concatenate([s for _, s in made]).astype(np.float64)
                score[full] = np.add.reduceat(p * length, starts) / np.add.reduceat(length, starts)
                bad[full] = np.add.reduceat((p < 0.5).astype(np.int64), starts)
            return [pa.array(np.clip(score, 0, 1)), pa.array(sizes), pa.array(bad)]

        return work

    return map_texts(docs, text, keep, SCORE, make)


def held_out(doc_id: str = "doc_id", fold: tuple[int, int] = FOLD):
    """Whether crc32 of an id's text modulo fold[0] is fold[1]; a null id is not."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least `threshold`, with their own columns."""
    names = {c: f"__own_{c}" for c in docs.columns}
    scored = score_texts(docs.withColumnsRenamed(names), train(docs, labels, text=text), text=names[text],
                         keep=list(names.values()))
    return scored.filter(F.col("score") >= threshold).select(*[F.col(f"`{o}`").alias(c) for c, o in names.items()])
