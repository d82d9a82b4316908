"""Exact top-k by inner product: a Voronoi join of queries and data.

Pivots cut the space into cells. A narrow summary of each cell (rows, radius, norms, distances of the
rows closest to its pivot) bounds the k-th best score of every query from below and the scores that
a cell can hold from above: 2 q.x = |q|^2 + |x|^2 - |q - x|^2, where the triangle inequality and the
plane between two pivots bound the distance. Queries of neighbouring cells form groups; a row is
copied to the groups that need its cell, dealt to blocks there, and each block is solved by one
matrix product. What is left to merge is k rows per query and block.

Bounds: at most `pivots` cells, so pivots and summary stay small whatever the data; groups hold
`GROUP_QUERIES` queries and blocks about `BLOCK_ROWS` rows, also in a cell with a third of all rows.
On data without clusters the bounds exclude little, and all rows meet all queries, block by block.

Defined cases: components are floor(scale * x) as doubles, scores exact integers (held at the ends of
64 bits beyond them); vectors that are null or hold null, non-finite or overflowing components take no
part; shorter vectors are filled up with zeros; a row without id is a candidate (last among ties) but
no query; rows are told apart as rows, so repeated ids and repeated rows are candidates of each other
and queries of their own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from presswire.llm.common import written
from presswire.session import ship_package

SCALE = 64.0
TOP = 20
#: Cells at most; the square root of the rows below that.
PIVOTS = 1024
GROUP_QUERIES = 2048
BLOCK_ROWS = 32_768
#: Rows below which a block is not cut further to give every core one.
SMALL_BLOCK = 256
#: Entries of a score matrix, and of the table of bounds, worked on at once.
MATRIX = 4 << 20
#: Floats round; bounds are widened by this share of the numbers they come from.
SLACK = 1e-6
EXACT = 2.0**53


def _units(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), filled up to `width`."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _usable(vector: str, scale: float) -> Column:
    most = 1.7e308 / max(abs(scale), 1.0)
    return F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= most))


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows to all pivots; not a number where the arithmetic overflows."""
    with np.errstate(over="ignore", invalid="ignore"):
        squared = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * rows @ pivots.T
        return np.sqrt(np.maximum(squared, 0))


def _cells(pivots: np.ndarray, scale: float) -> Callable:
    width = pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.slice(a, 2048)
                rows = _units(part.column("vector"), width, scale)
                away = _distances(rows, pivots)
                cell = np.nan_to_num(away, nan=np.inf).argmin(1)
                with np.errstate(over="ignore"):
                    squared = (rows * rows).sum(1)
                offsets = np.arange(0, rows.size + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(rows))), part.column("vec_id"), part.column("query"),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1))),
                     pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(rows)), cell]), pa.array(squared)],
                    names=["row", "vec_id", "query", "units", "cell", "away", "squared"])
                row += len(rows)

    return assign


def assigned(vectors: DataFrame, is_query: Column, scale: float = SCALE, pivots: int = PIVOTS,
             vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Usable vectors with their cells, written once so that row numbers stay, and the pivots."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.filter(_usable(f"`{vector}`", scale)).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.coalesce(is_query & F.col(f"`{vec_id}`").isNotNull(), F.lit(False)).alias("query"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    count, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    wanted = min(pivots, max(1, math.isqrt(count)))
    # a fixed choice of rows by hash; twice as many, since hot vectors may repeat
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(2 * wanted).select("vector").collect()
    chosen = np.zeros((max(len(sample), 1), max(width or 0, 1)))
    for at, (values,) in enumerate(sample):
        chosen[at, :len(values)] = np.floor(scale * np.asarray(values, dtype=np.float64))
    chosen = np.unique(chosen, axis=0)
    chosen = chosen[np.random.default_rng(0).permutation(len(chosen))[:wanted]]
    cells = rows.mapInArrow(
        _cells(chosen, scale),
        "row long, vec_id long, query boolean, units array<double>, cell int, away double, squared double")
    return written(cells, "vector-cells"), chosen


class Summary:
    """What is known of each cell: bounded by the number of pivots times `k`."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, k: int) -> None:
        n = len(pivots)
        self.pivots, self.k = pivots, k
        self.rows, self.queries = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.radius, self.low, self.high = np.zeros(n), np.zeros(n), np.zeros(n)
        #: distances of the rows closest to the pivot; one more than k, for a query does not find itself
        self.closest = np.full((n, k + 1), np.inf)
        for r in rows.groupBy("cell").agg(
                F.count("*").alias("n"), F.count_if("query").alias("queries"), F.max("away").alias("radius"),
                F.min("squared").alias("low"), F.max("squared").alias("high")).collect():
            at = r["cell"]
            self.rows[at], self.queries[at] = r["n"], r["queries"]
            self.radius[at], self.low[at], self.high[at] = r["radius"], r["low"], r["high"]
        near = Window.partitionBy("cell").orderBy("away")
        for r in rows.select("cell", "away").withColumn("at", F.row_number().over(near)).filter(
                F.col("at") <= k + 1).collect():
            self.closest[r["cell"], r["at"] - 1] = r["away"]
        self.between = _distances(pivots, pivots)

    def query_groups(self) -> list[tuple[int, int, int]]:
        """(cell, first group, number of groups): neighbouring cells share groups, large ones have several."""
        left, chain = set(range(len(self.pivots))), []
        at = 0
        while left:  # each cell is followed by the closest one that is left
            left.discard(at)
            chain.append(at)
            if left:
                rest = np.fromiter(left, int)
                at = int(rest[np.nan_to_num(self.between[at, rest], nan=np.inf).argmin()])
        groups, group, held = [], 0, 0
        for cell in chain:
            n = int(self.queries[cell])
            if held and held + n > GROUP_QUERIES:
                group, held = group + 1, 0
            parts = max(1, math.ceil(n / GROUP_QUERIES))
            groups.append((cell, group, parts))
            held += n
            if parts > 1:
                group, held = group + parts, 0
        return groups

    def needed(self, units: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which cells may hold one of the k best rows of each query."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            own = (units * units).sum(1)[:, None]
            away = _distances(units, self.pivots)
            sure = own[:, :, None] + self.low[:, None] - (away[:, :, None] + self.closest) ** 2
            sure = np.where(np.isfinite(self.closest), sure / 2, -np.inf).reshape(len(units), -1)
            bar = np.partition(sure, -(self.k + 1), axis=1)[:, -(self.k + 1)][:, None]
            home = away[np.arange(len(units)), cell][:, None]
            plane = (away * away - home * home) / (2 * self.between[cell])
            least = np.maximum(np.maximum(away - self.radius, np.nan_to_num(plane, nan=0.0, posinf=0.0)), 0)
            most = (own + self.high - least * least) / 2
            slack = SLACK * (own + self.high + away * away + 1)
            # comparisons with what is not a number leave a cell in
            return ~(most + slack < bar) & (self.rows > 0)


def _needs(summary: Summary) -> Callable:
    step = max(1, MATRIX // (summary.closest.size or 1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            width = summary.pivots.shape[1]
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                units = part.column("units").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                need = summary.needed(units, part.column("cell").to_numpy())
                group = part.column("group").to_numpy()
                for g in np.unique(group):
                    found.update((int(g), int(c)) for c in np.flatnonzero(need[group == g].any(axis=0)))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in pairs], pa.int64()), pa.array([c for _, c in pairs], pa.int32())],
                names=["group", "cell"])

    return find


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products, exact: as floats while every sum fits one, else in whole numbers."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(data.shape[1], 1)
    if most < EXACT:
        return (queries @ data.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(queries).astype(object) @ whole(data).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _solver(k: int) -> Callable:
    def solve(data: pa.Table, queries: pa.Table) -> pa.Table:
        known = data.column("vec_id").combine_chunks()
        order = np.lexsort((known.fill_null(0).to_numpy(zero_copy_only=False),
                            known.is_null().to_numpy(zero_copy_only=False)))
        rows = data.column("row").to_numpy()[order]
        by_row = np.argsort(rows)
        width = len(data.column("units")[0]) if len(data) else 1

        def matrix(units: pa.ChunkedArray) -> np.ndarray:
            return units.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

        held = matrix(data.column("units"))[order]
        asked, q_row = matrix(queries.column("q_units")), queries.column("asked").to_numpy()
        at, best, whose = [], [], []
        step = max(1, MATRIX // max(len(rows), 1))
        for a in range(0, len(asked) if len(rows) else 0, step):
            scores = _scores(asked[a:a + step], held)
            mine = q_row[a:a + step]
            place = by_row[np.searchsorted(rows, mine, sorter=by_row).clip(max=len(rows) - 1)]
            for i, s in enumerate(scores):
                candidates = np.arange(len(s))
                if len(s) > k + 1:  # rows of equal score are told apart by their order, which is that of the ids
                    candidates = np.flatnonzero(s >= np.partition(s, -(k + 1))[-(k + 1)])
                if rows[place[i]] == mine[i]:
                    candidates = candidates[candidates != place[i]]
                # ~ turns the order around without overflow
                top = candidates[np.argsort(~s[candidates], kind="stable")[:k]]
                at.append(top)
                best.append(s[top])
                whose.append(np.full(len(top), a + i))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        whose, found = join(whose), order[join(at)] if at else np.zeros(0, np.int64)
        return pa.table({
            "asked": pa.array(q_row[whose]), "query_id": queries.column("query_id").take(pa.array(whose)),
            "vec_id": known.take(pa.array(found)), "score": pa.array(join(best), pa.int64())})

    return solve


def needed_cells(rows: DataFrame, summary: Summary) -> tuple[DataFrame, DataFrame]:
    """The queries with their groups, and the (group, cell) pairs that cannot be ruled out."""
    spark = rows.sparkSession
    groups = spark.createDataFrame(summary.query_groups(), "cell int, first int, parts int")
    queries = rows.filter("query").join(groups, "cell").withColumn(
        "group", F.expr("first + pmod(xxhash64(row), parts)"))
    pairs = queries.select("units", "cell", "group").mapInArrow(_needs(summary), "group long, cell int").distinct()
    return queries, written(pairs, "needed-cells")


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: float = SCALE, pivots: int = PIVOTS,
          vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The `k` rows of highest inner product for every row that `is_query` marks, itself left out.

    Columns: query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows, chosen = assigned(vectors, is_query, scale, pivots, vec_id, vector)
    summary = Summary(rows, chosen, k)
    queries, pairs = needed_cells(rows, summary)
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(summary.rows)], "cell int, n long")
    # as many blocks as their size asks for, and enough for every core unless they were tiny
    n_groups = 1 + max((first + parts - 1 for _, first, parts in summary.query_groups()), default=0)
    wanted = math.ceil(4 * spark.sparkContext.defaultParallelism / n_groups)
    blocks = pairs.join(sizes, "cell").groupBy("group").agg(F.sum("n").alias("n")).select(
        "group", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS),
                            F.least(F.lit(wanted), F.ceil(F.col("n") / SMALL_BLOCK))).cast("int").alias("blocks"))
    blocks = written(blocks, "vector-blocks")
    data = rows.join(pairs.join(blocks, "group"), "cell").select(
        "group", F.expr("pmod(xxhash64(row, 1), blocks)").cast("int").alias("block"), "row", "vec_id", "units")
    asked = queries.join(blocks, "group").select(
        F.col("group").alias("q_group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"),
        F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("units").alias("q_units"))
    found = data.groupBy("group", "block").cogroup(asked.groupBy("q_group", "q_block")).applyInArrow(
        _solver(k), "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
