"""How the sources of a language differ in their vocabulary.

Tokenizer: one `bytes.translate` lower-cases A-Z and blanks every separator, `bytes.split` gives the
terms (runs of letters and non-ASCII characters), a `Counter` per document their frequencies. Tasks
add the counters up per (lang, source) in dictionaries of bounded size and hand on sparse rows.

Divergence: with a term's probability smoothed and scaled to a whole number, source p against q has
the sum over terms of floor((p - q)^2 / q), all in exact integers. Only terms that a source has are
stored; the others share one value per source and enter by their number.

Defined cases: null text, lang and source are empty strings; a repeated row counts again, also as a
document of its own; a language without kept terms has pairs of value 0; ties go to the smaller item
in UTF-8 order; an empty table gives no rows; other columns are ignored, whatever their names. A text of
any length is counted in slices. Sums of squares fit 64 bits up to 500 million kept terms a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from presswire.llm.common import pieces, written
from presswire.session import ship_package

#: Lower-cases A-Z and turns every other byte outside terms into a space.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200

#: Terms that a task holds before it hands them on, and bytes of one text that are split at once.
HELD_TERMS = 300_000
SPLIT_BYTES = 1 << 20
#: Rows of terms a group of the pairwise sums takes on average, and sources in a block of it.
GROUP_CELLS = 200_000
SOURCE_BLOCK = 256


def term_counter(text: bytes) -> Counter:
    """Frequencies of the terms of a UTF-8 text."""
    blank, found, at = text.translate(LETTERS), Counter(), 0
    while at < len(blank):
        cut = blank.find(b" ", at + SPLIT_BYTES)
        cut = len(blank) if cut < 0 else cut
        found.update(blank[at:cut].split())
        at = cut
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, dict] = defaultdict(lambda: defaultdict(int))
    holders: dict[tuple, Counter] = defaultdict(Counter)

    def handed_on():
        for (lang, source), terms in counts.items():
            docs = holders[lang, source]
            rows = list(terms)
            for a in range(0, len(rows), 50_000):
                part = rows[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.binary()), pa.array([terms[t] for t in part], pa.int64()),
                     pa.array([docs[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        holders.clear()

    for batch in batches:
        lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        raw = batch.column(2)
        for a, b in pieces(raw):
            for i, text in enumerate(raw.slice(a, b - a).to_pylist(), a):
                seen = term_counter(text)
                holders[lang[i], source[i]].update(seen.keys())
                held = counts[lang[i], source[i]]
                for term, n in seen.items():
                    held[term] += n
            if sum(map(len, counts.values())) > HELD_TERMS:
                yield from handed_on()
    yield from handed_on()


def _groups_of(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_cells(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source, term) of the terms that `min_docs` documents of the language have.

    `n` is the count in the source, `lang_n` in the language, `first` marks one row per term.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(*_groups_of(docs), text).mapInArrow(
        _counted, "lang string, source string, term binary, n long, docs long")
    # by source first: a frequent term then reaches its language with one row per source
    summed = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = summed.select(
        "lang", "source", F.col("term").cast("string").alias("term"), "n",
        F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"),
        (F.col("source") == F.min("source").over(term)).alias("first"))
    return marked.filter(F.col("lang_docs") >= min_docs).drop("lang_docs")


def _scaled(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); the product needs more than 64 bits."""
    return F.expr(f"1L + (cast({SCALE} as decimal(18,0)) * cast({n} + 1 as decimal(19,0)))"
                  f" div cast(greatest({total} + terms, 1L) as decimal(19,0))")


def _squares(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_groups(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Every occurring (lang, source) with its number in the language, its counts and those of the language."""
    held = cells.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count("*").alias("cells"), F.sum(F.col("first").cast("long")).alias("firsts"))
    lang = Window.partitionBy("lang")
    counted = docs.select(*_groups_of(docs)).distinct().join(held, ["lang", "source"], "left").fillna(
        0, ["total", "cells", "firsts"])
    return counted.select(
        "lang", "source", "total",
        (F.row_number().over(lang.orderBy("source")) - 1).alias("number"), F.count("*").over(lang).alias("sources"),
        F.sum("firsts").over(lang).alias("terms"), F.sum("total").over(lang).alias("lang_total"),
        F.ceil(F.sum("cells").over(lang) / GROUP_CELLS).alias("groups"),
    ).withColumn("groups", F.greatest("groups", F.lit(1))).withColumn("none", _scaled("0", "total"))


def _pair_sums(part: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of a group of how far each pair is above what two sources without the term give."""
    zero = part[part["term"].isna()].drop_duplicates("number").sort_values("number")
    numbers, z = zero["number"].to_numpy(), zero["p"].to_numpy()
    cells = part[part["term"].notna()]
    at, p = np.searchsorted(numbers, cells["number"].to_numpy()), cells["p"].to_numpy()
    term = pd.factorize(cells["term"])[0]
    n = len(z)

    def squares(p, q):
        return (p - q) * (p - q) // q

    none = squares(z[:, None], z[None, :])
    sums = np.zeros((n, n), dtype=np.int64)
    for s in range(n):  # terms of one side: few different values of p
        values, times = np.unique(p[at == s], return_counts=True)
        for a in range(0, len(values), 4096):
            u, k = values[a:a + 4096, None], times[a:a + 4096, None]
            sums[s, :] += (k * (squares(u, z[None, :]) - none[s])).sum(axis=0)
            sums[:, s] += (k * (squares(z[None, :], u) - none[:, s])).sum(axis=0)
    order = np.lexsort((at, term))
    term, at, p = term[order], at[order], p[order]
    flat, d = sums.reshape(-1), 1
    while True:  # terms of both sides: rows of one term that stand d apart
        i = np.flatnonzero(term[d:] == term[:-d]) if d < len(term) else ()
        if len(i) == 0:
            break
        for x, y in ((i, i + d), (i + d, i)):
            a, b = at[x], at[y]
            both = squares(p[x], p[y]) - squares(p[x], z[b]) - squares(z[a], p[y]) + none[a, b]
            np.add.at(flat, a * n + b, both)
        d += 1
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    lower, upper = part["low"].iloc[0], part["high"].iloc[0]
    if lower != upper:  # pairs within a block belong to its own group
        block = numbers // SOURCE_BLOCK
        across = block[a] != block[b]
        a, b = a[across], b[across]
    return pd.DataFrame({"lang": part["lang"].iloc[0], "number": numbers[a], "other": numbers[b], "value": sums[a, b]})


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of each source of a language from each other one."""
    blocks = F.expr(f"transform(sequence(0L, (sources - 1) div {SOURCE_BLOCK}), b -> "
                    f"struct(least(b, number div {SOURCE_BLOCK}) AS low, greatest(b, number div {SOURCE_BLOCK}) AS high))")
    held = cells.join(groups, ["lang", "source"]).select(
        "lang", F.expr("pmod(xxhash64(term), groups)").alias("part"), F.explode(blocks).alias("at"),
        F.col("number").cast("long").alias("number"), "term", _scaled("n", "total").alias("p"))
    absent = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(
        "lang", F.col("part").cast("long").alias("part"), F.explode(blocks).alias("at"),
        F.col("number").cast("long").alias("number"), F.lit(None).cast("string").alias("term"), F.col("none").alias("p"))
    rows = held.union(absent).select("lang", "part", "at.low", "at.high", "number", "term", "p")
    sums = rows.groupBy("lang", "part", "low", "high").applyInPandas(
        _pair_sums, "lang string, number long, other long, value long"
    ).groupBy("lang", "number", "other").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    one = groups.select("lang", "number", "source", F.col("none").alias("z"), "terms")
    two = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"), F.col("none").alias("y"))
    return sums.join(one, ["lang", "number"]).join(two, ["lang", "other"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.col("value") + F.col("terms").cast("decimal(19,0)") * _squares("z", "y")).cast("long").alias("value"))


def _terms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Kept terms that a source has more often than its language."""
    return cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _scaled("n", "total").alias("p"), _scaled("lang_n", "lang_total").alias("q"),
    ).filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _squares("p", "q").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Divergence of sources from each other (`pair`), and the terms that mark each source (`term`, the `top` ones).

    Columns: lang, source, part, item, value, rank. `docs` has text, lang and source.
    """
    cells = written(term_cells(docs, min_docs), "source-terms")
    groups = written(source_groups(docs, cells), "source-groups")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    marking = _terms(cells, groups).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return _pairs(cells, groups).withColumn("rank", F.row_number().over(order)).unionByName(marking)
