"""Quality rules whose cutoffs are risk-controlled.

A rule rejects a document if one of its measures is above a cutoff. The base rule is fixed:
too few words, or too many words in repeated windows. For every other rule the cutoff is the
strictest of a grid that provably rejects few good documents: among the labelled good
documents of a stratum (a language), the exact binomial probability of seeing so few
rejections, if the true rate were the allowed one, must be below the error level. Cutoffs of
one rule are tested from the loosest on (a fixed sequence, nested events, needs no further
correction); the error level is divided by the number of rules times strata (Bonferroni), and
the allowed rate by the number of rules, so that with probability 1 - `error` in every stratum
all rules together falsely reject at most `false_rejection` of the good documents. A stratum
with too few labels to prove anything gets no cutoff and keeps its documents.

All measures are array expressions over the row's own words: sorted window hashes find
candidates, sorted windows confirm them, nothing is shuffled. Only the counts per stratum are
aggregated, over all labelled documents.

Defined cases: a null text has no words (and fails the base rule); a null language is a
stratum of its own; documents without label, or with a null label, do not calibrate; a
document labelled more than once counts once per label row; repeated rows are judged alike;
without labels only the base rule holds. Columns of the input that are named like a measure
are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from presswire.llm.common import WHITE_SPACE, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
FALSE_REJECTION = 0.02
ERROR = 0.05

#: Candidate cutoffs of each rule, loosest last; a document above the cutoff is rejected.
GRID: dict[str, list[float]] = {
    "symbol_rate": [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0],
    "dup_line_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeat_rate": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "caps_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "bang_rate": [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows_found_twice(words: Column, hashes: Column) -> tuple[Column, Column]:
    """Sorted hashes, and from them (as `__packed`) words and start of the three-word windows whose
    hash occurs more than once, in order of the words.

    Sorting 32 bits of hash with the start brings windows that may be equal together; the
    words themselves decide among those.
    """
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, 32).bitwiseOR(i.cast("long"))))

    def close(x: Column, j: Column, by: int) -> Column:
        other = F.get(F.col("__packed"), j + by)
        return F.coalesce(F.shiftright(other, 32) == F.shiftright(x, 32), F.lit(False))

    may = F.filter("__packed", lambda x, j: close(x, j, -1) | close(x, j, 1))
    at = F.transform(may, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    windows = F.transform(at, lambda i: F.struct(
        F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))
    return packed, F.sort_array(windows)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the base measures, the rule rates and base_failed."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = [*MEASURES, *GRID, "base_failed"]
    split = docs.drop(*own).withColumn("__words", F.array_remove(F.split(body, WHITE_SPACE), ""))
    hashed = split.withColumn("__hashes", F.slice(
        F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))),
        F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))))
    packed, found_twice = _windows_found_twice(F.col("__words"), F.col("__hashes"))
    # most texts repeat no hash and are done here
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    sorted_windows = (
        hashed.withColumn("__packed", F.when(repeats, packed)).drop("__hashes")
        .withColumn("__windows", F.when(F.col("__packed").isNotNull(), found_twice)).drop("__packed")
    )
    windows = F.col("__windows")

    def same(x: Column, j: Column, by: int) -> Column:
        other = F.get(windows, j + by)
        return F.coalesce((other["a"] == x["a"]) & (other["b"] == x["b"]) & (other["c"] == x["c"]), F.lit(False))

    starts = F.sort_array(F.transform(
        F.filter(windows, lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"]))
    # windows in order: each covers the words that the one before did not
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("before"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("before"), (acc["n"] + F.least(F.lit(3), i - acc["before"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    # one pass over the text leaves only the characters that are counted
    prepared = sorted_windows.withColumns({
        "__lines": F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "__marks": F.regexp_replace(body, r"[^A-Z!#*$%&|<>]+", ""),
    })
    marks, bare = F.col("__marks"), F.col("__bare")
    measured = prepared.withColumn("__bare", F.regexp_replace(marks, r"[#*$%&|<>]+", "")).withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(marks) - F.length(bare)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.size("__windows") > 0, covered).otherwise(F.lit(0)).cast("long"),
        "__n_lines": F.size("__lines"),
        "__n_caps": F.length(F.replace(bare, F.lit("!"), F.lit(""))),
        "__n_bangs": F.length(bare) - F.length(F.replace(bare, F.lit("!"), F.lit(""))),
    })
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rated = measured.withColumns({
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col("n_repeat_words") / words,
        "caps_rate": F.col("__n_caps") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "bang_rate": F.col("__n_bangs") / words,
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    })
    # a one-element generator keeps later filters above: pushed below, they would repeat the measures
    own_columns = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return rated.select(*own_columns, F.explode(F.array(F.struct(*own))).alias("__m")).select(*own_columns, "__m.*")


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) of a binomial, summed term by term in logarithms (k < n p is all that matters here)."""
    odds = math.log(p) - math.log1p(-p)
    first = n.cast("double") * math.log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        low, high = F.least(acc["total"], term), F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: acc["total"])


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    stratum: str = "lang",
    good: Column | None = None,
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
    grid: dict[str, list[float]] | None = None,
) -> DataFrame:
    """One row per stratum: its cutoff of every rule, null where none is proven safe."""
    grid = GRID if grid is None else grid
    good = F.col("quality") == 1 if good is None else good
    known = labels.filter(good).select(F.col("doc_id").alias("__labelled"))
    held = (
        measured.filter(~F.col("base_failed"))
        .select(F.col(f"`{doc_id}`").alias("__doc"), F.col(f"`{stratum}`").alias("stratum"), *grid)
        .join(known, F.col("__doc") == F.col("__labelled"))
    )
    tries = [(rule, c) for rule, cs in grid.items() for c in cs]
    # a row per stratum, used three times below: the texts are measured once for it
    counts = written(held.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.col(rule) > c, True)).alias(f"__{i}") for i, (rule, c) in enumerate(tries)],
    ), "stratum-counts")
    long = counts.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"__{i}").alias("rejected"))
        for i, (rule, c) in enumerate(tries)])).alias("t")).select("stratum", "n", "t.*")
    allowed = false_rejection / len(grid)
    strata = counts.agg(F.count("*").alias("strata"))
    # a count at or above the allowed share can't pass, so the sum stays short
    few = F.col("rejected") < F.col("n") * allowed
    passed = long.join(F.broadcast(strata)).filter(few).filter(
        log_binomial_cdf(F.col("rejected"), F.col("n"), allowed)
        <= F.log(F.lit(error / len(grid)) / F.col("strata")))
    return counts.select("stratum").join(
        passed.groupBy(F.col("stratum").alias("of")).agg(
            *[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in grid]),
        F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")


def judged(measured: DataFrame, cuts: DataFrame, *, stratum: str = "lang", grid=None) -> DataFrame:
    """`measured` plus kept: false if the base rule or any proven cutoff rejects the document."""
    grid = GRID if grid is None else grid
    above = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False)) for rule in grid])
    named = cuts.withColumnRenamed("stratum", "__stratum")
    return (
        measured.drop("kept").join(named, F.col(f"`{stratum}`").eqNullSafe(F.col("__stratum")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~above)
        .drop("__stratum", *[f"cut_{r}" for r in grid])
    )


def score_documents(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                    stratum: str = "lang") -> DataFrame:
    """Measures and verdict of every document, without its text; measured once."""
    narrow = written(
        with_measures(docs.select(*[F.col(f"`{c}`") for c in (doc_id, stratum, text)]), text).drop(text), "measures")
    cuts = written(cutoffs(narrow, labels, doc_id=doc_id, stratum=stratum), "cutoffs")
    return judged(narrow, cuts, stratum=stratum)


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
              stratum: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns.

    Calibration and verdict each measure the texts, so that no text is shuffled.
    """
    measured = with_measures(docs.select(*[F.col(f"`{c}`") for c in (doc_id, stratum, text)]), text).drop(text)
    cuts = written(cutoffs(measured, labels, doc_id=doc_id, stratum=stratum), "cutoffs")
    renamed = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns}).withColumns(
        {text: F.col(f"`__own_{text}`"), stratum: F.col(f"`__own_{stratum}`")})
    kept = judged(with_measures(renamed, text), cuts, stratum=stratum).filter("kept")
    return kept.select(*[F.col(f"`__own_{c}`").alias(c) for c in docs.columns])
