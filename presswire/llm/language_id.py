"""Language of web pages by fusing evidence in Bayes' rule.

Evidence on a page: its visible text (byte trigrams, hashed to a fixed table, log-likelihoods
flattened by `temper` because neighbouring trigrams repeat each other), the language that its
markup declares, the suffix of its address, and its host. Trigram counts come from all documents
with a language. A first pass gives every page its posterior from text alone; grouped sums of
these soft counts then give P(declared | language), P(suffix | language), and host priors that
are smoothed hierarchically: all pages -> registered domain -> host, each level with
`strength` pseudo-pages of the one above. A page is left out of its own host's and domain's
counts. The fused posterior is arithmetic on arrays of one number per language.

Sums are taken per array place, so a host with a third of all pages is one row per task before
the shuffle; evidence is joined per distinct host and declaration.

Defined cases: a null or empty page has no text evidence and goes by its host, suffix and
declaration; a null or unreadable url has an empty host, shared with all such pages; a null or
unknown declaration is a value of its own; documents without language or text teach nothing;
ties go to the first language in alphabetical order; repeated pages count and appear repeatedly;
without any documents the result has null languages; an empty table gives no rows; other columns are
ignored, whatever their names; a page of any length is read whole (its task holds it and its trigrams). Any
number of languages is allowed: they are scored in blocks, one pass over the pages each, and a
page then carries one number per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from presswire.functions.text import bind
from presswire.llm.common import map_texts, written
from presswire.llm.url_reputation import domain_and_suffix, host_and_path
from presswire.session import ship_package

SLOTS = 1 << 16
TEMPER = 0.25
STRENGTH = 5.0
#: Languages that a worker holds at once (`SLOTS` numbers each), and parts of their tables that are added up apart.
BLOCK_LANGUAGES = 256
PARTS = 64

_HIDDEN = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_ENTITY = re.compile(rb"&#?\w{1,31};")
_DECLARED = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_MULTIPLY = np.array([0x9E37, 0x79B9, 0x85EB], np.uint32)


def slots(text: bytes) -> np.ndarray:
    """Table places of the byte trigrams of a text, white space joined and A-Z lower-cased."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.uint32)
    mixed = raw[:-2] * _MULTIPLY[0] ^ raw[1:-1] * _MULTIPLY[1] * 7 ^ raw[2:] * _MULTIPLY[2] * 31
    return (mixed ^ (mixed >> 15)) & (SLOTS - 1)


def visible(html: bytes) -> bytes:
    return _ENTITY.sub(b" ", _HIDDEN.sub(b" ", html))


COUNTS = "lang string, part int, counts binary"


def trigram_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of trigrams over all documents with a language: `PARTS` rows of table places per language, stored.

    A task holds a bounded number of languages at a time; a group adds up one part of one language.
    """
    source = docs.filter(F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * PARTS, pa.string()), pa.array(range(PARTS), pa.int32()),
                 pa.array([p.tobytes() for p in np.split(values, PARTS)], pa.binary())], names=["lang", "part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in sums:
                    if len(sums) == BLOCK_LANGUAGES:
                        yield from rows(sums)
                        sums.clear()
                    sums[name] = np.zeros(SLOTS, np.int64)
                found = slots(raw)
                if len(found) < 4096:
                    np.add.at(sums[name], found, 1)
                else:
                    sums[name] += np.bincount(found, minlength=SLOTS)
        yield from rows(sums)

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in group["counts"]], axis=0)
        return pd.DataFrame({"lang": [key[0]], "part": [key[1]], "counts": [total.tobytes()]})

    ship_package(docs.sparkSession)
    return written(source.mapInArrow(count, COUNTS).groupBy("lang", "part").applyInPandas(add, COUNTS), "trigrams")


def log_chances(counts: DataFrame, names: list[str]) -> np.ndarray:
    """Log trigram probabilities of at most `BLOCK_LANGUAGES` languages."""
    table = np.full((len(names), SLOTS), 0.5)
    width = SLOTS // PARTS
    for r in counts.filter(F.col("lang").isin(*names)).collect():
        table[names.index(r.lang), r.part * width:(r.part + 1) * width] += np.frombuffer(r.counts, np.int64)
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, table: np.ndarray, *, html: str, keep: list[str], temper: float) -> DataFrame:
    """`keep` columns, evidence (log-likelihood per language) and declared (from the markup)."""
    shared = pages.sparkSession.sparkContext.broadcast(table)  # at most BLOCK_LANGUAGES x SLOTS numbers
    fields = T.StructType([T.StructField("evidence", T.ArrayType(T.DoubleType())), T.StructField("declared", T.StringType())])

    def make():
        logs = shared.value

        def work(texts: list[bytes], _) -> list:
            evidence, declared = [], []
            for raw in texts:
                # places met repeatedly are looked up once
                met, times = np.unique(slots(visible(raw)), return_counts=True)
                evidence.append((logs[:, met].astype(np.float64) @ times * temper).tolist())
                found = _DECLARED.search(raw)
                declared.append(found[1].decode().lower() if found else None)
            return [evidence, declared]

        return work

    return map_texts(pages, html, keep, fields, make)


def all_evidence(placed: DataFrame, counts: DataFrame, names: list[str], temper: float) -> DataFrame:
    """page_id, host, evidence for all languages and declared.

    One pass over the pages for each `BLOCK_LANGUAGES` languages, stored before the next one.
    """
    seen, parts = placed, []
    blocks = [names[a:a + BLOCK_LANGUAGES] for a in range(0, len(names), BLOCK_LANGUAGES)] or [[]]
    for number, block in enumerate(blocks):
        last = number + 1 == len(blocks)
        keep = ["page_id", "host", *parts, *([] if last else ["html"])]
        seen = text_evidence(seen, log_chances(counts, block) if block else np.zeros((0, SLOTS), np.float32),
                             html="html", keep=keep, temper=temper)
        parts.append(f"evidence_{number}")
        seen = seen.withColumnRenamed("evidence", parts[-1])
        if not last:
            seen = written(seen, "language-pages")
    return seen.select("page_id", "host", F.concat(*parts).alias("evidence"), "declared")


def _normal(values: Column) -> Column:
    """exp of log weights, summing to 1; each step is worked out once."""
    def scaled(raw: Column) -> Column:
        return bind(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(raw, lambda x: x / total))

    def shifted(logs: Column) -> Column:
        return bind(F.array_max(logs), lambda top: bind(F.transform(logs, lambda x: F.exp(x - top)), scaled))

    return bind(values, shifted)


def identify(
    pages: DataFrame,
    docs: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    temper: float = TEMPER,
    strength: float = STRENGTH,
) -> DataFrame:
    """page_id, host, declared, text_lang (by text alone), lang, confidence and posterior of every page."""
    counts = trigram_counts(docs)
    names = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    n = len(names)
    host, _ = host_and_path(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")))
    placed = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), F.col(f"`{html}`").alias("html"))
    seen = all_evidence(placed, counts, names, temper)
    if not n:
        nothing = F.lit(None).cast("string")
        return seen.select("page_id", "host", "declared", nothing.alias("text_lang"), nothing.alias("lang"),
                           F.lit(None).cast("double").alias("confidence"), "evidence")
    domain, suffix = domain_and_suffix(F.col("host"))
    first = written(
        seen.withColumns({"domain": domain, "suffix": suffix, "declared": F.coalesce("declared", F.lit(""))})
        .withColumn("own", _normal(F.col("evidence"))), "language-evidence")

    def sums(keys: list[str], name: str) -> DataFrame:
        each = first.select(*keys, F.posexplode("own").alias("__at", "__own")).groupBy(*keys, "__at").agg(
            F.sum("__own").alias("__own"))
        return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__own"))).alias(name)).withColumn(
            name, F.col(f"{name}.__own")).withColumn(f"{name}_t", F.aggregate(name, F.lit(0.0), lambda a, x: a + x))

    whole = sums([], "all_n").select("all_n_t", F.when(F.size("all_n") > 0, F.col("all_n")).otherwise(
        F.array_repeat(F.lit(0.0), n)).alias("all_n"))
    # distinct places and declarations meet their sums first; pages join once to each
    places = (
        sums(["host", "domain", "suffix"], "host_n").join(sums(["domain"], "domain_n"), "domain")
        .join(sums(["suffix"], "suffix_n"), "suffix").drop("domain", "suffix")
    )
    declared = sums(["declared"], "declared_n").withColumnRenamed("declared", "__declared")

    # one row of one number per language; names in order, for the lookups below
    known = F.broadcast(whole.withColumn("names", F.lit(names)))
    joined = first.join(places, "host").join(declared, F.col("declared") == F.col("__declared")).join(known)
    c = F.col

    def weight(name: Column, i: Column) -> Column:
        at = lambda values: F.get(c(values), i)
        top = (at("all_n") + 1) / (c("all_n_t") + n)
        in_domain = (F.greatest(at("domain_n") - at("own"), F.lit(0.0)) + strength * top) / (c("domain_n_t") - 1 + strength)
        in_host = (F.greatest(at("host_n") - at("own"), F.lit(0.0)) + strength * in_domain) / (c("host_n_t") - 1 + strength)
        # shares of a language's pages with this declaration and suffix, without the page itself
        room = at("all_n") - at("own") + 1
        says = (F.greatest(at("declared_n") - at("own"), F.lit(0.0)) + F.when(c("declared") == name, 0.5).otherwise(0.05)) / room
        ends = (F.greatest(at("suffix_n") - at("own"), F.lit(0.0)) + 0.1) / room
        return at("evidence") + F.log(in_host) + F.log(says) + F.log(ends)

    weighed = joined.withColumn("weights", F.transform("names", weight))
    fused = weighed.withColumn("posterior", _normal(F.col("weights"))).drop("weights")

    def best(values: str) -> Column:
        return F.element_at("names", F.array_position(values, F.array_max(values)).cast("int"))

    return fused.select(
        "page_id", "host", F.nullif("declared", F.lit("")).alias("declared"), best("own").alias("text_lang"),
        best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"), "posterior")
