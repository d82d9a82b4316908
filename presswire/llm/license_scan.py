"""License scan by diagonal voting.

A template is a phrase of any length with a label. Every rolling pair of words of every
document is hashed and joined to the pairs of the templates (a short fixed list, so the large
side is never shuffled). A match votes for the diagonal `document word - template word`; an
unbroken copy of a template puts all its votes on one diagonal, an inserted or missing word
moves the rest to a neighbouring one. Votes are aggregated per document, template and
diagonal into bitmaps of template pairs, 64 pairs in each (a map-side combine: repeated rows
vote alike). Around every diagonal those up to `slack` away are merged, so a span keeps the
order of the template and is at most 2 * `slack` words longer. It is kept if the pairs found,
compared word by word and not by hash alone, cover enough of the template and hold all pairs
that tell its license from others (`needs`). Base phrases are templates with slack 0 and full
cover: one diagonal is one place.

Defined cases: null and empty texts have no words and no spans, labels are then empty; a null
doc_id is a document like any other; rows that repeat give the same row again; two texts
under one doc_id stay apart, because a text's hash is part of the key; an empty table gives no
rows; columns besides doc_id and text, whatever their names, are not read. A long text is one
row until its pairs are exploded; a window holds the diagonals of one text and template.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswire.llm.common import search_words

WORD_BITS = 64


@dataclass(frozen=True)
class Template:
    """`needs` are words of the phrase, standing together, that a span must hold."""

    label: str
    phrase: str
    base: bool = False
    needs: str = ""

    @property
    def slack(self) -> int:
        return 0 if self.base else SLACK

    @property
    def cover(self) -> float:
        return 1.0 if self.base else COVER

    @property
    def needed(self) -> list[int]:
        """Places of the word pairs of `needs`."""
        words, wanted = self.phrase.split(), self.needs.split()
        if not wanted:
            return []
        places = [i for i in range(len(words)) if words[i:i + len(wanted)] == wanted]
        if len(wanted) < 2 or len(places) != 1:
            raise ValueError(f"two or more words that stand once in the template: {self.needs!r}")
        return list(range(places[0], places[0] + len(wanted) - 1))


#: Diagonals so far from a span's middle belong to it; share of a template's word pairs that a span must have.
SLACK = 2
COVER = 0.6

# Phrases and labels that the base columns are defined by.
BASE_TEMPLATES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]
# Names of the Creative Commons variants, their words in full and in short.
VARIANTS = {
    "cc-by": ("attribution", "by"),
    "cc-by-sa": ("attribution sharealike", "by sa"),
    "cc-by-nd": ("attribution noderivatives", "by nd"),
    "cc-by-nc": ("attribution noncommercial", "by nc"),
    "cc-by-nc-sa": ("attribution noncommercial sharealike", "by nc sa"),
    "cc-by-nc-nd": ("attribution noncommercial noderivatives", "by nc nd"),
}
# Versions of these licenses.
VERSIONS = ["4 0 international", "3 0 unported"]


def variant_templates() -> list[Template]:
    """Sentence and short form of every variant; the words from its name to the version tell it apart."""
    made = []
    for label, (full, short) in VARIANTS.items():
        for version in VERSIONS:
            number = version.split()[0]
            made.append(Template(label, f"this work is licensed under a creative commons {full} {version} license",
                                 needs=f"commons {full} {number}"))
            made.append(Template(label, f"licensed under cc {short} {number} 0", needs=f"cc {short} {number}"))
    return made


# Sentences of licenses.
TEMPLATES = [
    *BASE_TEMPLATES,
    *variant_templates(),
    Template("apache", "licensed under the apache license version 2 0", needs="apache license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the"
                       " license is distributed on an as is basis without warranties or conditions of any kind"
                       " either express or implied"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or"
                    " implied warranties including but not limited to the implied warranties of merchantability and"
                    " fitness for a particular purpose are disclaimed in no event shall the copyright holder or"
                    " contributors be liable for any direct indirect incidental special exemplary or consequential"
                    " damages including but not limited to procurement of substitute goods or services loss of use"
                    " data or profits or business interruption however caused and on any theory of liability whether"
                    " in contract strict liability or tort including negligence or otherwise arising in any way out"
                    " of the use of this software even if advised of the possibility of such damage"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    Template("gpl", "this work is licensed under the gnu general public license version 3",
             needs="gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of"
                    " the gnu general public license as published by the free software foundation",
             needs="gnu general public license"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without"
                    " even the implied warranty of merchantability or fitness for a particular purpose see the gnu"
                    " general public license for more details", needs="gnu general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of"
                     " the gnu lesser general public license as published by the free software foundation",
             needs="gnu lesser general public license"),
    Template("mit", "released under the mit license", needs="mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"
                    " and associated documentation files"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but"
                    " not limited to the warranties of merchantability fitness for a particular purpose and"
                    " noninfringement in no event shall the authors or copyright holders be liable for any claim"
                    " damages or other liability whether in an action of contract tort or otherwise arising from"
                    " out of or in connection with the software or the use or other dealings in the software"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", needs="mozilla public license"),
]


def template_pairs(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """One row per rolling word pair of every template, with its bitmap and its bit there."""
    rows = []
    for number, t in enumerate(templates):
        words = t.phrase.split()
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {t.phrase!r}")
        rows += [(number, t.label, t.base, t.slack, t.cover, len(words), i, a, b)
                 for i, (a, b) in enumerate(zip(words, words[1:]))]
    made = docs.sparkSession.createDataFrame(
        rows, "template int, label string, base boolean, slack int, cover double, template_words int, "
              "template_at int, t1 string, t2 string")
    return made.withColumn("pair_hash", F.xxhash64("t1", "t2"))


def rolling_pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, at, w1, w2, pair_hash) of every two consecutive words."""
    words = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
        search_words(F.col(f"`{text}`")).alias("words"),
    )
    pairs = F.arrays_zip(
        F.slice("words", F.lit(1), F.size("words") - 1).alias("w1"),
        F.slice("words", F.lit(2), F.size("words") - 1).alias("w2"),
    )
    return (
        words.filter(F.size("words") > 1)
        .select("doc_id", "text_hash", F.posexplode(pairs).alias("at", "pair"))
        .select("doc_id", "text_hash", "at", "pair.w1", "pair.w2")
        .withColumn("pair_hash", F.xxhash64("w1", "w2"))
    )


def _lowest_pair(bitmaps: list[Column]) -> Column:
    """Smallest template place found."""
    return F.coalesce(*[F.when(b != 0, F.bit_count(b.bitwiseAND(-b) - 1) + WORD_BITS * i) for i, b in enumerate(bitmaps)])


def _highest_pair(bitmaps: list[Column]) -> Column:
    """Largest template place found."""
    highest = WORD_BITS - 1
    return F.coalesce(*[
        F.when(b < 0, F.lit(WORD_BITS * i + highest))  # the sign is the highest bit
        .when(b > 0, F.length(F.bin(b)) - 1 + WORD_BITS * i)
        for i, b in reversed(list(enumerate(bitmaps)))])


def _needs_met(templates: list[Template], bitmaps: list[str]) -> Column:
    """Whether the bitmaps hold every pair that the template needs."""
    met = F.lit(True)
    for number, t in enumerate(templates):
        masks = [sum(1 << (at % WORD_BITS) for at in t.needed if at // WORD_BITS == i) for i in range(len(bitmaps))]
        held = [F.col(b).bitwiseAND(_signed(m)) == _signed(m) for b, m in zip(bitmaps, masks) if m]
        if held:
            met = F.when(F.col("template") == number, reduce(lambda x, y: x & y, held)).otherwise(met)
    return met


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << WORD_BITS) if mask >> (WORD_BITS - 1) else mask).cast("long")


def license_spans(
    docs: DataFrame, templates: list[Template] | None = None, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, label, base, start_word, end_word (exclusive), cover.

    Of spans of one template whose middles are up to 2 * slack apart the best covered is given.
    """
    templates = TEMPLATES if templates is None else templates
    pairs = template_pairs(docs, templates)
    # the templates are the fixed list above: some hundred short rows
    hits = rolling_pairs(docs, doc_id, text).join(F.broadcast(pairs), "pair_hash").filter("w1 = t1 AND w2 = t2")
    key = ["doc_id", "text_hash", "template"]
    about = ["label", "base", "slack", "cover", "template_words"]
    longest = max((len(t.phrase.split()) for t in templates), default=2)
    bitmaps = [f"bits_{i}" for i in range((longest - 2) // WORD_BITS + 1)]
    bit = F.expr(f"shiftleft(1L, template_at % {WORD_BITS})")
    diagonals = hits.groupBy(*key, *about, (F.col("at") - F.col("template_at")).alias("diagonal")).agg(*[
        F.bit_or(F.when(F.floor(F.col("template_at") / WORD_BITS) == i, bit).otherwise(F.lit(0))).alias(name)
        for i, name in enumerate(bitmaps)])
    own = [F.col(b) for b in bitmaps]
    placed = (
        diagonals.withColumn("start", F.col("diagonal") + _lowest_pair(own))
        .withColumn("stop", F.col("diagonal") + _highest_pair(own) + 2)
    )
    along = Window.partitionBy(*key).orderBy("diagonal")

    around = along.rangeBetween(-SLACK, SLACK)

    def merged(name: str, of: str, combine) -> Column:
        # a base phrase stands on one diagonal, nothing is merged there
        return F.when(F.col("slack") == 0, F.col(of)).otherwise(combine(of).over(around)).alias(name)

    neighbours = placed.select(
        *key, *about, "diagonal", merged("start_word", "start", F.min), merged("end_word", "stop", F.max),
        *[merged(b, b, F.bit_or) for b in bitmaps])
    found = reduce(lambda x, y: x + y, [F.bit_count(b) for b in bitmaps])
    good = (
        neighbours.withColumn("share", found / (F.col("template_words") - 1))
        .filter((F.col("share") >= F.col("cover")) & _needs_met(templates, bitmaps))
        .select(*key, "label", "base", "slack", "diagonal", "start_word", "end_word", "share")
    )
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > 2 * F.col("slack")
    best = Window.partitionBy(*key, "run").orderBy(F.col("share").desc(), F.col("end_word") - F.col("start_word"), "diagonal")
    return (
        good.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(along))
        .withColumn("rank", F.row_number().over(best)).filter("rank = 1")
        .select(*key, "label", "base", F.col("start_word").cast("long"), F.col("end_word").cast("long"),
                F.col("share").alias("cover"))
    )


def license_labels(
    docs: DataFrame, spans: DataFrame, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: n_words, base places and labels, all labels, score (best cover)."""
    base = F.col("base")
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, True)).alias("n_base"),
        F.min(F.when(base, F.col("start_word"))).alias("first_word"),
        F.max(F.when(base, F.col("start_word"))).alias("last_word"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("labels"),
        F.max("cover").alias("score"),
    ).withColumnsRenamed({"doc_id": "s_doc_id", "text_hash": "s_text_hash"})
    counted = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
        F.size(search_words(F.col(f"`{text}`"))).cast("long").alias("n_words"),
    )
    same = (F.col("doc_id").eqNullSafe(F.col("s_doc_id"))) & (F.col("text_hash") == F.col("s_text_hash"))
    return counted.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
