"""Headline rules as column expressions.

Each function takes columns and returns a column. A rule that needs an intermediate value
several times binds it, so expressions stay linear in size however they are combined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from presswire.functions import fixed_values as V
from presswire.functions import text as T
from presswire.functions import urls


# -- headline from a URL ------------------------------------------------------

def clean_segment(segment: Column) -> Column:
    """Readable text of one URL segment, NULL when it holds none."""
    return T.bind(segment, _clean_segment)


def _clean_segment(segment: Column) -> Column:
    rejected = reduce(
        lambda acc, p: acc | T.matches(segment, p, ignore_case=True),
        V.SEGMENT_REJECTS[1:],
        T.matches(segment, V.SEGMENT_REJECTS[0], ignore_case=True),
    )
    out = T.replace(segment, V.SEGMENT_EXTENSION, ignore_case=True)
    for pattern in V.SEGMENT_LEADING:
        out = T.replace(out, pattern)
    out = T.replace(out, "[-_]+", " ")
    out = T.replace(out, V.SEGMENT_TRAILING_NUMBER)
    out = T.replace(out, V.SEGMENT_TRAILING_HEX, ignore_case=True)
    out = T.replace(out, V.SEGMENT_TRAILING_SHORT_NUMBER)
    out = T.replace(T.strip(out), f"{T.SPACE}+", " ")
    out = T.replace(out, f"^{V.EDGE_PUNCTUATION}+|{V.EDGE_PUNCTUATION}+$")
    return F.when(~rejected, T.bind(T.strip(out), lambda t: F.when(t != "", t)))


def segment_score(text: Column) -> Column:
    """Points for a cleaned segment: more words and characters score higher."""
    letters = F.length(T.replace(text, r"[^\p{L}]"))
    n_chars = F.length(text)

    def points(n_words: Column) -> Column:
        return (
            F.when((n_words >= 4) & (n_chars > 20), n_words * 10 + n_chars)
            .when((n_words >= 3) & (n_chars > 15), n_words * 5 + n_chars)
            .when((n_words >= 2) & (n_chars > 10), n_words * 2 + n_chars)
            .otherwise(0)
        )

    return F.when(text.isNull() | (letters < 5), 0).otherwise(T.bind(F.size(T.words(text)), points))


def headline_from_url(url: Column) -> Column:
    """Best-scoring path segment; the deeper one wins a tie, NULL when none scores."""
    segments = F.filter(
        F.split(urls.percent_decode(urls.path(url)), "/"),
        lambda s: (F.length(s) >= 5) & ~F.lower(s).isin(*V.SKIP_SEGMENTS),
    )
    cleaned = F.transform(segments, lambda s: clean_segment(T.strip(s)))
    scored = F.transform(
        cleaned,
        lambda c, i: F.struct(segment_score(c).alias("score"), i.alias("depth"), c.alias("text")),
    )
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    return best["text"]


# -- headline cleaning --------------------------------------------------------

def scrubbed_words(text: Column) -> Column:
    """Repair artefacts and drop truncated endings, then split into words.

    A pattern looks at its first character before it looks around, so that most places fail at once.
    """
    out = T.replace(T.strip(text), f"^{V.EDGE_PUNCTUATION}+")
    out = T.replace(out, V.HEADLINE_LONG_DIGITS)
    for pattern in V.HEADLINE_TRAILING:
        out = T.replace(out, pattern)
    out = T.replace(out, "(?=[A-Z])(?<=[a-z])", " ")
    out = T.replace(out, "(?=[A-Z][a-z])(?<=[A-Z])", " ")
    out = T.replace(out, r"(?<=\d)(?=[a-zA-Z])", " ")
    out = T.replace(out, "Apos(?=[a-z])", "'")
    out = T.replace(out, r"(?=a)\bApos\b", "'", ignore_case=True)
    out = T.replace(out, "''", "'")
    out = T.replace(out, "^'")
    out = T.replace(out, r"(\d)\s+(\d)", "$1.$2")
    out = T.replace(out, r"(?=[A-Z]\s)\b([A-Z])\s+([A-Z])\b", "$1$2")
    out = T.replace(out, r"(?=[A-Z]\s)\b([A-Z])\s+([A-Z])\s+([A-Z])\b", "$1$2$3")
    out = T.replace(out, r"(?=\s)(?<!\s)" + V.TRUNCATED_PREPOSITION)
    out = T.replace(out, r"(?=\s)(?<!\s)" + V.TRUNCATED_AUXILIARY, ignore_case=True)
    return T.words(out)


def without_stub_words(items: Column) -> Column:
    """Drop trailing words of one or two characters."""
    return T.drop_trailing(items, lambda w: F.length(w) <= 2)


def _looks_truncated(word: Column) -> Column:
    n = F.length(word)
    ends_in_consonant = F.lower(F.right(word, F.lit(1))).rlike(f"^[{V.CONSONANTS}]$")
    odd_f = word.endswith("f") & ~F.lower(F.substring(word, -2, 1)).isin(*"aeiou")
    return ((n <= 3) & ends_in_consonant) | ((n > 3) & odd_f) | word.rlike("[a-z][A-Z]")


def without_truncated_words(items: Column) -> Column:
    """Drop trailing words that look cut off."""
    return T.drop_trailing(items, _looks_truncated)


def shortened(items: Column) -> Column:
    """Join, cut at a space to the maximum length, trim end punctuation."""

    def cut(joined: Column) -> Column:
        head = F.regexp_replace(F.substring(joined, 1, V.HEADLINE_MAX_CHARS), " [^ ]*$", "")
        return F.when(F.length(joined) > V.HEADLINE_MAX_CHARS, head).otherwise(joined)

    return T.replace(
        T.bind(F.array_join(items, " "), cut),
        f"(?={V.EDGE_PUNCTUATION})(?<!{V.EDGE_PUNCTUATION}){V.EDGE_PUNCTUATION}+$|^{V.EDGE_PUNCTUATION}+$",
    )


def title_case_words(items: Column) -> Column:
    return F.array_join(
        F.transform(
            items,
            lambda w, i: F.when((i > 0) & w.isin(*V.SMALL_WORDS), w).otherwise(T.capitalize(w)),
        ),
        " ",
    )


def title_case(text: Column) -> Column:
    """Capitalise every word except small ones that are not first."""
    return title_case_words(T.words(F.lower(text)))


def accepted_title(text: Column) -> Column:
    """NULL unless the text is a usable headline, else its title case."""

    def judge(items: Column) -> Column:
        usable = (
            (F.length(text) >= V.HEADLINE_MIN_CHARS)
            & (F.size(items) >= V.HEADLINE_MIN_WORDS)
            & ~F.element_at(items, -1).rlike("^[A-Z][a-z]*[A-Z]|[a-z]{2}[A-Z]")
            & ~T.starts_with_any(F.lower(text), V.GENERIC_OPENINGS)
        )
        return F.when(usable, title_case_words(F.transform(items, F.lower)))

    return T.bind(T.words(text), judge)


def clean_headline(text: Column) -> Column:
    """Headline for display, NULL when the text is no usable headline."""
    kept = without_truncated_words(without_stub_words(scrubbed_words(text)))
    return T.bind(shortened(kept), accepted_title)


def best_headline(headline: Column, url: Column) -> Column:
    """The stored headline when it is long enough and cleans, else the one in the URL."""
    stored = F.when(F.length(T.strip(headline)) > 15, headline)
    return F.coalesce(clean_headline(stored), clean_headline(headline_from_url(url)))


# -- quality and keys ---------------------------------------------------------

def garbage_count(items: Column) -> Column:
    """Number of words that look like random characters."""
    return F.size(
        F.filter(
            items,
            lambda w: T.matches(w, r"[a-zA-Z]\d|\d[a-zA-Z]")
            | ((F.length(w) > 4) & ~w.rlike("[aeiouAEIOU]")),
        )
    )


def garbage_words(text: Column) -> Column:
    return garbage_count(T.words(text))


def headline_quality(text: Column, url: Column) -> Column:
    """Quality from 0.0 to 1.0; terms are added in a fixed order, so sums are exact."""
    n_chars = F.length(text)
    trusted = F.lower(F.replace(urls.host(url), F.lit("www."), F.lit(""))).rlike(
        T.any_of(V.TRUSTED_DOMAINS)
    )
    apostrophes = n_chars - F.length(F.replace(text, F.lit("'"), F.lit("")))

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    def total(items: Column) -> Column:
        n_words = F.size(items)
        capitalised = F.size(F.filter(items, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}")))
        score = F.lit(0.5)
        score = score + points(trusted, 0.25)
        score = score + F.when(n_chars.between(40, 80), F.lit(0.1)).otherwise(
            points((n_chars < 25) | (n_chars > 120), -0.1)
        )
        score = score + F.when(n_words.between(5, 12), F.lit(0.1)).otherwise(
            points((n_words < 4) | (n_words > 15), -0.1)
        )
        score = score + points(T.matches(text, r"\d{6,}"), -0.3)
        score = score + points(apostrophes > 2, -0.1)
        score = score + points(text.rlike("[A-Z]{5,}"), -0.1)
        score = score + points(garbage_count(items) >= 2, -0.5)
        score = score + points((n_words >= 10) & (F.try_divide(capitalised, n_words) > 0.6), -0.5)
        score = score + points(T.starts_with_any(F.lower(text), V.TICKER_OPENINGS), -0.3)
        score = score + points(n_words > 18, -0.3)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(T.bind(T.words(text), total))


def dedupe_key(text: Column) -> Column:
    """Words two to six in lower case; the whole text when it has one word."""
    return T.bind(
        T.words(F.lower(text)),
        lambda items: F.when(F.size(items) > 1, F.array_join(F.slice(items, 2, 5), " ")).otherwise(F.lower(text)),
    )
