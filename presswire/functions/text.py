"""String building blocks shared by the headline, theme and search rules.

Patterns run with Unicode classes and `\\n` as the only line end, so that `\\w`,
`\\d`, `\\s` and `$` mean the same for every script the feeds carry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_FLAGS = "(?Ud)"
_FLAGS_IGNORE_CASE = "(?iuUd)"
SPACE = r"[\s\x1c-\x1f]"


def flagged(pattern: str, ignore_case: bool = False) -> str:
    return (_FLAGS_IGNORE_CASE if ignore_case else _FLAGS) + pattern


def replace(text: Column, pattern: str, to: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, flagged(pattern, ignore_case), to)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(flagged(pattern, ignore_case))


def strip(text: Column) -> Column:
    # the character is looked at before what stands in front of it, so most places fail at once
    return replace(text, rf"^{SPACE}+|(?={SPACE})(?<!{SPACE}){SPACE}+$")


def words(text: Column) -> Column:
    """Whitespace-separated words; no empty words, an empty array for blank text."""
    return F.filter(F.split(text, flagged(f"{SPACE}+")), lambda w: w != "")


def any_of(options: list[str]) -> str:
    """Alternation that matches one of the literal options."""
    return "(?:" + "|".join("\\Q" + o + "\\E" for o in options) + ")"


def starts_with_any(text: Column, options: list[str]) -> Column:
    return text.rlike("^" + any_of(options))


def drop_trailing(items: Column, droppable: Callable[[Column], Column]) -> Column:
    """Remove items from the end for as long as `droppable` holds."""

    def shorten(xs: Column) -> Column:
        kept = F.transform(xs, lambda w, i: F.when(~droppable(w), i + 1).otherwise(F.lit(0)))
        return F.slice(xs, F.lit(1), F.coalesce(F.array_max(kept), F.lit(0)))

    return bind(items, shorten)


def capitalize(word: Column) -> Column:
    """First letter in title case, the others in lower case."""
    return F.initcap(word)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)
