"""Packed feed fields: tone lists, emotion dictionaries, theme lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from presswire.functions import fixed_values as V
from presswire.functions import text as T
from presswire.functions.numeric import to_double

TONE_COLUMNS = ["AVG_TONE", "POSITIVE_SCORE", "NEGATIVE_SCORE"]


def parse_tone(tone: Column) -> dict[str, Column]:
    """First three comma parts as numbers; one bad part zeroes all three."""
    parts = F.slice(F.split(tone, ","), 1, 3)
    numbers = F.transform(parts, to_double)
    all_good = F.forall(numbers, lambda n: n.isNotNull())
    safe = F.when(all_good, numbers).otherwise(F.array().cast("array<double>"))
    return {
        name: F.coalesce(F.get(safe, F.lit(i)), F.lit(0.0)) for i, name in enumerate(TONE_COLUMNS)
    }


def gcam_pairs(gcam: Column) -> Column:
    """(code, value) of the wanted, numeric `code:value` entries in text order."""
    pairs = F.transform(F.split(gcam, ","), lambda p: F.split(p, ":"))
    two_parts = F.filter(pairs, lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).isin(*V.GCAM_EMOTIONS))
    typed = F.transform(
        two_parts, lambda p: F.struct(p[0].alias("code"), to_double(p[1]).alias("value"))
    )
    return F.filter(typed, lambda p: p["value"].isNotNull())


def emotion_value(pairs: Column, code: str) -> Column:
    """Value of the last entry for `code`, 0.0 when there is none."""
    values = F.filter(pairs, lambda p: p["code"] == code)
    return F.coalesce(F.try_element_at(values, F.lit(-1))["value"], F.lit(0.0))


def parse_themes(themes: Column) -> Column:
    """All theme names longer than two characters, comma-joined."""
    names = F.transform(F.split(themes, ";"), lambda t: T.strip(F.split(t, ",")[0]))
    kept = F.filter(names, lambda t: F.length(t) > 2)
    return F.coalesce(F.array_join(kept, ","), F.lit(""))


def theme_items(themes: Column) -> Column:
    """Trimmed theme names longer than two characters of a comma-joined list."""
    return F.filter(F.transform(F.split(themes, ","), F.trim), lambda t: F.length(t) > 2)


def humanize_theme(theme: Column) -> Column:
    """Readable label of a theme code, NULL when no label of 3 to 19 characters exists."""
    code = T.strip(F.upper(theme))
    exact = F.create_map(*[F.lit(x) for kv in V.THEME_LABELS.items() for x in kv])[code]
    by_prefix = F.coalesce(
        *[F.when(code.startswith(prefix), F.lit(name)) for prefix, name in V.THEME_LABELS.items()]
    )
    label = _title(F.replace(theme, F.lit("_"), F.lit(" ")))
    for prefix in V.THEME_PREFIXES:
        label = F.regexp_replace(label, "^" + prefix, "")
    fits = (F.length(label) > 2) & (F.length(label) < 20)
    return F.when(F.length(theme) > 0, F.coalesce(exact, by_prefix, F.when(fits, label)))


def _title(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, T.capitalize), "")
