"""Small awkward tables and plain Python versions of the base rules."""

from __future__ import annotations

import re

UPPER = {chr(c): chr(c + 32) for c in range(65, 91)}

LONG = " ".join(f"word{i % 977} the of" for i in range(20_000))
TEXTS = [
    None, "", "   \n\t ", "one", "Released under the MIT License.", "CC BY cc-by CC BY",
    "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed",
    "a b c a b c\nx y z\n\nx y z\n # $ & | <b> *** %", "Émile été naïve — déjà vu 日本語テキスト 𝒳𝒴",
    LONG, LONG, "same text here of four words", "same text here of four words",
    "NUL \x00 inside\x0b and \x1f separators kept", "trailing spaces   \n  in   between \n",
    "the quick brown fox jumps over the lazy dog again and again until the end of the day comes",
]


def lower(text: str | None) -> str:
    return "".join(UPPER.get(c, c) for c in text or "")


def search_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def count_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, label string, fp long"


def documents(spark, texts=TEXTS, repeat: bool = True):
    """Awkward texts with a null id, a null language, clashing extra columns and a repeated row."""
    rows = [(i if i != 3 else None, t, [None, "en", "de"][i % 3], "src", len(t or ""), 7, "x", 1)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:6] * repeat, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
