"""Counts of a text as Spark expressions: words, symbols, repeated lines and repeated word windows.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null text counts as the empty text.  Everything is
a built-in expression; the one superlinear step, sorting the word windows of a text, is
``n log n`` in its length and done only where a window occurs twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NO_SPACE}+")).cast("long")


def char_count(text: Column, characters: str) -> Column:
    """How many characters of a regular-expression class the text has."""
    return F.regexp_count(text, F.lit(characters)).cast("long")


def text_lines(text: Column) -> Column:
    """The ``\\n``-separated lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(NO_SPACE)))


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_window_words(words_found: Column, k: int = 3) -> Column:
    """Words that lie in a window of ``k`` consecutive words found twice or more, the first occurrence included."""
    def hashed(w):
        parts = lambda x, i: [x, *(F.get(w, i + j) for j in range(1, k))]
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(*parts(x, i))), 1, F.greatest(F.size(w) - F.lit(k - 1), F.lit(0)))

    def marked(w):
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda p: F.filter(F.transform(p, lambda x, j: F.when(
            (F.get(p, j - 1).getField("h") == x.getField("h")) | (F.get(p, j + 1).getField("h") == x.getField("h")), x.getField("i"))), lambda i: i.isNotNull()))

    def covered(w):
        at = marked(w)
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + F.lit(k - 1))))))

    def counted(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(words_found, lambda w: F.when(F.size(w) < k, F.lit(0)).otherwise(let(hashed(w), counted))).cast("long")
