"""F2-F4 tag splitting and cleaning, F9 tag-list parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.functions.text import js_trim

# Tag delimiter; line-break/tab characters and the delimiters
# "|", "," and ";" that become a space; the double quote that is removed; the
# minimum kept tag length (a tag must be longer than 1).
TAG_SEPARATOR = ","
TAG_BREAK_CHARS = "\n\r\t"
TAG_DELIMITER_CHARS = "|,;"
TAG_DROP_CHARS = '"'
TAG_MIN_LENGTH_EXCLUSIVE = 1


def split_tags(c: Column | str) -> Column:
    """raw comma-separated tag text -> array of raw tags (empties kept)."""
    return F.split(F.col(c) if isinstance(c, str) else c, TAG_SEPARATOR)


def normalize_tag(c: Column) -> Column:
    """lower-case after trimming ASCII spaces."""
    return F.lower(F.trim(c))


# Java's ``\s`` class; after cleaning, any run of these is a single space.
_JAVA_SPACE_CHARS = " \t\n\x0b\f\r"


def clean_tag(c: Column) -> Column:
    """line breaks, tabs and delimiters become spaces, quotes vanish, and
    whitespace runs collapse to one space.  No trim afterwards, so a trailing
    delimiter leaves a trailing space.

    Every character rule is a one-to-one map, so one ``translate`` applies
    them all (each whitespace character also maps to a plain space); the
    regex collapse then runs only on the few tags holding a double space.
    """
    to_space = "".join(dict.fromkeys(TAG_BREAK_CHARS + TAG_DELIMITER_CHARS + _JAVA_SPACE_CHARS))
    spaced = F.translate(c, to_space + TAG_DROP_CHARS, " " * len(to_space))
    return F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)


def long_enough(c: Column) -> Column:
    return F.length(c) > TAG_MIN_LENGTH_EXCLUSIVE


def parse_tags(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """a tag list given as an array, as JSON array text or as ``a|b`` text
    -> array of trimmed, non-empty strings.  NULL or blank input -> [].

    JSON is tried only when the trimmed text starts with ``[`` and ends with
    ``]``; text that is not valid JSON falls back to the pipe form.
    """
    col = F.col(c) if isinstance(c, str) else c

    def tidy(arr: Column) -> Column:
        trimmed = F.transform(arr, lambda t: js_trim(t))
        return F.filter(trimmed, lambda t: t.isNotNull() & (F.length(t) > 0))

    if isinstance(dtype, T.ArrayType):
        return F.coalesce(tidy(col.cast("array<string>")), F.array().cast("array<string>"))
    text = js_trim(col.cast("string"))
    looks_json = text.startswith("[") & text.endswith("]")
    as_json = F.when(looks_json, F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}))
    as_pipe = F.split(text, r"\|")
    parsed = tidy(F.coalesce(as_json, as_pipe))
    empty = F.array().cast("array<string>")
    return F.when(col.isNull() | (F.length(text) == 0), empty).otherwise(F.coalesce(parsed, empty))
