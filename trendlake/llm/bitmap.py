"""A bounded bitmap of keys, to keep rows that surely have no partner out of a join's shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of 64 bits (2 MB broadcast at most, whatever the input).
WORDS = 131_072


def _place(key: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(WORDS * 64))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")


def with_perhaps(rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false only if the value of ``column`` is not among ``keys`` (of one column).

    It is true for some others too, for more of them the fuller the bitmap is; a join
    after it decides.
    """
    word, bit = _place(F.col(keys.columns[0]))
    one = F.expr("1L")
    bits = keys.select(word.alias("word"), F.call_function("shiftleft", one, bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    word, bit = _place(F.col(column))
    marked = rows.join(F.broadcast(bits), word == bits["word"], "left")
    held = F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1
    return marked.select(*rows.columns, F.coalesce(held, F.lit(False)).alias(name))
