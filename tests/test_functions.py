from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.functions import (
    channel_link,
    contains_ci,
    date_part_text,
    format_count,
    format_duration,
    format_engagement,
    highlight_parts,
    month_label,
    month_start_text,
    number_or_zero,
    parse_tags,
    to_number,
    with_default,
)


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def apply(spark, fn, values, dtype="string"):
    return [r[0] for r in one_col(spark, values, dtype).select(fn(F.col("x"))).collect()]


def test_format_duration(spark):
    got = apply(spark, format_duration, ["PT1H2M3S", "PT4M", "PT", "x", None, "", "pt10s", " PT5M "])
    assert got == ["1h 2m 3s", "4m", None, "x", None, None, "10s", "5m"]


def test_format_count(spark):
    got = apply(spark, format_count, [999, 1000, 1250000, 2000000000, -1, None, 999950, 1150000], "bigint")
    assert got == ["999", "1K", "1.3M", "2B", "0", "0", "1000K", "1.2M"]
    assert apply(spark, format_count, [float("nan"), 12.5, float("inf")], "double") == ["0", "13", "0"]


def test_format_engagement(spark):
    assert apply(spark, format_engagement, [12.5, None, 2.675, 0.0], "double") == ["12.50%", "—", "2.68%", "0.00%"]
    assert apply(spark, format_engagement, ["abc", "3", "12.5 pct", "-.5", "1e2x"]) == ["abc", "3.00%", "12.50%", "-0.50%", "100.00%"]


def test_channel_link(spark):
    got = apply(spark, channel_link, ["http://x", "/c/x", "@x", "x", None, ""])
    assert got == ["http://x", "https://youtube.com/c/x", "https://youtube.com/@x", "https://youtube.com/@x", None, None]


def test_parse_tags_text_forms(spark):
    got = apply(spark, parse_tags, ['["a","b"]', "a|b", " ", "[bad", None, " x | | y ", '[" a ", null, ""]'])
    assert got == [["a", "b"], ["a", "b"], [], ["[bad"], [], ["x", "y"], ["a"]]


def test_parse_tags_array_input(spark):
    df = spark.createDataFrame([([" a", None, "", "b "],), (None,)], "x array<string>")
    got = [r[0] for r in df.select(parse_tags("x", T.ArrayType(T.StringType()))).collect()]
    assert got == [["a", "b"], []]


def test_dates(spark):
    df = spark.createDataFrame([(2024, 3, "2024-03-01T00:00:00Z"), (2024, 13, None)], "y int, m int, d string")
    rows = df.select(month_start_text("y", "m"), date_part_text("d"), month_label("d")).collect()
    assert [tuple(r) for r in rows] == [("2024-03-01", "2024-03-01", "2024-03"), (None, "", None)]


def test_numbers(spark):
    assert apply(spark, to_number, ["12", " 3.5 ", "", None, "abc", "Infinity", "NaN"]) == [12.0, 3.5, None, None, None, None, None]
    assert apply(spark, number_or_zero, ["7", None, "x"]) == [7.0, 0.0, 0.0]


def test_search_helpers(spark):
    df = spark.createDataFrame([("United Kingdom",), ("Kenya",), ("Chad",)], "name string")
    hits = [r.name for r in df.filter(contains_ci("name", "KIN")).collect()]
    assert hits == ["United Kingdom"]
    assert df.filter(contains_ci("name", "  ")).count() == 0
    parts = df.filter(contains_ci("name", "ken")).select(highlight_parts("name", "ken").alias("m")).collect()[0].m
    assert (parts.before, parts.hit, parts.after) == ("", "Ken", "ya")


def test_with_default(spark):
    assert apply(spark, lambda c: with_default(c, "Untitled Video"), [None, "", "x"]) == ["Untitled Video", "Untitled Video", "x"]
