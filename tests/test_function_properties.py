"""Randomised checks of the display functions against plain-Python
statements of the client-side rules (many cases per Spark job)."""

import json
import random
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from trendlake.functions import channel_link, format_count, format_duration, parse_tags

JS_SPACE = "\t\n\x0b\x0c\r                  　﻿"


def js_trim(s):
    return s.strip(JS_SPACE)


def py_format_count(n):
    if n is None or n < 0:
        return "0"
    for power, suffix in ((9, "B"), (6, "M"), (3, "K")):
        if n >= 10**power:
            q = (Decimal(n) / Decimal(10**power)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)
            text = str(q)
            return (text[:-2] if text.endswith(".0") else text) + suffix
    return str(n)


def py_format_duration(s):
    if s is None or s == "":
        return None
    up = js_trim(s).upper()
    if not up.startswith("PT"):
        return s
    parts = []
    for unit, suffix in (("H", "h"), ("M", "m"), ("S", "s")):
        m = re.search(r"([0-9]+)" + unit, up)
        if m:
            parts.append(m.group(1) + suffix)
    return " ".join(parts) if parts else None


def py_parse_tags(s):
    if s is None:
        return []
    t = js_trim(s)
    if not t:
        return []
    if t.startswith("[") and t.endswith("]"):
        try:
            v = json.loads(t)
            if isinstance(v, list):
                out = [js_trim(x if isinstance(x, str) else json.dumps(x)) for x in v if x is not None]
                return [x for x in out if x]
        except ValueError:
            pass
    return [x for x in (js_trim(p) for p in t.split("|")) if x]


def py_link(u, host="https://youtube.com"):
    if not u:
        return None
    if u.startswith("http"):
        return u
    if u.startswith("/"):
        return host + u
    if u.startswith("@"):
        return host + "/" + u
    return host + "/@" + u


def check(spark, values, dtype, fn, ref):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    got = [r[0] for r in df.select(fn(F.col("x"))).collect()]
    bad = [(v, g, ref(v)) for v, g in zip(values, got) if g != ref(v)]
    assert not bad, bad[:5]


def test_format_count_matches_exact_half_up(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([rnd.randrange(0, 10**k) for k in range(1, 13)]) for _ in range(3000)]
    vals += [999, 1000, 999_949, 999_950, 1_049_999, 1_050_000, 1_150_000, 999_999_999, 10**12, -5, None]
    check(spark, vals, "bigint", format_count, py_format_count)


def test_format_duration_matches_rule(spark):
    rnd = random.Random(5)
    pieces = ["PT", "pt", "P", "1H", "12M", "3S", "0H", "45m", " ", "x", "T", "H", "7"]
    vals = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 5))) for _ in range(2000)] + [None, ""]
    check(spark, vals, "string", format_duration, py_format_duration)


def test_parse_tags_matches_rule(spark):
    rnd = random.Random(7)
    atoms = ["a", "bb", " c ", "", "|", "[", "]", '"x"', ",", "null", "\t", "1"]
    vals = ["".join(rnd.choice(atoms) for _ in range(rnd.randrange(0, 6))) for _ in range(2000)]
    vals += ['["a", " b ", null, ""]', '["x"]', "[]", "[bad", "a|b", None, "  "]
    check(spark, vals, "string", parse_tags, py_parse_tags)


def test_channel_link_matches_rule(spark):
    rnd = random.Random(9)
    heads = ["http", "https://x", "/", "@", "", "c", "/c/", "h"]
    vals = [rnd.choice(heads) + rnd.choice(["", "abc", "/d"]) for _ in range(500)] + [None]
    check(spark, vals, "string", channel_link, py_link)
