"""Display text built from result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace removed by the client's trim (ECMAScript
# WhiteSpace and LineTerminator characters), default link host, and the
# display placeholder for a missing engagement value.
_JS_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DEFAULT_LINK_HOST = "https://youtube.com"
MISSING_TEXT = "—"
_LEADING_NUMBER = r"^[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """Trim all leading/trailing whitespace, not only ASCII spaces."""
    return F.regexp_replace(_c(c), rf"^{_JS_SPACE}+|{_JS_SPACE}+$", "")


def format_duration(c: Column | str) -> Column:
    """ISO-8601 ``PT#H#M#S`` -> ``#h #m #s``.

    NULL or '' -> NULL; text not starting with ``PT`` (after trim and upper
    case) is returned unchanged; a ``PT`` text without parts -> NULL.
    """
    raw = _c(c).cast("string")
    up = F.upper(js_trim(raw))
    parts = [
        F.concat(F.nullif(F.regexp_extract(up, rf"(\d+){unit}", 1), F.lit("")), F.lit(suffix))
        for unit, suffix in (("H", "h"), ("M", "m"), ("S", "s"))
    ]
    joined = F.nullif(F.concat_ws(" ", *parts), F.lit(""))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
        .when(~up.startswith("PT"), raw)
        .otherwise(joined)
    )


def format_count(c: Column | str) -> Column:
    """compact count text: ``1.3M``, ``2B``, ``1K``, ``999``.

    One decimal, rounded half up, a trailing ``.0`` dropped.  Negative,
    NaN, infinite or NULL -> ``'0'``.  Integral inputs are scaled with exact
    decimal arithmetic.
    """
    col = _c(c)
    x = col.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | (x < 0)
    exact = col.try_cast("decimal(38,6)")

    def scaled(power: int, suffix: str) -> Column:
        q = F.round(exact / F.lit(10**power).cast("decimal(38,0)"), 1)
        text = F.regexp_replace(q.cast("decimal(38,1)").cast("string"), r"\.0$", "")
        fallback = F.regexp_replace(F.format_string("%.1f", x / float(10**power)), r"\.0$", "")
        return F.concat(F.coalesce(text, fallback), F.lit(suffix))

    small = F.round(x, 0).try_cast("long").cast("string")
    return (
        F.when(bad, F.lit("0"))
        .when(x >= 1e9, scaled(9, "B"))
        .when(x >= 1e6, scaled(6, "M"))
        .when(x >= 1e3, scaled(3, "K"))
        .otherwise(small)
    )


def format_engagement(c: Column | str) -> Column:
    """the leading number with two decimals and ``%``; NULL -> a dash; text
    that does not begin with a number is unchanged."""
    col = _c(c)
    num = F.regexp_extract(js_trim(col.cast("string")), _LEADING_NUMBER, 0).try_cast("double")
    fixed = F.format_string("%.2f%%", num)
    return F.when(col.isNull(), F.lit(MISSING_TEXT)).when(num.isNotNull(), fixed).otherwise(col.cast("string"))


def channel_link(c: Column | str, host: str = DEFAULT_LINK_HOST) -> Column:
    """a channel URL from a custom URL or handle; NULL or '' -> NULL."""
    u = _c(c).cast("string")
    h = F.lit(host.rstrip("/"))
    return (
        F.when(u.isNull() | (u == ""), F.lit(None).cast("string"))
        .when(u.startswith("http"), u)
        .when(u.startswith("/"), F.concat(h, u))
        .when(u.startswith("@"), F.concat(h, F.lit("/"), u))
        .otherwise(F.concat(h, F.lit("/@"), u))
    )


def contains_ci(c: Column | str, query: str) -> Column:
    """case-insensitive substring test; a blank query matches nothing."""
    if not query.strip():
        return F.lit(False)
    return F.lower(_c(c)).contains(query.lower())


def highlight_parts(c: Column | str, query: str) -> Column:
    """first case-insensitive match split into (before, hit, after)."""
    s = _c(c)
    n = len(query)
    pos = F.locate(query.lower(), F.lower(s)) if query else F.lit(0)
    hit = pos > 0
    return F.struct(
        F.when(hit, F.substring(s, F.lit(1), pos - 1)).otherwise(s).alias("before"),
        F.when(hit, F.substring(s, pos, F.lit(n))).otherwise(F.lit("")).alias("hit"),
        F.when(hit, F.substring(s, pos + n, F.lit(1 << 30))).otherwise(F.lit("")).alias("after"),
    )


def with_default(c: Column | str, default: str) -> Column:
    """NULL or '' -> ``default``."""
    return F.coalesce(F.nullif(_c(c).cast("string"), F.lit("")), F.lit(default))
