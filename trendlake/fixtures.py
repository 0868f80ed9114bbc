"""The ``trending_raw`` test view: driver tables mapped to raw snapshot rows.

One lineitem is one snapshot row (see FIXTURES.md).  The DataFrame form here
joins the dimensions first (customer->nation->region, supplier->nation) so the
lineitem-sized side meets each dimension once; Spark/AQE choose broadcast or
shuffle from measured sizes, but suppliers are broadcast up to ``SENT_BYTES``.  ``FIXTURE_SQL`` is the same view as plain SQL
for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlake.schema import COUNTRY, MONTH, TableSpec

# Up to so many bytes of files, suppliers are sent to all tasks: that spares a shuffle of all rows at their
# widest.  Spark's own limit does not see it, as it takes the join with nations for the product of both sizes.
SENT_BYTES = 16 << 20
FIXTURE_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")

# The column mapping of the test view (FIXTURES.md §2).
_COLUMNS = {
    "video_id": "concat('v', cast(l_partkey as string))",
    "video_published_at": (
        "case when l_linenumber = 7 and l_quantity < 3 then null "
        "else replace(substr(cast(l_shipdate as string), 1, 10), '-', '.') end"
    ),
    "video_trending__date": "replace(substr(cast(o_orderdate as string), 1, 10), '-', '.')",
    "video_trending_country": "r_name",
    "video_title": "concat(p_name, ' #', cast(l_partkey as string))",
    "video_category_id": (
        "case when l_tax = 0.08 and l_discount = 0.1 then 'True' "
        "when l_tax = 0.08 and l_discount = 0.09 then 'false' "
        "when l_tax = 0.08 and l_discount = 0.08 then null else p_brand end"
    ),
    "video_tags": (
        "case when l_linenumber = 6 then null "
        "else concat(replace(p_name, ' ', ','), ', ', p_type, ',\"', o_orderpriority, '\";x|', "
        "lower(c_mktsegment), ',a, ') end"
    ),
    "video_duration": (
        "concat('PT', case when p_size > 40 then '1H' else '' end, "
        "case when p_size > 5 then concat(cast(p_size as string), 'M') else '' end, "
        "cast(l_linenumber as string), 'S')"
    ),
    "video_view_count": (
        "case when l_quantity = 50 then null when l_quantity = 1 then '0' "
        "else cast(cast(floor(l_extendedprice) as bigint) as string) end"
    ),
    "video_like_count": (
        "case when l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1 then null "
        "else cast(cast(floor(l_extendedprice * l_discount) as bigint) as string) end"
    ),
    "video_comment_count": (
        "case when l_linenumber = 2 then null "
        "else cast(cast(floor(l_extendedprice * l_tax) as bigint) as string) end"
    ),
    "channel_id": "concat('c', cast(l_suppkey as string))",
    "channel_subscriber_count": "cast(cast(floor(abs(s_acctbal)) as bigint) as string)",
    "channel_country": "{sn}n_name",
    "channel_title": "s_name",
    "channel_custom_url": (
        "case when l_suppkey % 5 = 0 then null "
        "when l_suppkey % 5 = 1 then concat('@s', cast(l_suppkey as string)) "
        "when l_suppkey % 5 = 2 then concat('/c/s', cast(l_suppkey as string)) "
        "when l_suppkey % 5 = 3 then concat('https://example.com/s', cast(l_suppkey as string)) "
        "else concat('s', cast(l_suppkey as string)) end"
    ),
    "channel_view_count": "cast(cast(floor(abs(s_acctbal) * 1000) as bigint) as string)",
    "channel_video_count": "cast(l_suppkey % 97 as string)",
}

FIXTURE_SQL = (
    "select\n  "
    + ",\n  ".join(f"{expr.format(sn='sn.')} as {name}" for name, expr in _COLUMNS.items())
    + """
from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join nation cn on c_nationkey = cn.n_nationkey
join region on cn.n_regionkey = r_regionkey
join part on l_partkey = p_partkey
join supplier on l_suppkey = s_suppkey
join nation sn on s_nationkey = sn.n_nationkey"""
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def file_bytes(table: DataFrame) -> int:
    """The bytes of a read table's files, as Spark has listed them."""
    return int(table._jdf.queryExecution().analyzed().stats().sizeInBytes())


def trending_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw snapshot rows (18 string columns) derived from the driver tables."""
    t = {n: read_table(spark, sf_dir, n) for n in FIXTURE_TABLES}
    nation = t["nation"]
    cust_geo = (
        t["customer"]
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "r_name")
    )
    orders_geo = t["orders"].join(cust_geo, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderdate", "o_orderpriority", "r_name", "c_mktsegment"
    )
    supp_geo = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_name", "s_acctbal", "n_name"
    )
    if file_bytes(t["supplier"]) <= SENT_BYTES:
        supp_geo = F.broadcast(supp_geo)
    rows = (
        t["lineitem"]
        .join(orders_geo, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(supp_geo, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return rows.select(*[F.expr(expr.format(sn="")).alias(name) for name, expr in _COLUMNS.items()])


# The daily view: raw rows folded onto 25 videos in one year, so that a video is sighted
# many times in a month with other views, titles and likes, and some values are missing
# or no dates or numbers.
_N = "cast(substr(video_id, 2) as int)"
_DAILY_CHANGES = {
    "video_id": f"concat('v', cast({_N} % 25 as string))",
    "video_trending__date": (
        f"case when {_N} % 17 = 0 then 'no date' when {_N} % 19 = 0 then null "
        "else concat('1997', substr(video_trending__date, 5, 6)) end"
    ),
    "video_trending_country": f"case when {_N} % 13 = 0 then null else video_trending_country end",
    "video_title": f"case when {_N} % 7 = 0 then null else video_title end",
    "video_category_id": (
        "case when lower(video_category_id) in ('true', 'false') then video_category_id "
        f"else concat('C', cast({_N} % 25 % 6 as string)) end"
    ),
    "video_tags": (
        "case when substr(video_trending__date, 6, 2) = '07' then null "
        f"else concat('Tag ', cast({_N} % 25 % 3 as string), ',a, \"x|', cast({_N} % 25 % 2 as string), ';') end"
    ),
    "video_view_count": f"case when {_N} % 23 = 0 then 'many' else video_view_count end",
    "video_like_count": f"case when {_N} % 29 = 0 then '-' else video_like_count end",
    "channel_title": f"case when {_N} % 11 = 0 then null else concat('Channel ', cast({_N} % 5 as string)) end",
}
_DAILY_COLUMNS = {name: _DAILY_CHANGES.get(name, name) for name in _COLUMNS}
DAILY_SQL = "select " + ", ".join(f"{expr} as {name}" for name, expr in _DAILY_COLUMNS.items()) + f" from ({FIXTURE_SQL})"


def daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with repeated sightings, nulls and dirt (see ``_DAILY_CHANGES``)."""
    return trending_raw(spark, sf_dir).select(*[F.expr(expr).alias(name) for name, expr in _DAILY_COLUMNS.items()])


# Raw rows as a table that breaks each kind of declared constraint: a row for each
# snapshot under a key of video and month, month 13 and up, missing categories,
# repeated titles and counts beyond decimal(10,4).
_DRAFT_COLUMNS = {
    COUNTRY: COUNTRY,
    "video_id": "video_id",
    "video_category_id": "video_category_id",
    MONTH: "cast(substr(video_trending__date, 6, 2) as int) + case when video_view_count = '0' then 12 else 0 end",
    "video_title": "repeat(video_title, 1 + cast(channel_video_count as int) % 12)",
    "engagement_rating": "cast(video_view_count as bigint) * 20",
}
DRAFT_SQL = "select " + ", ".join(f"{expr} as {name}" for name, expr in _DRAFT_COLUMNS.items()) + " from trending_raw"
DRAFT_SPEC = TableSpec(
    "drafts",
    T.StructType([T.StructField(name, T.StringType(), True) for name in _DRAFT_COLUMNS]),
    primary_key=(COUNTRY, "video_id", MONTH),
    not_null=(COUNTRY, "video_category_id"),
    varchar255=("video_title",),
    month_columns=(MONTH,),
    decimal_10_4=("engagement_rating",),
)


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending_raw(spark, sf_dir).select(*[F.expr(expr).alias(name) for name, expr in _DRAFT_COLUMNS.items()])
