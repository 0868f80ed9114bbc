"""Registered queries over published stores, CSV files and long lists, each with its DuckDB oracle.

They write to fresh folders of the shared scratch location and read the results back through
the operators under test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake import oracle as o
from trendlake.fixtures import daily_raw, read_table, trending_raw
from trendlake.functions.dates import month_label
from trendlake.operators import category_trends, clean_snapshots, sighting_summary, top_categories, top_channels, top_videos, video_trends, with_trending_month
from trendlake.operators.catalog import describe_table, list_tables, require_table
from trendlake.operators.dims import country_coverage
from trendlake.operators.display import display_rows
from trendlake.operators.summary import DEALT_BY
from trendlake.operators.explore import leading_categories, leading_category_trends, pinned_points, trend_series, trend_series_arrays
from trendlake.operators.lookups import browse, country_category_trends, country_report, country_top, country_video_trends
from trendlake.plans.ordering import asc
from trendlake.schema import APPEARANCES, CATEGORY, COUNTRY, MONTH, RAW_COLUMNS, RESULT_TABLES, VIEWS, YEAR
from trendlake.session import scratch_dir
from trendlake.sources import buckets, export_csv, publish, publish_release, publishable, read_csv_files, read_snapshots, sweep, write_by_key, write_ordered, write_snapshots
from trendlake.sources.ordered import OrderedTable
from trendlake.sources.releases import RESULT_ORDER, open_release

C = COUNTRY
FILES = 6  # ranges of a published table, so that small test data has several
DATABASE = "trendlake_results"
LATE_YEAR, LATE_MONTH = 1997, 3
LONG_LIST = 1_500
MANY_VIEWS = 103_500
ANALYSES = {
    "top10_channels_per_country": top_channels,
    "top10_categories_per_country": top_categories,
    "top10_videos_per_country": top_videos,
    "category_trends_over_time": category_trends,
    "video_trends_over_time": video_trends,
}


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return clean_snapshots(trending_raw(spark, sf))


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned table -> written summary, each written before the next step reads it, as in the refresh job."""
    cleaned = scratch_dir(spark, "cleaned")
    write_snapshots(_snapshots(spark, sf), cleaned)
    return write_by_key(sighting_summary(read_snapshots(spark, cleaned), buckets(spark)), scratch_dir(spark, "summary"), DEALT_BY)


def _table(spark: SparkSession, sf: str, name: str) -> OrderedTable:
    """One result, published and opened through the pointer."""
    root = scratch_dir(spark, "store")
    publish_release(spark, root, {name: ANALYSES[name](_snapshots(spark, sf))}, FILES)
    return open_release(spark, root).table(name)


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---------------------------------------------------------------- releases
def release_tables(spark, sf):
    """Two releases, and between them a run that fails at its second table; the pointer shows the last whole one."""
    root, summary = scratch_dir(spark, "store"), _summary(spark, sf)
    publish_release(spark, root, {name: op(summary).limit(3) for name, op in ANALYSES.items()}, 1)
    broken = {"top10_channels_per_country": top_channels(summary), "top10_categories_per_country": summary.select(COUNTRY)}
    try:
        publish_release(spark, root, broken, 1)
    except AnalysisException:
        pass
    publish_release(spark, root, {name: op(summary) for name, op in ANALYSES.items()}, FILES)
    sweep(spark, root, keep=1, grace_hours=1)
    release = open_release(spark, root)
    return _union(
        release.rows(n).agg(F.count("*").alias("n_rows"), F.sum(APPEARANCES).alias("appearances")).select(F.lit(n).alias("table_name"), F.lit(release.number).alias("release"), "n_rows", "appearances")
        for n in ANALYSES)


def _order_text(name: str) -> str:
    return f"concat_ws('|', {', '.join(f'CAST({c} AS STRING)' for c in RESULT_ORDER[name])})"


def release_order(spark, sf):
    """Every row's place in the order that its analysis writes, from the published files."""
    root, summary = scratch_dir(spark, "store"), _summary(spark, sf)
    release = publish_release(spark, root, {name: op(summary) for name, op in ANALYSES.items()}, FILES)
    return _union(release.table(n).with_position().select(F.lit(n).alias("table_name"), "position", F.expr(_order_text(n)).alias("row_key")) for n in ANALYSES)


def release_page(spark, sf):
    table = _table(spark, sf, "category_trends_over_time")
    n = table.index.agg(F.sum("n_rows")).first()[0] or 0
    return table.page(limit=100, offset=n // 10)


def release_browse(spark, sf):
    """The same depth through the browsing operator, by category."""
    table = _table(spark, sf, "category_trends_over_time")
    return browse(table, {CATEGORY: "Brand#11"}, limit="25", offset="90")


def release_filtered_page(spark, sf):
    return _table(spark, sf, "category_trends_over_time").page(limit=40, offset=70, equal={YEAR: LATE_YEAR})


def release_date_lookup(spark, sf):
    return _table(spark, sf, "category_trends_over_time").lookup(equal={YEAR: LATE_YEAR, MONTH: LATE_MONTH})


def release_range_lookup(spark, sf):
    return _table(spark, sf, "video_trends_over_time").lookup(between={VIEWS: (50_000, None), YEAR: (1996, 1998)})


def release_top_views(spark, sf):
    return _table(spark, sf, "video_trends_over_time").top(VIEWS, 25)


def release_title_lookup(spark, sf):
    table = _table(spark, sf, "top10_videos_per_country")
    title = table.rows().agg(F.min("video_title")).first()[0]
    return table.lookup(equal={"video_title": title})


def release_country_report(spark, sf):
    """The five lookups of one country over a release, with the fields that all have."""
    root, summary = scratch_dir(spark, "store"), _summary(spark, sf)
    release = publish_release(spark, root, {name: op(summary) for name, op in ANALYSES.items()}, FILES)
    report = country_report({n: release.rows(n) for n in ANALYSES}, o.LOOKUP_COUNTRY)
    named = {"top_channels": F.col("channel_title"), "top_categories": F.col(CATEGORY), "top_videos": F.col("video_title"),
             "category_trends": F.concat_ws("|", "date", "category"), "video_trends": F.concat_ws("|", "date", "video_title")}
    return _union(report[s].select(F.lit(s).alias("section"), named[s].alias("name"), APPEARANCES) for s in named)


def country_argument(spark, sf):
    """Which names a lookup accepts, and how many rows it finds."""
    tops = top_categories(_snapshots(spark, sf))
    found = []
    for k, name in enumerate([o.LOOKUP_COUNTRY, "", "   ", None, "NOWHERE"]):
        try:
            found.append(country_top(tops, name).agg(F.lit(k).alias("nth"), F.lit(name).cast("string").alias("country"), F.lit(True).alias("accepted"), F.count("*").alias("n_rows")))
        except ValueError:
            found.append(spark.createDataFrame([(k, name, False, 0)], "nth int, country string, accepted boolean, n_rows long"))
    return _union(found)


# ---------------------------------------------------------------- catalog
def catalog_tables(spark, sf):
    """The tables published to a database, twice each, as listed and counted."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    summary = _summary(spark, sf)
    for name, op in ANALYSES.items():
        publish(op(summary).limit(2), f"{DATABASE}.{name}")
        publish(op(summary), f"{DATABASE}.{name}")
    counts = []
    for name in ANALYSES:
        require_table(spark, f"{DATABASE}.{name}")
        described = describe_table(spark, f"{DATABASE}.{name}").agg(F.count("*").cast("int").alias("n_columns"))
        counts.append(spark.table(f"{DATABASE}.{name}").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")).crossJoin(described))
    return list_tables(spark, DATABASE).join(_union(counts), "table_name")


def column_defaults(spark, sf):
    """A table that declares defaults, loaded without those columns: what it says and what its rows hold."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    name = f"{DATABASE}.channel_defaults"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({COUNTRY} STRING, channel_title STRING, note STRING DEFAULT 'new', total_views BIGINT DEFAULT 0, rank INT) USING parquet LOCATION '{scratch_dir(spark, 'defaults')}'")
    top_channels(_snapshots(spark, sf)).createOrReplaceTempView("channels_to_load")
    spark.sql(f"INSERT INTO {name} ({COUNTRY}, channel_title, rank) SELECT {COUNTRY}, channel_title, rank FROM channels_to_load")
    rows = spark.table(name)
    held = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).unpivot([], rows.columns, "field", "n_values")
    smallest = rows.agg(*[F.min(F.col(c).cast("string")).alias(c) for c in ("note", "total_views")]).unpivot([], ["note", "total_views"], "field", "least_value")
    return describe_table(spark, name).join(held, "field").join(smallest, "field", "left")


# ---------------------------------------------------------------- long lists, pinned rows, series
def long_top_videos(spark, sf):
    return top_videos(_snapshots(spark, sf), k=LONG_LIST)


def _country_trends(spark, sf) -> DataFrame:
    ct = category_trends(_snapshots(spark, sf))
    return country_category_trends(leading_category_trends(ct, leading_categories(ct)), o.LOOKUP_COUNTRY)


def pinned_last_wins(spark, sf):
    """Rows with one key more than once, in CSV files whose order says which is last; some keys have no row."""
    rows = _country_trends(spark, sf).withColumn("month", F.substring("date", 6, 2).cast("int"))
    rows = rows.withColumn("version", F.explode(F.sequence(F.lit(0), F.when(F.col("month") % 3 == 0, 2).when(F.col("month") % 3 == 1, 1).otherwise(0))))
    changed = F.when((F.col("version") == 2) & (F.col("month") == 6), None).otherwise(F.col(APPEARANCES) - 100 * F.col("version")).alias(APPEARANCES)
    path = scratch_dir(spark, "pinned")
    export_csv(rows.select("version", "date", "category", changed, "top5_tags"), path, sort_by=["version", "date", "category"])
    read = read_csv_files(spark, path).rows(["date", "category", APPEARANCES, "top5_tags"], position=True)
    keys = rows.where("version = 0").select(F.concat("category", F.lit("|"), "date").alias("key"))
    keys = keys.unionByName(keys.select(F.concat(F.lit("no such "), "key").alias("key"))).select(F.col("key").alias("pos"), "key")
    return publishable(pinned_points(read, keys, "category", position=["file", "offset"]))


def pinned_long_lists(spark, sf):
    """Tag lists of more than five; a card shows the first five that are not empty."""
    rows = _country_trends(spark, sf).withColumn("top5_tags", F.concat(F.lit(" first ||"), F.coalesce("top5_tags", F.lit("")), F.lit("| six |seven")))
    keys = rows.select(F.concat("category", F.lit("|"), "date").alias("key")).select(F.col("key").alias("pos"), "key")
    return publishable(pinned_points(rows, keys, "category"))


def _leading(spark, sf) -> DataFrame:
    ct = category_trends(_snapshots(spark, sf))
    return leading_category_trends(ct, leading_categories(ct))


def trend_series_tags(spark, sf):
    return trend_series(_leading(spark, sf), tags="top5_tags").withColumn("tags", F.concat_ws("|", "tags"))


def trend_arrays(spark, sf):
    series = trend_series_arrays(publishable(_leading(spark, sf)), tags="top5_tags")
    text = F.transform("points", lambda p: F.concat(p["date"].cast("string"), F.lit("="), p["value"].cast("long").cast("string"), F.lit(":"), F.concat_ws("+", p["tags"])))
    return series.select(COUNTRY, CATEGORY, F.size("points").alias("n_points"), F.array_join(text, ";").alias("points"))


def dirty_trend_series(spark, sf):
    """Rows whose date text is an ISO date or time, missing, empty or no date."""
    m, iso = F.col(MONTH) % 6, F.format_string("%04d-%02d-01", YEAR, MONTH)
    date = (F.when(m == 0, iso).when(m == 1, F.concat(iso, F.lit("T08:30:00.000Z"))).when(m == 2, None).when(m == 3, "")
            .when(m == 4, F.substring(iso, 1, 7)).otherwise(F.concat(F.substring(iso, 1, 5), F.lit("13-01"))))
    rows = category_trends(_snapshots(spark, sf)).select(COUNTRY, F.col(CATEGORY).alias("category"), date.alias("date"), APPEARANCES)
    return trend_series(rows, series="category")


def month_labels(spark, sf):
    dates = with_trending_month(clean_snapshots(daily_raw(spark, sf))).select("trending_date", "video_trending_date").distinct()
    time = F.concat(F.date_format("trending_date", "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    return dates.select("video_trending_date", month_label("trending_date").alias("of_date"), month_label(time).alias("of_time"), month_label("video_trending_date").alias("of_text"))


def display_country_video_trends(spark, sf):
    rows = country_video_trends(video_trends(_snapshots(spark, sf)), o.LOOKUP_COUNTRY)
    return display_rows(rows, "video_trends")


def nation_coverage(spark, sf):
    """Lists that some nations are missing from: by the country of the listed channels."""
    snap = _snapshots(spark, sf)
    nations = read_table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation_key"))
    of = lambda df: df.select(F.col("channel_country").alias(COUNTRY))
    lists = {
        "channels": of(snap.join(top_channels(snap, 2).select("channel_title"), "channel_title", "left_semi")),
        "categories": of(snap.where((F.col(CATEGORY) == "Brand#11") & (F.col(VIEWS) > MANY_VIEWS))),
        "videos": of(snap.join(top_videos(snap, 2).select("channel_title"), "channel_title", "left_semi")),
    }
    return country_coverage(nations, lists)


# ---------------------------------------------------------------- CSV files
def csv_by_header(spark, sf):
    """The raw rows in three sets of files, each with its columns in another order, one of them without a column."""
    raw, root = trending_raw(spark, sf), scratch_dir(spark, "csv-headers")
    part = F.length("video_id") % 3
    orders = [RAW_COLUMNS, RAW_COLUMNS[::-1], [c for c in RAW_COLUMNS if c != "channel_view_count"] + ["extra"]]
    for k, names in enumerate(orders):
        export_csv(raw.where(part == k).withColumn("extra", F.lit('a "b",\nc')).select(*names), f"{root}/set={k}", compression="gzip")
    return clean_snapshots(read_csv_files(spark, root).rows(RAW_COLUMNS))


def _part_files(spark, sf) -> str:
    """CSV text of ``part`` with quoted newlines, in files of two headers; one line in fifty has too many and one too few fields."""
    part = read_table(spark, sf, "part")
    key, name, size = F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit(' ""x"",\nline two\r\n"')), F.col("p_size").cast("string")
    group = (F.col("p_partkey") % 4).cast("int")
    good = F.when(group % 2 == 0, F.concat_ws(",", key, name, size)).otherwise(F.concat_ws(",", size, key, name))
    line = F.when(F.col("p_partkey") % 50 == 0, F.concat(good, F.lit(",more"))).when(F.col("p_partkey") % 50 == 1, F.concat_ws(",", key, F.lit("few"))).otherwise(good)
    rows = part.select(group.alias("g"), F.col("p_partkey").alias("seq"), line.alias("value"))
    heads = spark.createDataFrame([(g, -1, "part_key,title,size" if g % 2 == 0 else "size,part_key,title") for g in range(4)], "g int, seq long, value string")
    path = scratch_dir(spark, "csv-parts")
    rows.unionByName(heads).repartition("g").sortWithinPartitions("g", "seq").drop("seq").write.partitionBy("g").text(path)
    return path


def csv_quoted_newlines(spark, sf):
    rows = read_csv_files(spark, _part_files(spark, sf)).rows(["part_key", "title", "size"])
    return rows.select(F.col("part_key").cast("long").alias("part_key"), "title", F.col("size").cast("int").alias("size"))


def csv_quarantine(spark, sf):
    bad = read_csv_files(spark, _part_files(spark, sf)).bad()
    return bad.select("reason", "record", F.regexp_extract("file", r"/g=(\d+)/", 1).cast("int").alias("g"))


QUERIES = {f.__name__: f for f in (
    release_tables, release_order, release_page, release_browse, release_filtered_page, release_date_lookup, release_range_lookup, release_top_views, release_title_lookup,
    release_country_report, country_argument, catalog_tables, column_defaults, long_top_videos, pinned_last_wins, pinned_long_lists, trend_series_tags, trend_arrays,
    dirty_trend_series, month_labels, display_country_video_trends, nation_coverage, csv_by_header, csv_quoted_newlines, csv_quarantine)}


# ================================================================ oracles
def _placed(name: str) -> str:
    """A result's published columns with each row's place in its order."""
    columns = ", ".join(f"CAST({c} AS DECIMAL(10, 4)) AS {c}" if c in RESULT_TABLES[name].decimal_10_4 else c for c in RESULT_TABLES[name].columns)
    order = ", ".join(f"{c} ASC NULLS LAST" for c in RESULT_ORDER[name])
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position FROM {o.RESULT_CTE[name]}"


def _counts(*columns: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS table_name, {', '.join(c.format(n=n) for c in columns)} FROM {o.RESULT_CTE[n]}" for n in ANALYSES)


_CT, _VT, _TV = (_placed(n) for n in ("category_trends_over_time", "video_trends_over_time", "top10_videos_per_country"))
_TAG_LIST = "list_filter(list_transform(string_split(top5_tags, '|'), lambda x: trim(x)), lambda x: length(x) > 0)"
_LCT = f"""lct AS (
  SELECT {o.month_text()} AS date, trending_month AS m, video_category_id AS category, trending_appearances, top5_tags
  FROM leading_trends WHERE {C} = '{o.LOOKUP_COUNTRY}')"""
_PINNED = """category || '|' || date AS pos, category || '|' || date AS key, category, date,
       CAST(coalesce(trending_appearances, 0) AS BIGINT) AS trending_appearances"""
_ISO = "strftime(make_date(trending_year, trending_month, 1), '%Y-%m-%d')"

ORACLE_SQL = {
    "release_tables": o.on_results(final="SELECT table_name, 2 AS release, n_rows, appearances FROM (" + _counts("CAST(count(*) AS BIGINT) AS n_rows", "CAST(sum(trending_appearances) AS BIGINT) AS appearances") + ")"),
    "release_order": o.on_results(final="\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, position, {_order_text(n).replace('STRING', 'VARCHAR')} AS row_key FROM ({_placed(n)})" for n in ANALYSES)),
    "release_page": o.on_results(final=f"SELECT * FROM ({_CT}) WHERE position > (SELECT count(*) // 10 FROM category_trends) AND position <= (SELECT count(*) // 10 FROM category_trends) + 100"),
    "release_browse": o.on_results(final="SELECT * FROM category_trends WHERE video_category_id = 'Brand#11' ORDER BY video_trending_country, video_category_id, trending_year, trending_month LIMIT 25 OFFSET 90"),
    "release_filtered_page": o.on_results(final=f"SELECT * FROM ({_CT}) WHERE trending_year = {LATE_YEAR} ORDER BY position LIMIT 40 OFFSET 70"),
    "release_date_lookup": o.on_results(final=f"SELECT * FROM ({_CT}) WHERE trending_year = {LATE_YEAR} AND trending_month = {LATE_MONTH}"),
    "release_range_lookup": o.on_results(final=f"SELECT * FROM ({_VT}) WHERE video_view_count >= 50000 AND trending_year BETWEEN 1996 AND 1998"),
    "release_top_views": o.on_results(final=f"SELECT * FROM ({_VT}) WHERE video_view_count IS NOT NULL ORDER BY video_view_count DESC, position LIMIT 25"),
    "release_title_lookup": o.on_results(final=f"SELECT * FROM ({_TV}) WHERE video_title = (SELECT min(video_title) FROM top_videos)"),
    "release_country_report": o.on_results(o.CCT, o.CVT, final=f"""
SELECT 'top_channels' AS section, channel_title AS name, trending_appearances FROM top_channels WHERE {C} = '{o.LOOKUP_COUNTRY}'
UNION ALL SELECT 'top_categories', video_category_id, trending_appearances FROM top_categories WHERE {C} = '{o.LOOKUP_COUNTRY}'
UNION ALL SELECT 'top_videos', video_title, trending_appearances FROM top_videos WHERE {C} = '{o.LOOKUP_COUNTRY}'
UNION ALL SELECT 'category_trends', concat_ws('|', date, category), trending_appearances FROM cct
UNION ALL SELECT 'video_trends', concat_ws('|', date, video_title), trending_appearances FROM cvt"""),
    "country_argument": o.on_results(final=f"""SELECT nth, country, accepted, CASE WHEN accepted THEN (SELECT count(*) FROM top_categories t WHERE t.{C} = v.country) ELSE 0 END AS n_rows
FROM (VALUES (0, '{o.LOOKUP_COUNTRY}', true), (1, '', false), (2, '   ', false), (3, NULL, false), (4, 'NOWHERE', true)) v(nth, country, accepted)"""),
    "catalog_tables": o.on_results(final="SELECT table_name, n_rows, CAST(n_columns AS INTEGER) AS n_columns FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, {len(RESULT_TABLES[n].columns)} AS n_columns FROM {o.RESULT_CTE[n]}" for n in ANALYSES) + ")"),
    "column_defaults": o.on_results(final=f"""SELECT field, type, "null", "default", (SELECT count(*) FROM top_channels) AS n_values, least_value FROM (VALUES
  ('{C}', 'string', 'YES', NULL, NULL), ('channel_title', 'string', 'YES', NULL, NULL), ('note', 'string', 'YES', '''new''', 'new'),
  ('total_views', 'bigint', 'YES', '0', '0'), ('rank', 'int', 'YES', NULL, NULL)) v(field, type, "null", "default", least_value)"""),
    "long_top_videos": o.TOP_VIDEOS.replace("QUALIFY rank <= 10)", f"QUALIFY rank <= {LONG_LIST})"),
    "pinned_last_wins": o.on_results(*o.LEAD_CTES, _LCT, f"""seen AS (
  SELECT date, category, top5_tags, v AS version,
         CASE WHEN v = 2 AND m = 6 THEN NULL ELSE trending_appearances - 100 * v END AS trending_appearances
  FROM lct, (VALUES (0), (1), (2)) t(v) WHERE v <= CASE WHEN m % 3 = 0 THEN 2 WHEN m % 3 = 1 THEN 1 ELSE 0 END)""",
        final=f"""SELECT {_PINNED}, nullif(array_to_string(({_TAG_LIST})[1:5], '|'), '') AS top5_tags
FROM (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY category, date ORDER BY version DESC) = 1)"""),
    "pinned_long_lists": o.on_results(*o.LEAD_CTES, _LCT, final=f"""SELECT {_PINNED}, array_to_string(({_TAG_LIST})[1:5], '|') AS top5_tags
FROM (SELECT * REPLACE (' first ||' || coalesce(top5_tags, '') || '| six |seven' AS top5_tags) FROM lct)"""),
    "trend_series_tags": o.on_results(*o.LEAD_CTES, final=f"""SELECT {C}, video_category_id,
       CAST(row_number() OVER (PARTITION BY {C}, video_category_id ORDER BY make_date(trending_year, trending_month, 1)) AS INTEGER) AS point_index,
       make_date(trending_year, trending_month, 1) AS date, CAST(coalesce(trending_appearances, 0) AS DOUBLE) AS value,
       coalesce(array_to_string({_TAG_LIST}, '|'), '') AS tags
FROM leading_trends"""),
    "trend_arrays": o.on_results(*o.LEAD_CTES, final=f"""SELECT {C}, video_category_id, CAST(count(*) AS INTEGER) AS n_points,
       string_agg({_ISO} || '=' || CAST(coalesce(trending_appearances, 0) AS VARCHAR) || ':' || coalesce(array_to_string({_TAG_LIST}, '+'), ''), ';' ORDER BY trending_year, trending_month) AS points
FROM leading_trends GROUP BY {C}, video_category_id"""),
    "dirty_trend_series": o.on_results(final=f"""SELECT {C}, video_category_id AS category,
       CAST(row_number() OVER (PARTITION BY {C}, video_category_id ORDER BY trending_year, trending_month) AS INTEGER) AS point_index,
       make_date(trending_year, trending_month, 1) AS date, CAST(trending_appearances AS DOUBLE) AS value
FROM category_trends WHERE trending_month % 6 IN (0, 1)"""),
    "month_labels": o.on_daily(o.with_ctes(final="""SELECT DISTINCT video_trending_date, strftime(trending_date, '%Y-%m') AS of_date, strftime(trending_date, '%Y-%m') AS of_time,
       CAST(NULL AS VARCHAR) AS of_text FROM msnap""")),
    "display_country_video_trends": o.DISPLAY_VIDEO_TRENDS.replace(f"SELECT {C}, strftime", "SELECT strftime") + f" WHERE {C} = '{o.LOOKUP_COUNTRY}'",
    "nation_coverage": o.on_results(final=f"""SELECT name, nation_key, has_channels, has_categories, has_videos, has_channels OR has_categories OR has_videos AS has_data
FROM (SELECT n_name AS name, n_nationkey AS nation_key,
        n_name IN (SELECT channel_country FROM snap WHERE channel_title IN (SELECT channel_title FROM top_channels WHERE rank <= 2)) AS has_channels,
        n_name IN (SELECT channel_country FROM snap WHERE video_category_id = 'Brand#11' AND video_view_count > {MANY_VIEWS}) AS has_categories,
        n_name IN (SELECT channel_country FROM snap WHERE channel_title IN (SELECT channel_title FROM top_videos WHERE rank <= 2)) AS has_videos
      FROM nation)"""),
    "csv_by_header": o.with_ctes(final="SELECT * REPLACE (CASE WHEN length(video_id) % 3 = 2 THEN NULL ELSE channel_view_count END AS channel_view_count) FROM snap"),
    "csv_quoted_newlines": """SELECT p_partkey AS part_key, p_name || ' "x",' || chr(10) || 'line two' || chr(13) || chr(10) AS title, p_size AS size
FROM part WHERE p_partkey % 50 NOT IN (0, 1)""",
    "csv_quarantine": """SELECT 'the fields do not fit the header' AS reason, CAST(g AS INTEGER) AS g,
       CASE WHEN p_partkey % 50 = 1 THEN k || ',few' WHEN g % 2 = 0 THEN k || ',' || t || ',' || s || ',more' ELSE s || ',' || k || ',' || t || ',more' END AS record
FROM (SELECT p_partkey, p_partkey % 4 AS g, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS s,
             '"' || p_name || ' ""x"",' || chr(10) || 'line two' || chr(13) || chr(10) || '"' AS t FROM part)
WHERE p_partkey % 50 IN (0, 1)""",
}
