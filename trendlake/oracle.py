"""Oracle SQL for DuckDB: each registered query written independently.  The
driver runs these next to the Spark operators and compares rows.

Every query starts from the ``trending_raw`` view (FIXTURE_SQL) over the
driver's tables and repeats cleaning in SQL.  Counts are cast to BIGINT and
ranks / years / months to INTEGER so the types line up with Spark's.
"""

from __future__ import annotations

from trendlake.fixtures import DAILY_SQL, DRAFT_SQL, FIXTURE_SQL

C = "video_trending_country"

SNAP = f"""
trending_raw AS (
{FIXTURE_SQL}
),
snap AS (
  SELECT video_id, video_published_at, video_trending__date AS video_trending_date,
         video_trending_country, video_title, video_category_id, video_tags, video_duration,
         TRY_CAST(video_view_count AS BIGINT) AS video_view_count,
         TRY_CAST(video_like_count AS BIGINT) AS video_like_count,
         TRY_CAST(video_comment_count AS BIGINT) AS video_comment_count,
         channel_id,
         TRY_CAST(channel_subscriber_count AS BIGINT) AS channel_subscriber_count,
         channel_country, channel_title, channel_custom_url,
         TRY_CAST(channel_view_count AS BIGINT) AS channel_view_count,
         TRY_CAST(channel_video_count AS BIGINT) AS channel_video_count
  FROM trending_raw
  WHERE video_id IS NOT NULL AND video_published_at IS NOT NULL
    AND video_view_count IS NOT NULL
    AND lower(video_category_id) NOT IN ('true', 'false')
),
msnap AS (
  SELECT *, CAST(year(trending_date) AS INTEGER) AS trending_year,
         CAST(month(trending_date) AS INTEGER) AS trending_month
  FROM (SELECT *, CAST(try_strptime(video_trending_date, '%Y.%m.%d') AS DATE) AS trending_date
        FROM snap)
)"""


def with_ctes(*ctes: str, final: str) -> str:
    body = ",\n".join([SNAP, *ctes])
    return f"WITH {body}\n{final}"


def on_daily(sql: str) -> str:
    """The same query over the daily view (fixtures.daily_raw)."""
    return sql.replace(FIXTURE_SQL, DAILY_SQL, 1)


# ---------------------------------------------------------------- R0
CLEAN = with_ctes(final="SELECT * FROM snap")

# ---------------------------------------------------------------- R2
CAT_CTES = (
    f"""top_categories AS (
  SELECT {C}, video_category_id, CAST(sum(n) AS BIGINT) AS trending_appearances,
         CAST(sum(v) AS BIGINT) AS total_views, CAST(round(avg(v), 0) AS BIGINT) AS avg_views,
         CAST(sum(l) AS BIGINT) AS total_likes,
         CAST(row_number() OVER (PARTITION BY {C} ORDER BY sum(n) DESC, sum(v) DESC NULLS LAST,
              video_category_id) AS INTEGER) AS rank
  FROM (SELECT {C}, video_category_id, video_id, count(*) AS n, max(video_view_count) AS v,
               max(video_like_count) AS l
        FROM snap WHERE {C} IS NOT NULL AND video_category_id IS NOT NULL GROUP BY ALL)
  GROUP BY {C}, video_category_id
  QUALIFY rank <= 10)""",
)
TOP_CATEGORIES = with_ctes(*CAT_CTES, final="SELECT * FROM top_categories")

# ---------------------------------------------------------------- R1
CH_CTES = (
    f"""top_channels AS (
  SELECT {C}, channel_title, min(url) AS channel_custom_url, video_category_id,
         CAST(sum(n) AS BIGINT) AS trending_appearances, CAST(sum(v) AS BIGINT) AS total_views,
         CAST(count(*) AS BIGINT) AS total_videos, CAST(max(subs) AS BIGINT) AS channel_subscribers,
         CAST(max(seen) AS BIGINT) AS channel_view_count,
         CAST(row_number() OVER (PARTITION BY {C} ORDER BY sum(n) DESC, sum(v) DESC NULLS LAST,
              channel_title, video_category_id) AS INTEGER) AS rank
  FROM (SELECT {C}, channel_title, video_category_id, video_id, count(*) AS n,
               max(video_view_count) AS v, max(channel_subscriber_count) AS subs,
               max(channel_view_count) AS seen, min(channel_custom_url) AS url
        FROM snap
        WHERE {C} IS NOT NULL AND channel_title IS NOT NULL AND video_category_id IS NOT NULL
        GROUP BY ALL)
  GROUP BY {C}, channel_title, video_category_id
  QUALIFY rank <= 10)""",
)
TOP_CHANNELS = with_ctes(*CH_CTES, final="SELECT * FROM top_channels")

# ---------------------------------------------------------------- R3 / F1
ENGAGEMENT = (
    "CASE WHEN video_view_count > 0 THEN round((coalesce(video_like_count, 0) + "
    "coalesce(video_comment_count, 0)) / video_view_count * 100, 4) ELSE 0.0 END"
)


def _best(columns: str, then: str) -> str:
    """The row of most views as a struct; equal views fall to the columns of ``then``, ascending."""
    order = ", ".join(f"{c.strip()} ASC NULLS LAST" for c in then.split(","))
    fields = ", ".join(f"{c.strip()} := {c.strip()}" for c in columns.split(","))
    return f"first(struct_pack({fields}) ORDER BY video_view_count DESC NULLS LAST, {order})"


PEAK_FIELDS = (
    "video_view_count, video_trending_date, video_category_id, video_title, engagement_rating, "
    "channel_title, video_duration"
)
PEAK = _best(PEAK_FIELDS, PEAK_FIELDS.removeprefix("video_view_count, "))
VID_CTES = (
    f"""peak_snapshots AS (
  SELECT video_id, {C}, p.video_category_id, p.video_title, p.channel_title, p.video_duration,
         p.video_view_count, p.engagement_rating, p.video_trending_date AS peak_trending_date,
         CASE WHEN {C} IS NOT NULL THEN n END AS trending_appearances
  FROM (SELECT video_id, {C}, CAST(count(*) AS BIGINT) AS n, {PEAK} AS p
        FROM (SELECT *, {ENGAGEMENT} AS engagement_rating FROM snap)
        GROUP BY video_id, {C}))""",
    f"""top_videos AS (
  SELECT * EXCLUDE (video_id),
         CAST(row_number() OVER (PARTITION BY {C} ORDER BY trending_appearances DESC NULLS LAST,
              video_view_count DESC NULLS LAST, video_id) AS INTEGER) AS rank
  FROM peak_snapshots QUALIFY rank <= 10)""",
)
TOP_VIDEOS = with_ctes(*VID_CTES, final="SELECT * FROM top_videos")
PEAK_SNAPSHOTS = with_ctes(*VID_CTES, final="SELECT * FROM peak_snapshots")
ENGAGEMENT_ROWS = with_ctes(
    final=f"""SELECT video_id, {C}, video_trending_date, video_view_count, video_like_count,
       video_comment_count, {ENGAGEMENT} AS engagement_rating FROM snap"""
)

# ---------------------------------------------------------------- P6
TRENDING_MONTHS = with_ctes(
    final=f"""SELECT video_id, {C}, video_trending_date, trending_date, trending_year, trending_month
FROM msnap"""
)

# ---------------------------------------------------------------- R4
TK = f"{C}, video_category_id, trending_year, trending_month"
# The characters that become a space, and the one that is removed.
TAG_SPACES = "'|,;' || chr(10) || chr(13) || chr(9)"
TAG_DROPPED = "chr(34)"
MONTH_ROWS = f"(SELECT * FROM msnap WHERE {C} IS NOT NULL AND video_category_id IS NOT NULL AND trending_year IS NOT NULL)"

TAG_CTES = (
    f"""tag_counts AS (
  SELECT {TK}, regexp_replace(translate(tag, {TAG_SPACES} || {TAG_DROPPED}, repeat(' ', 6)), '\\s+', ' ', 'g') AS tag,
         CAST(count(*) AS BIGINT) AS tag_count
  FROM (SELECT {TK}, trim(unnest(string_split(lower(video_tags), ','))) AS tag FROM {MONTH_ROWS})
  WHERE length(tag) > 1
  GROUP BY ALL
  HAVING length(regexp_replace(translate(tag, {TAG_SPACES} || {TAG_DROPPED}, repeat(' ', 6)), '\\s+', ' ', 'g')) > 1)""",
    f"""top_tags AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {TK} ORDER BY tag_count DESC, tag) AS INTEGER) AS tag_rank
  FROM tag_counts QUALIFY tag_rank <= 5)""",
)
CT_CTES = (
    *TAG_CTES,
    f"""category_trends AS (
  SELECT * FROM (
    SELECT {TK}, CAST(sum(n) AS BIGINT) AS trending_appearances, CAST(sum(v) AS BIGINT) AS total_views
    FROM (SELECT {TK}, video_id, count(*) AS n, max(video_view_count) AS v FROM {MONTH_ROWS} GROUP BY ALL)
    GROUP BY {TK})
  LEFT JOIN (SELECT {TK}, string_agg(tag, '|' ORDER BY tag_rank) AS top5_tags FROM top_tags GROUP BY {TK})
  USING ({TK}))""",
)
TAG_COUNTS = with_ctes(*TAG_CTES, final="SELECT * FROM tag_counts")
TOP_TAGS = with_ctes(*TAG_CTES, final="SELECT * FROM top_tags")
CATEGORY_TRENDS = with_ctes(*CT_CTES, final="SELECT * FROM category_trends")

# ---------------------------------------------------------------- R5
VK = f"{C}, trending_year, trending_month"
MONTH_FIELDS = (
    "video_view_count, video_title, video_category_id, channel_title, video_like_count, "
    "video_comment_count, video_duration"
)
MONTH_PEAK = _best(MONTH_FIELDS, MONTH_FIELDS.removeprefix("video_view_count, "))
VT_CTES = (
    f"""video_trends AS (
  SELECT {VK}, {", ".join("p." + f for f in MONTH_FIELDS.split(", "))}, n AS trending_appearances
  FROM (SELECT video_id, {VK}, CAST(count(*) AS BIGINT) AS n, {MONTH_PEAK} AS p
        FROM msnap WHERE {C} IS NOT NULL AND trending_year IS NOT NULL GROUP BY video_id, {VK})
  QUALIFY row_number() OVER (PARTITION BY {VK}
          ORDER BY n DESC, p.video_view_count DESC NULLS LAST, video_id) = 1)""",
)
VIDEO_TRENDS = with_ctes(*VT_CTES, final="SELECT * FROM video_trends")


# ================================================================ serving layer
ALL_RESULT_CTES = (*CAT_CTES, *CH_CTES, *VID_CTES, *CT_CTES, *VT_CTES)
LOOKUP_COUNTRY = "ASIA"
BROWSE_COUNTRY = "EUROPE"


def on_results(*ctes: str, final: str) -> str:
    return with_ctes(*ALL_RESULT_CTES, *ctes, final=final)


def month_text(y: str = "trending_year", m: str = "trending_month") -> str:
    return f"strftime(make_date({y}, {m}, 1), '%Y-%m-%d')"


COUNTRY_TOP_CHANNELS = on_results(final=f"SELECT * FROM top_channels WHERE {C} = '{LOOKUP_COUNTRY}'")
COUNTRY_TOP_CATEGORIES = on_results(final=f"SELECT * FROM top_categories WHERE {C} = '{LOOKUP_COUNTRY}'")
COUNTRY_TOP_VIDEOS = on_results(final=f"SELECT * FROM top_videos WHERE {C} = '{LOOKUP_COUNTRY}'")
CCT = f"""cct AS (
  SELECT {month_text()} AS date, video_category_id AS category, trending_appearances, top5_tags
  FROM category_trends WHERE {C} = '{LOOKUP_COUNTRY}')"""
CVT = f"""cvt AS (
  SELECT {month_text()} AS date, video_title, video_category_id AS category, channel_title,
         video_view_count, video_like_count, video_comment_count, video_duration, trending_appearances
  FROM video_trends WHERE {C} = '{LOOKUP_COUNTRY}')"""
COUNTRY_CATEGORY_TRENDS = on_results(CCT, final="SELECT * FROM cct")
COUNTRY_VIDEO_TRENDS = on_results(CVT, final="SELECT * FROM cvt")
BROWSE_TABLE = on_results(
    final=f"""SELECT * FROM category_trends WHERE {C} = '{BROWSE_COUNTRY}'
ORDER BY {C} ASC NULLS LAST, video_category_id ASC NULLS LAST, trending_year ASC NULLS LAST,
         trending_month ASC NULLS LAST
LIMIT 50 OFFSET 10"""
)
READONLY_SQL_TEXT = (
    "SELECT video_trending_country, count(*) AS n_categories, sum(total_views) AS total_views "
    "FROM top10_categories_per_country GROUP BY video_trending_country"
)
READONLY_SQL = on_results(
    final=f"""SELECT {C}, CAST(count(*) AS BIGINT) AS n_categories, CAST(sum(total_views) AS BIGINT) AS total_views
FROM top_categories GROUP BY {C}"""
)

# ================================================================ explorer
LEAD_CTES = (
    f"""lead_tot AS (
  SELECT {C}, video_category_id, sum(coalesce(trending_appearances, 0)) AS total_appearances,
         min(trending_year * 12 + trending_month) AS first_month
  FROM category_trends WHERE video_category_id IS NOT NULL AND video_category_id <> ''
  GROUP BY {C}, video_category_id)""",
    f"""lead_cats AS (
  SELECT {C}, video_category_id, CAST(total_appearances AS BIGINT) AS total_appearances,
         CAST(rank AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {C}
          ORDER BY total_appearances DESC, first_month ASC, video_category_id ASC) AS rank
        FROM lead_tot) WHERE rank <= 5)""",
    f"""leading_trends AS (
  SELECT t.* FROM category_trends t
  WHERE EXISTS (SELECT 1 FROM lead_cats l WHERE l.{C} = t.{C} AND l.video_category_id = t.video_category_id))""",
)
LEADING_CATEGORIES = on_results(*LEAD_CTES, final="SELECT * FROM lead_cats")
LEADING_CATEGORY_TRENDS = on_results(*LEAD_CTES, final="SELECT * FROM leading_trends")
VIDEO_CATEGORIES = on_results(
    final=f"""SELECT DISTINCT {C}, video_category_id FROM video_trends
WHERE video_category_id IS NOT NULL AND video_category_id <> ''"""
)


def _domain(src: str) -> str:
    return f"""SELECT {C}, min(make_date(trending_year, trending_month, 1)) AS min_date,
       max(make_date(trending_year, trending_month, 1)) AS max_date,
       CASE WHEN max(coalesce(trending_appearances, 0)) = 0 THEN 1.0
            ELSE CAST(max(coalesce(trending_appearances, 0)) AS DOUBLE) END AS max_value,
       greatest(CASE WHEN max(coalesce(trending_appearances, 0)) = 0 THEN 1.0
            ELSE CAST(max(coalesce(trending_appearances, 0)) AS DOUBLE) END * CAST(1.1 AS DOUBLE), 1.0) AS y_max
FROM {src} GROUP BY {C}"""


SERIES_DOMAIN = on_results(*LEAD_CTES, final=_domain("leading_trends"))
VIDEO_SERIES_DOMAIN = on_results(final=_domain("video_trends"))
TREND_SERIES = on_results(
    *LEAD_CTES,
    final=f"""SELECT {C}, video_category_id,
       CAST(row_number() OVER (PARTITION BY {C}, video_category_id
            ORDER BY make_date(trending_year, trending_month, 1)) AS INTEGER) AS point_index,
       make_date(trending_year, trending_month, 1) AS date,
       CAST(coalesce(trending_appearances, 0) AS DOUBLE) AS value
FROM leading_trends""",
)
PINNED_CATEGORIES = on_results(
    *LEAD_CTES,
    f"""lct AS (
  SELECT {month_text()} AS date, video_category_id AS category, trending_appearances, top5_tags
  FROM leading_trends WHERE {C} = '{LOOKUP_COUNTRY}')""",
    final="""SELECT date || '|' || category AS pos, category || '|' || date AS key, category, date,
       CAST(coalesce(trending_appearances, 0) AS BIGINT) AS trending_appearances,
       nullif(array_to_string(list_filter(list_transform(string_split(top5_tags, '|'), lambda x: trim(x)),
                                   lambda x: length(x) > 0)[1:5], '|'), '') AS top5_tags
FROM lct""",
)
PINNED_VIDEOS = on_results(
    CVT,
    final="""SELECT date AS pos, coalesce(video_title, '') || '|' || date AS key, video_title, category,
       channel_title, date,
       CAST(coalesce(video_view_count, 0) AS BIGINT) AS video_view_count,
       CAST(coalesce(video_like_count, 0) AS BIGINT) AS video_like_count,
       CAST(coalesce(video_comment_count, 0) AS BIGINT) AS video_comment_count,
       video_duration, CAST(coalesce(trending_appearances, 0) AS BIGINT) AS trending_appearances
FROM cvt""",
)
CATEGORY_SHARE = on_results(
    final=f"""SELECT *, (CAST(coalesce(total_views, 0) AS DOUBLE)
        / max(CAST(coalesce(total_views, 0) AS DOUBLE)) OVER (PARTITION BY {C})) * 100 AS share_pct
FROM top_categories"""
)

# ================================================================ formatting


def fmt_count(x: str) -> str:
    """Compact count text with exact integer half-up rounding to one decimal."""

    def scaled(power: int, suffix: str) -> str:
        unit = 10 ** (power - 1)
        tenths = f"(({x} + {unit // 2}) // {unit})"
        return (
            f"CAST({tenths} // 10 AS VARCHAR) || CASE WHEN {tenths} % 10 = 0 THEN '' "
            f"ELSE '.' || CAST({tenths} % 10 AS VARCHAR) END || '{suffix}'"
        )

    return (
        f"CASE WHEN {x} IS NULL OR {x} < 0 THEN '0' "
        f"WHEN {x} >= 1000000000 THEN {scaled(9, 'B')} "
        f"WHEN {x} >= 1000000 THEN {scaled(6, 'M')} "
        f"WHEN {x} >= 1000 THEN {scaled(3, 'K')} "
        f"ELSE CAST({x} AS VARCHAR) END"
    )


def fmt_engagement(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE CAST(round(CAST({x} AS DECIMAL(18, 4)), 2) AS VARCHAR) || '%' END"


def fmt_duration(x: str) -> str:
    u = f"upper(trim({x}))"
    part = "nullif(regexp_extract({u}, '(\\d+){unit}', 1), '') || '{suf}'"
    parts = ", ".join(part.format(u=u, unit=a, suf=b) for a, b in (("H", "h"), ("M", "m"), ("S", "s")))
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN NOT starts_with({u}, 'PT') THEN {x} "
        f"ELSE nullif(concat_ws(' ', {parts}), '') END"
    )


def fmt_link(x: str, host: str = "https://youtube.com") -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN starts_with({x}, 'http') THEN {x} "
        f"WHEN starts_with({x}, '/') THEN '{host}' || {x} "
        f"WHEN starts_with({x}, '@') THEN '{host}/' || {x} ELSE '{host}/@' || {x} END"
    )


FORMAT_DURATION = with_ctes(
    final=f"SELECT DISTINCT video_duration, {fmt_duration('video_duration')} AS duration_text FROM snap"
)
FORMAT_COUNT = with_ctes(
    final=f"""SELECT DISTINCT video_view_count, channel_view_count,
       {fmt_count('video_view_count')} AS views_text, {fmt_count('channel_view_count')} AS channel_views_text
FROM snap"""
)
FORMAT_ENGAGEMENT = with_ctes(
    *VID_CTES,
    final=f"SELECT DISTINCT engagement_rating, {fmt_engagement('engagement_rating')} AS engagement_text FROM peak_snapshots",
)
CHANNEL_LINK = with_ctes(
    final=f"SELECT DISTINCT channel_custom_url, {fmt_link('channel_custom_url')} AS link FROM snap"
)
PARSE_TAGS = on_results(
    final=f"""SELECT {C}, video_category_id, trending_year, trending_month,
       CAST(generate_subscripts(tags, 1) AS INTEGER) AS tag_pos, unnest(tags) AS tag
FROM (SELECT *, list_filter(list_transform(string_split(top5_tags, '|'), lambda x: trim(x)), lambda x: length(x) > 0) AS tags
      FROM category_trends WHERE top5_tags IS NOT NULL)"""
)
DISPLAY_VIDEOS = on_results(
    final=f"""SELECT {C},
       CAST(row_number() OVER (PARTITION BY {C} ORDER BY trending_appearances DESC NULLS LAST, rank ASC) AS INTEGER) AS display_rank,
       coalesce(nullif(video_title, ''), 'Untitled Video') AS title,
       coalesce(nullif(channel_title, ''), 'Unknown Channel') AS channel,
       video_category_id AS category,
       {fmt_count('coalesce(video_view_count, 0)')} AS views_text,
       {fmt_engagement('engagement_rating')} AS engagement_text,
       CAST(coalesce(trending_appearances, 0) AS VARCHAR) || 'x' AS trending_text
FROM top_videos"""
)
DISPLAY_CHANNELS = on_results(
    final=f"""SELECT {C}, rank, coalesce(channel_title, 'null') AS title, {fmt_link('channel_custom_url')} AS link,
       CASE WHEN channel_subscribers > 0 THEN {fmt_count('channel_subscribers')} || ' subs' END AS subscribers_text,
       video_category_id AS category,
       {fmt_count('coalesce(total_views, 0)')} AS total_views_text,
       {fmt_count('coalesce(total_videos, 0)')} AS total_videos_text,
       CAST(coalesce(trending_appearances, 0) AS VARCHAR) || 'x' AS trending_text
FROM top_channels"""
)

# ================================================================ dimension
ENRICH_COUNTRY = on_results(
    final=f"""SELECT t.*, r.r_regionkey AS region_key FROM top_categories t
LEFT JOIN region r ON t.{C} = r.r_name"""
)
COUNTRY_COVERAGE = on_results(
    final=f"""SELECT r.r_name AS name, r.r_regionkey AS region_key,
       coalesce(a.f, false) AS has_channels, coalesce(b.f, false) AS has_categories,
       coalesce(c.f, false) AS has_videos,
       coalesce(a.f, false) OR coalesce(b.f, false) OR coalesce(c.f, false) AS has_data
FROM region r
LEFT JOIN (SELECT DISTINCT {C} AS k, true AS f FROM top_channels) a ON r.r_name = a.k
LEFT JOIN (SELECT DISTINCT {C} AS k, true AS f FROM top_categories) b ON r.r_name = b.k
LEFT JOIN (SELECT DISTINCT {C} AS k, true AS f FROM top_videos) c ON r.r_name = c.k"""
)
COUNTRIES_WITHOUT_DATA = on_results(
    final="""SELECT n.n_name AS name, n.n_nationkey AS nation_key FROM nation n
WHERE n.n_name NOT IN (
  SELECT DISTINCT s.channel_country FROM snap s
  WHERE s.channel_title IN (SELECT channel_title FROM top_channels) AND s.channel_country IS NOT NULL)"""
)
SEARCH_TERM = "Wid"
SEARCH_NAMES = f"""SELECT name, substr(name, 1, p - 1) AS match_before, substr(name, p, {len(SEARCH_TERM)}) AS match_hit,
       substr(name, p + {len(SEARCH_TERM)}) AS match_after
FROM (SELECT p_name AS name, strpos(lower(p_name), lower('{SEARCH_TERM}')) AS p FROM part
      WHERE contains(lower(p_name), lower('{SEARCH_TERM}'))
      ORDER BY name ASC NULLS LAST LIMIT 8)"""


# ================================================================ constraints
RESULT_CTE = {
    "top10_channels_per_country": "top_channels",
    "top10_categories_per_country": "top_categories",
    "top10_videos_per_country": "top_videos",
    "category_trends_over_time": "category_trends",
    "video_trends_over_time": "video_trends",
}


def _summary_sql() -> str:
    from trendlake.schema import RESULT_TABLES

    parts = []
    for name, spec in RESULT_TABLES.items():
        src = RESULT_CTE[name]

        def row(check: str, col: str, bad: str) -> str:
            return (
                f"SELECT '{name}' AS table_name, '{check}' AS check_name, '{col}' AS column_name, "
                f"CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS violations FROM {src}"
            )

        for c in dict.fromkeys([*spec.not_null, *spec.primary_key]):
            parts.append(row("not_null", c, f"{c} IS NULL"))
        for c in spec.month_columns:
            parts.append(row("month_range", c, f"{c} IS NOT NULL AND NOT ({c} BETWEEN 1 AND 12)"))
        for c in spec.varchar255:
            parts.append(row("varchar_255", c, f"length(CAST({c} AS VARCHAR)) > 255"))
        for c in spec.decimal_10_4:
            parts.append(row("decimal_10_4", c, f"{c} IS NOT NULL AND TRY_CAST({c} AS DECIMAL(10, 4)) IS NULL"))
        pk = ", ".join(spec.primary_key)
        parts.append(
            f"SELECT '{name}' AS table_name, 'primary_key' AS check_name, '{','.join(spec.primary_key)}' AS column_name, "
            f"CAST(count(*) AS BIGINT) AS violations FROM (SELECT {pk} FROM {src} GROUP BY {pk} HAVING count(*) > 1)"
        )
    return "\nUNION ALL\n".join(parts)


CONSTRAINT_SUMMARY = on_results(final=_summary_sql())



def _violations_sql() -> str:
    key = f"{C}, video_id, trending_month"
    found = []
    for check, column, bad in (
        ("not_null", "video_category_id", "video_category_id IS NULL"),
        ("month_range", "trending_month", "trending_month > 12 OR trending_month < 1"),
        ("varchar_255", "video_title", "length(video_title) > 255"),
        ("decimal_10_4", "engagement_rating", "abs(engagement_rating) >= 1000000"),
    ):
        found.append(
            f"SELECT '{check}' AS check_name, '{column}' AS column_name, {key}, CAST({column} AS VARCHAR) AS value, "
            f"count(*) AS n FROM drafts WHERE {bad} GROUP BY {key}, {column}"
        )
    found.append(
        f"SELECT 'primary_key', '{key.replace(' ', '')}', {key}, CAST(count(*) AS VARCHAR), count(*) "
        f"FROM drafts GROUP BY {key} HAVING count(*) > 1"
    )
    union = "\nUNION ALL\n".join(found)
    return f"""SELECT 'drafts' AS table_name, check_name, column_name,
       concat({C}, '|', video_id, '|', trending_month) AS row_key, value, CAST(n AS BIGINT) AS "rows"
FROM ({union})"""


CHECK_CONSTRAINTS = with_ctes(f"drafts AS ({DRAFT_SQL})", final=_violations_sql())

# ================================================================ sinks
NORMALIZE_RESULTS = on_results(
    final=f"""SELECT {C}, video_title, channel_title, CAST(video_view_count AS VARCHAR) AS video_view_count,
       CAST(trending_appearances AS DOUBLE) AS trending_appearances, CAST(rank AS VARCHAR) AS rank
FROM top_videos"""
)
PUBLISH_AND_LOOKUP = on_results(
    final=f"""SELECT {C}, video_category_id, video_title, channel_title, video_duration, video_view_count,
       CAST(engagement_rating AS DECIMAL(10, 4)) AS engagement_rating, trending_appearances,
       peak_trending_date, rank
FROM top_videos WHERE {C} = '{LOOKUP_COUNTRY}'"""
)

# ================================================================ more display
DISPLAY_CATEGORIES = on_results(
    final=f"""SELECT {C}, rank, video_category_id AS category,
       (CAST(coalesce(total_views, 0) AS DOUBLE)
        / max(CAST(coalesce(total_views, 0) AS DOUBLE)) OVER (PARTITION BY {C})) * 100 AS bar_pct,
       {fmt_count('coalesce(total_views, 0)')} AS total_views_text,
       {fmt_count('coalesce(avg_views, 0)')} AS avg_views_text,
       {fmt_count('coalesce(total_likes, 0)')} AS likes_text,
       CAST(coalesce(trending_appearances, 0) AS VARCHAR) || 'x' AS trending_text
FROM top_categories"""
)
DISPLAY_VIDEO_TRENDS = on_results(
    final=f"""SELECT {C}, strftime(make_date(trending_year, trending_month, 1), '%Y-%m') AS month,
       coalesce(nullif(video_title, ''), 'Top Video') AS title,
       coalesce(nullif(channel_title, ''), '—') AS channel,
       coalesce({fmt_duration('video_duration')}, '—') AS duration_text,
       {fmt_count('coalesce(video_view_count, 0)')} AS views_text,
       {fmt_count('coalesce(video_like_count, 0)')} AS likes_text,
       {fmt_count('coalesce(video_comment_count, 0)')} AS comments_text,
       coalesce(trending_appearances, 0) AS trending_appearances
FROM video_trends"""
)

# ================================================================ sighting summary
SK = f"{C}, video_category_id, channel_title, video_id, trending_year, trending_month, video_tags"


def _peak_columns(prefix: str, fields: str) -> str:
    return ", ".join(f"{prefix}.{f} AS {prefix}_{f}" for f in fields.split(", ") if f not in ("video_category_id", "channel_title"))


SIGHTING_SUMMARY = with_ctes(
    final=f"""SELECT {SK}, CAST(sightings AS BIGINT) AS sightings, max_views, max_likes, max_subscribers,
       max_channel_views, min_custom_url, {_peak_columns('peak_video', PEAK_FIELDS)},
       {_peak_columns('peak_month', MONTH_FIELDS)}
FROM (SELECT {SK}, count(*) AS sightings, max(video_view_count) AS max_views,
             max(video_like_count) AS max_likes, max(channel_subscriber_count) AS max_subscribers,
             max(channel_view_count) AS max_channel_views, min(channel_custom_url) AS min_custom_url,
             {PEAK} AS peak_video, {MONTH_PEAK} AS peak_month
      FROM (SELECT *, {ENGAGEMENT} AS engagement_rating FROM msnap) GROUP BY {SK})"""
)
