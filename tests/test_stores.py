"""Ordered tables, releases, catalog versions and ranks of any length."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trendlake.operators.catalog import describe_table, list_all_tables, list_tables
from trendlake.operators.lookups import browse
from trendlake.plans.ordering import asc, desc, rank_by_range, top_k_per_group
from trendlake.schema import RESULT_TABLES
from trendlake.session import scratch_dir
from trendlake.sources import open_ordered, open_release, publish, publish_release, releases, sinks, sweep, write_ordered

SCHEMA = "country string, year int, views long, title string"


def some_rows(n=400, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice(["A", "B", "Ç", None]), rnd.choice([1995, 1996, 1997, None]), rnd.choice([None, rnd.randrange(10_000)]), f"t{k}" if k % 9 else None) for k in range(n)]


ORDER = [asc("country"), desc("views"), asc("title"), asc("year")]


def plain(rows):
    key = lambda r: ((r[0] is None, r[0] or ""), (r[2] is None, -(r[2] or 0)), (r[3] is None, r[3] or ""), (r[1] is None, r[1] or 0))
    return [(*r, k + 1) for k, r in enumerate(sorted(rows, key=key))]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA).repartition(3)
    return write_ordered(df, scratch_dir(spark, "ordered"), ORDER, zones=["country", "year", "views"], blooms=["title"], tops=["views"], files=16)


@pytest.fixture(scope="module")
def want():
    return plain(some_rows())


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_positions_follow_the_order(table, want):
    assert sorted(tuples(table.with_position()), key=lambda r: r[-1]) == want
    assert table.index.count() > 8


def test_pages_equal_the_plain_sort(table, want):
    for limit, offset in ((10, 0), (25, 190), (7, 395), (50, 390), (5, 400), (0, 3), (400, 0)):
        assert tuples(table.page(limit, offset)) == want[offset:offset + limit]
    for country in ("B", None, "missing"):
        mine = [r for r in want if r[0] == country]
        for limit, offset in ((9, 0), (10, 33), (10, 10_000)):
            assert tuples(table.page(limit, offset, {"country": country})) == mine[offset:offset + limit]
    with pytest.raises(ValueError):
        table.page(-1)
    with pytest.raises(KeyError):
        table.page(5, 0, {"nope": 1})


def test_browsing_a_table_in_order(table, want):
    assert tuples(browse(table, limit="6", offset="210")) == [r[:-1] for r in want[210:216]]
    assert tuples(browse(table, {"country": "A"}, limit=3, offset=5)) == [r[:-1] for r in want if r[0] == "A"][5:8]
    for bad in ({"limit": 10**9}, {"offset": -1}, {"order_by": ["views"]}):
        with pytest.raises(ValueError):
            browse(table, **bad)
    with pytest.raises(KeyError):
        browse(table, {"position": 1})


def test_a_deep_page_reads_the_files_it_overlaps(table):
    files = table.index.count()
    assert len(table.page(5, 200).inputFiles()) <= 2
    assert len(table.page(5, 40, {"country": "B"}).inputFiles()) <= 2 < files


def test_lookups_equal_the_filter_and_open_few_files(table, want):
    files = table.index.count()
    for equal, between, keep in (
        ({"country": "A"}, {}, lambda r: r[0] == "A"),
        ({"country": None, "year": 1996}, {}, lambda r: r[0] is None and r[1] == 1996),
        ({}, {"views": (9_000, None)}, lambda r: r[2] is not None and r[2] >= 9_000),
        ({"country": "Ç"}, {"views": (None, 500), "year": (1995, 1996)}, lambda r: r[0] == "Ç" and r[2] is not None and r[2] <= 500 and r[1] in (1995, 1996)),
        ({"title": "t7"}, {}, lambda r: r[3] == "t7"),
        ({"title": None}, {}, lambda r: r[3] is None),
    ):
        assert sorted(tuples(table.lookup(equal, between)), key=lambda r: r[-1]) == [r for r in want if keep(r)]
    assert table.files_for({"title": "t7"}).count() <= 3 < files
    assert table.files_for({"title": "no such title"}).count() <= 2
    assert table.files_for(between={"views": (9_900, None)}).count() < files / 2
    assert table.files_for({"country": "A"}).count() < files / 2


def test_greatest_values(table, want):
    greatest = sorted((r for r in want if r[2] is not None), key=lambda r: (-r[2], r[-1]))
    for k in (1, 12, 60, 1_000):
        assert tuples(table.top("views", k)) == greatest[:k]
    assert table.top_files("views", 3).count() <= table.index.count() / 2


def test_empty_ordered_table(spark):
    path = scratch_dir(spark, "ordered-empty")
    empty = write_ordered(spark.createDataFrame([], SCHEMA), path, ORDER, ["year"], ["title"], ["views"])
    assert empty.page(5).count() == empty.lookup({"title": "x"}).count() == empty.top("views", 3).count() == empty.with_position().count() == 0
    assert open_ordered(spark, path).columns == ["country", "year", "views", "title"]


# ------------------------------------------------------------------- releases
RANKED = "video_trending_country string, video_category_id string, trending_appearances bigint, total_views bigint, avg_views bigint, total_likes bigint, rank int"
NAMES = sorted(RESULT_TABLES)


def five(spark, value):
    out = {}
    for name, spec in RESULT_TABLES.items():
        fields = [F.lit("US" if f.dataType.simpleString() == "string" else value).cast(f.dataType).alias(f.name) for f in spec.schema.fields]
        out[name] = spark.range(1).select(*fields)
    return out


def values(release):
    return {n: release.rows(n).first()["trending_appearances"] for n in release.paths}


def test_a_run_that_fails_between_two_tables_leaves_five_old_ones(spark):
    root = scratch_dir(spark, "store")
    assert open_release(spark, root).number == 0
    publish_release(spark, root, five(spark, 1))
    broken = five(spark, 2)
    third = "top10_videos_per_country"
    broken[third] = broken[third].withColumn("rank", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        publish_release(spark, root, broken)
    release = open_release(spark, root)
    assert release.number == 1 and values(release) == dict.fromkeys(NAMES, 1)


def test_readers_keep_their_release_and_partial_runs_carry_the_rest(spark):
    root = scratch_dir(spark, "store")
    publish_release(spark, root, five(spark, 1))
    held = open_release(spark, root)
    name = "video_trends_over_time"
    publish_release(spark, root, {name: five(spark, 2)[name]})
    assert values(held) == dict.fromkeys(NAMES, 1)
    assert values(open_release(spark, root)) == {**dict.fromkeys(NAMES, 1), name: 2}
    assert values(open_release(spark, root, 1)) == dict.fromkeys(NAMES, 1)
    for bad in (3, 0):
        with pytest.raises(KeyError):
            open_release(spark, root, bad)
    with pytest.raises(KeyError):
        held.table("other")


def test_two_publishers_at_a_time_both_succeed(spark, monkeypatch):
    root = scratch_dir(spark, "store")
    publish_release(spark, root, five(spark, 1))
    stale, calls, real = open_release(spark, root), [], open_release
    other = "top10_channels_per_country"
    publish_release(spark, root, {other: five(spark, 7)[other]})  # takes number 2 first

    def late(spark, root, number=None):
        calls.append(1)
        return stale if len(calls) == 1 else real(spark, root, number)

    monkeypatch.setattr(releases, "open_release", late)
    name = "video_trends_over_time"
    made = publish_release(spark, root, {name: five(spark, 9)[name]})
    monkeypatch.undo()
    assert made.number == 3 and len(calls) == 2
    assert values(open_release(spark, root)) == {**dict.fromkeys(NAMES, 1), other: 7, name: 9}


def test_sweep_keeps_what_is_named_or_young(spark):
    root = scratch_dir(spark, "store")
    small = {"top10_categories_per_country": five(spark, 0)["top10_categories_per_country"]}
    for _ in range(4):
        publish_release(spark, root, small)
    assert [x for x in sweep(spark, root, keep=2, grace_hours=1) if x.startswith("versions/")] == []
    gone = sweep(spark, root, keep=1, grace_hours=0)
    assert len([x for x in gone if x.startswith("versions/")]) == 3
    assert open_release(spark, root).number == 4 and open_release(spark, root).rows("top10_categories_per_country").count() == 1
    with pytest.raises(ValueError):
        sweep(spark, root, keep=0)


# ------------------------------------------------------------------- catalog
def test_catalog_versions(spark):
    name = "top10_categories_per_country"
    row = lambda n: spark.createDataFrame([("01", "c", n, 2, 3, 4, 1)], RANKED)
    for n in range(4):
        publish(row(n), name)
        assert [(r.video_trending_country, r.trending_appearances) for r in spark.table(name).collect()] == [("01", n)]
    with pytest.raises(Exception, match="empty video_trending_country"):
        publish(spark.createDataFrame([("", "c", 9, 2, 3, 4, 1)], RANKED), name)
    assert spark.table(name).first().trending_appearances == 3
    versions = [t.name for t in spark.catalog.listTables() if sinks.VERSION_SUFFIX.search(t.name) and t.name.startswith(name)]
    assert len(versions) == sinks.KEPT_VERSIONS
    assert [r.table_name for r in list_tables(spark).collect()].count(name) == 1
    assert not any(sinks.VERSION_SUFFIX.search(r.table_name) for r in list_all_tables(spark).collect())
    assert ("default", name) in {(r.database, r.table_name) for r in list_all_tables(spark).collect()}
    plan = spark.table(name).filter("video_trending_country = '01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(video_trending_country" in plan


def test_an_unset_warehouse_is_refused_on_a_cluster(spark, monkeypatch):
    import os

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key: f"file:{os.getcwd()}/spark-warehouse")

    with pytest.raises(RuntimeError, match="warehouse"):
        sinks._shared_warehouse(Cluster)
    Cluster.conf.get = staticmethod(lambda key: "hdfs://shared/warehouse/")
    assert sinks._shared_warehouse(Cluster) == "hdfs://shared/warehouse"


def test_versions_lie_in_the_checkpoint_location_if_the_warehouse_is_unset(tmp_path):
    import os

    settings = {"spark.sql.warehouse.dir": f"file:{os.getcwd()}/spark-warehouse", "spark.checkpoint.dir": f"{tmp_path}/"}

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: settings.get(key, default))

    for master in ("spark://host:7077", "local-cluster[3,4,10240]"):
        Cluster.sparkContext.master = master
        assert sinks._version_root(Cluster) == f"{tmp_path}/warehouse"
    settings["spark.sql.warehouse.dir"] = "hdfs://shared/warehouse"
    assert sinks._version_root(Cluster) == "hdfs://shared/warehouse"
    settings.update({"spark.sql.warehouse.dir": f"file:{os.getcwd()}/spark-warehouse", "spark.checkpoint.dir": None})
    Cluster.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="warehouse"):
        sinks._version_root(Cluster)


def test_declared_defaults_are_described(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS with_defaults (a INT DEFAULT 7, b STRING DEFAULT 'x', c INT) USING parquet")
    assert [(r.field, r.default) for r in describe_table(spark, "with_defaults").collect()] == [("a", "7"), ("b", "'x'"), ("c", None)]


# ------------------------------------------------------------------- long ranks
def test_ranks_by_range_equal_the_window(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["x", None]), rnd.choice([None, rnd.randrange(50)]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, h string, v int, id long").repartition(5)
    order = [desc("v"), asc("id")]
    window = df.withColumn("rank", F.row_number().over(Window.partitionBy("g", "h").orderBy(*[o.as_sort_column() for o in order])))
    assert sorted(map(str, rank_by_range(df, ["g", "h"], order).collect())) == sorted(map(str, window.collect()))
    long = top_k_per_group(df, ["g"], order, 1_500, rank_col="nth")
    assert long.columns == [*df.columns, "nth"] and long.count() == 900
    assert rank_by_range(df.limit(0), ["g"], order).count() == 0


def test_a_hot_group_is_spread_over_the_partitions(spark, monkeypatch):
    seen = []
    real = scratch_dir
    monkeypatch.setattr("trendlake.plans.ordering.scratch_dir", lambda s, n: seen.append(real(s, n)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 90_000
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("g"), F.xxhash64("id").alias("v"), "id")
        top = top_k_per_group(df, ["g"], [desc("v"), asc("id")], 20_000)
        assert top.where("g = -1").count() == 20_000 and top.where("g <> -1").count() == n - n // 3
        assert top.where("g = -1").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first() == (1, 20_000, 20_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in spark.read.parquet(seen[0]).groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * n / 8
