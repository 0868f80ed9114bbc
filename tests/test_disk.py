"""What stays on disk while a chain of tables is written."""

import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from trendlake import fixtures, store_queries
from trendlake.fixtures import trending_raw
from trendlake.operators import clean_snapshots, sighting_summary
from trendlake.operators.summary import SIGHTINGS, is_summary
from trendlake.plans import physical_plan
from trendlake.plans.ordering import asc, rank_by_range
from trendlake.session import scratch_dir
from trendlake.sources import export_csv, publish, read_csv_files, write_by_key, write_ordered, write_snapshots

from tests.conftest import SF_SMALL

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks))


WRITES = {
    "write_snapshots": lambda df, path: write_snapshots(df, path),
    "write_by_key": lambda df, path: write_by_key(df, path, ["k"]),
    "export_csv": lambda df, path: export_csv(df, path, sort_by=["k"]),
    "publish": lambda df, path: publish(df, "some_table", path, partition_by=()),
    "write_ordered": lambda df, path: write_ordered(df, path, [asc("k")], zones=["k"], blooms=["n"], tops=["n"], files=3),
    "rank_by_range": lambda df, path: rank_by_range(df, ["n"], [asc("k")]),
}


@pytest.mark.parametrize("name", WRITES)
def test_shuffle_files_go_when_their_table_is_written(spark, name):
    df = spark.range(20_000).withColumn("k", F.col("id") % 5_000).groupBy("k").agg(F.count("*").alias("n"))
    before, own = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    WRITES[name](df, scratch_dir(spark, "dropped"))
    assert spark.conf.get(CLEANUP, None) == own
    for _ in range(50):  # the files go a moment later
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left


def test_the_setting_is_put_back_after_a_failed_write(spark):
    spark.conf.set(CLEANUP, "false")
    try:
        with pytest.raises(Exception):
            write_snapshots(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), scratch_dir(spark, "failed"))
        assert spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)


def test_the_view_deals_its_rows_out_twice_at_most(spark, monkeypatch):
    def rows_and_deals():
        df = trending_raw(spark, SF_SMALL)
        deals = physical_plan(df, "simple").count("Exchange hashpartitioning(l_")
        return sorted(map(tuple, df.collect()), key=str), deals

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        rows, deals = rows_and_deals()
        assert deals == 2  # by order and by part, the widest one by supplier is spared
        monkeypatch.setattr(fixtures, "SENT_BYTES", 0)
        assert rows_and_deals() == (rows, 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_month_and_year_are_not_sent_with_the_date(spark):
    path = scratch_dir(spark, "cleaned")
    write_snapshots(clean_snapshots(trending_raw(spark, SF_SMALL)), path)
    plan = physical_plan(sighting_summary(spark.read.parquet(path)), "simple").splitlines()
    at = next(k for k, line in enumerate(plan) if "Exchange" in line)
    assert not any("trending_year" in line or "trending_month" in line for line in plan[at + 1:])


def test_store_queries_summarise_a_written_cleaned_table(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(store_queries, "sighting_summary", lambda snap, *a: plans.append(physical_plan(snap, "simple")) or sighting_summary(snap, *a))
    assert store_queries._summary(spark, SF_SMALL).agg(F.sum(SIGHTINGS)).first()[0] == E.snapshots(spark, SF_SMALL).count()
    assert len(plans) == 1 and "Join" not in plans[0] and "Exchange" not in plans[0]


@pytest.mark.parametrize("query", ["country_coverage", "constraint_summary"])
def test_the_rankings_of_a_query_share_one_pass_over_the_snapshots(spark, monkeypatch, query):
    seen, views = [], []
    for name in ("top_channels", "top_categories", "top_videos"):
        monkeypatch.setattr(E, name, lambda snap, op=getattr(E, name): seen.append(is_summary(snap)) or op(snap))
    monkeypatch.setattr(E, "clean_snapshots", lambda raw: views.append(raw) or clean_snapshots(raw))
    monkeypatch.setattr(E, "sighting_summary", lambda snap, *a: seen.append("Join" not in physical_plan(snap, "simple")) or sighting_summary(snap, *a))
    E.queries()[query](spark, SF_SMALL).collect()
    assert seen == [True] * 4 and len(views) == 1


def test_compressed_csv_is_read_back_by_header(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.concat(F.lit(' a "b",\n'), F.col("id") % 7).alias("t"))
    root = scratch_dir(spark, "gz")
    export_csv(df, f"{root}/set=0", compression="gzip")
    export_csv(df.select("t", "id"), f"{root}/set=1")
    names = [r[0] for r in spark.read.format("binaryFile").load(f"{root}/set=0").select("path").collect()]
    assert names and all(n.endswith(".csv.gz") for n in names)
    files = read_csv_files(spark, root)
    assert len(files.headers) == 2 and files.bad().isEmpty()
    want = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, files.rows(["id", "t"]).collect())) == sorted([*want, *want])


def test_csv_by_header_keeps_its_files_compressed(spark, monkeypatch):
    used = []
    monkeypatch.setattr(store_queries, "export_csv", lambda df, path, **o: used.append(o.get("compression")) or export_csv(df, path, **o))
    store_queries.csv_by_header(spark, SF_SMALL)
    assert used == ["gzip"] * 3
