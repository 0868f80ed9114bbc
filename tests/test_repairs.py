"""Cases from review: CSV headers, read-only SQL, lazy building."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from trendlake.operators.catalog import ReadOnlyViolation, readonly_sql
from trendlake.operators.explore import category_share
from trendlake.operators.rankings import top_categories
from trendlake.plans import physical_plan
from trendlake.sources import read_snapshots_csv


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_files_with_another_column_order_do_not_swap_columns(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("video_id,video_title\nv1,t1\n")
    (tmp_path / "b.csv").write_text("video_title,video_id\nt2,v2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_snapshots_csv(spark, str(tmp_path), multi_line=multi_line).select("video_id", "video_title").collect()


@pytest.mark.parametrize("sql", [
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM range(1)",
    "SELECT `reflect`('java.lang.Math', 'abs', -1)",
    "SELECT reflect/**/('java.lang.Math', 'abs', -1)",
    "SELECT (SELECT java_method('java.lang.Math', 'abs', -1)) AS x",
])
def test_readonly_sql_refuses_scripts_and_reflection(spark, sql):
    with pytest.raises(ReadOnlyViolation):
        readonly_sql(spark, sql)


def test_category_share_computes_its_list_once(spark):
    plan = physical_plan(category_share(top_categories(E.snapshots(spark, SF_SMALL))))
    once = physical_plan(top_categories(E.snapshots(spark, SF_SMALL)))
    assert plan.count("FileScan parquet") == once.count("FileScan parquet")
