"""CSV files read in splits, each by its own header, against Python's csv module and one-task reads."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from trendlake.jobs import refresh_release
from trendlake.operators.explore import pinned_points, trend_series, trend_series_arrays
from trendlake.schema import RAW_COLUMNS
from trendlake.sources import csv_files, open_release, read_csv_files, read_results_csv

from tests.conftest import snap_row

VALUES = ["a", 'q"x', "m\nl", "", "c,d", " sp ", "é\r\nz", '"', "x" * 30, "\n\n", "1", "日本\n", '""', ",\n,"]


@pytest.fixture
def tiny_splits(spark):
    """Splits of 64 bytes, so that most records cross a border."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def write(path, head, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end, quoting=quoting)
        w.writerow(head)
        w.writerows(rows)


def random_files(folder, seed):
    rnd, rows = random.Random(seed), {}
    for name, head, end, quoting in (("a", ["id", "t", "u"], "\n", csv.QUOTE_MINIMAL), ("b", ["u", "id", "t"], "\r\n", csv.QUOTE_MINIMAL), ("c", ["t", "extra", "id"], "\n", csv.QUOTE_ALL)):
        mine = [{h: f"{name}{k}" if h == "id" else rnd.choice(VALUES) for h in head} for k in range(40)]
        write(f"{folder}/{name}.csv", head, [[r[h] for h in head] for r in mine], end, quoting)
        rows |= {r["id"]: (r.get("t") or None, r.get("u") or None) for r in mine}
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_three_headers_in_many_splits(spark, tmp_path, tiny_splits, seed):
    want = random_files(tmp_path, seed)
    files = read_csv_files(spark, str(tmp_path))
    assert len(files.headers) == 3 and files.parsed.rdd.getNumPartitions() > 20
    got = {r.id: (r.t or None, r.u or None) for r in files.rows(["id", "t", "u"]).collect()}
    assert got == want and files.bad().count() == 0


def test_splits_equal_the_one_task_read(spark, tmp_path, tiny_splits):
    random_files(tmp_path, 9)
    many = read_csv_files(spark, f"{tmp_path}/a.csv")
    one = spark.read.options(header="true", quote='"', escape='"', multiLine="true").csv(f"{tmp_path}/a.csv")
    assert one.rdd.getNumPartitions() == 1 < many.parsed.rdd.getNumPartitions()
    assert sorted(map(str, many.rows(["id", "t", "u"]).collect())) == sorted(map(str, one.collect()))


def test_each_record_is_joined_and_parsed_once(spark, tmp_path):
    random_files(tmp_path, 4)
    rows = read_csv_files(spark, str(tmp_path)).rows(["id", "t", "u"]).where("id is not null and lower(t) <> 'x'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 and plan.count("MapInArrow") == 1


def test_positions_are_byte_offsets_in_input_order(spark, tmp_path, tiny_splits):
    random_files(tmp_path, 2)
    rows = read_csv_files(spark, f"{tmp_path}/b.csv").rows(["id"], position=True).orderBy("file", "offset").collect()
    assert [r.id for r in rows] == [f"b{k}" for k in range(40)]
    raw = (tmp_path / "b.csv").read_bytes()
    for r in rows:
        record = next(csv.reader(io.StringIO(raw[r.offset:].decode(), newline="")))
        assert r.id in record


def test_misfits_are_set_aside_with_file_and_offset(spark, tmp_path, tiny_splits):
    text = 'id,t\n1,a\n2,b,c\n3\n\n   \n"4","x\n\ny"\n5,"never closed\nand on\n'
    (tmp_path / "a.csv").write_text(text)
    files = read_csv_files(spark, str(tmp_path))
    assert sorted((r.id, r.t) for r in files.rows(["id", "t"]).collect()) == [("1", "a"), ("4", "x\n\ny")]
    bad = {r.record: (r.offset, r.reason, r.file.rpartition("/")[2]) for r in files.bad().collect()}
    assert bad["2,b,c"] == (text.index("2,b"), "the fields do not fit the header", "a.csv")
    assert bad["3"] == (text.index("3\n"), "the fields do not fit the header", "a.csv")
    assert [v[:2] for k, v in bad.items() if k.startswith("5,")] == [(text.index('5,"'), "a quote is not closed")]
    padded = read_csv_files(spark, str(tmp_path), short_rows="pad")
    assert ("3", None) in {(r.id, r.t) for r in padded.rows(["id", "t"]).collect()}
    assert "2,b,c" in {r.record for r in padded.bad().collect()}
    with pytest.raises(ValueError):
        read_csv_files(spark, str(tmp_path), short_rows="drop")


def test_headers_with_marks_newlines_and_bounds(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('﻿id,"two\nlines"\n1,x\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('\n"two\nlines",id\r\ny,2\r\n')
    (tmp_path / "c.csv").write_text("")
    files = read_csv_files(spark, str(tmp_path))
    assert set(files.headers) == {("id", "two\nlines"), ("two\nlines", "id")}
    assert sorted(tuple(r) for r in files.rows(["id", "two\nlines", "none"]).collect()) == [("1", "x", None), ("2", "y", None)]
    monkeypatch.setattr(csv_files, "MAX_HEADERS", 1)
    with pytest.raises(ValueError, match="headers"):
        read_csv_files(spark, str(tmp_path))


def test_long_records_are_set_aside(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("id,t\n1," + "y" * 500 + "\n2,\"" + "z\n" * 300 + '"\n3,w\n')
    files = read_csv_files(spark, str(tmp_path), max_record_bytes=200)
    assert [r.id for r in files.rows(["id"]).collect()] == ["3"]
    bad = files.bad().orderBy("offset").collect()
    assert [(r.reason, r.record) for r in bad] == [("the record is too long", None)] * 2 and bad[0].offset == 5


def test_refresh_from_files_of_two_headers(spark, tmp_path):
    source, out = tmp_path / "raw", tmp_path / "out"
    source.mkdir()
    rows = [snap_row(video_id=f"v{k}", video_title=f"t\n{k}") for k in range(6)]
    for k, head in enumerate((RAW_COLUMNS, RAW_COLUMNS[::-1])):
        write(source / f"{k}.csv", head, [[r[c] or "" for c in head] for r in rows[k::2]])
    with open(source / "1.csv", "a") as f:
        f.write("broken,row\n")
    release = refresh_release(spark, str(source), str(out), "csv")
    assert release.number == 1 and sum(r.trending_appearances for r in release.rows("top10_categories_per_country").collect()) == 6
    assert [r.record for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["broken,row"]
    assert open_release(spark, f"{out}/results").rows("top10_videos_per_country").count() == 6


def test_the_last_row_of_a_key_counts(spark):
    rows = [(k, "2024-01-01", "c", 10 - k, "a|b") for k in range(4)] + [(9, "2024-02-01", "c", None, None)]
    df = spark.createDataFrame(rows, "position long, date string, category string, trending_appearances long, top5_tags string").repartition(3)
    keys = ["c|2024-02-01", "missing|2024-01-01", "c|2024-01-01"]
    got = [(r.pos, r.key, r.trending_appearances, r.top5_tags) for r in pinned_points(df, keys, position=["position"]).collect()]
    assert got == [(0, "c|2024-02-01", 0, []), (2, "c|2024-01-01", 7, ["a", "b"])]


def test_points_carry_their_tags(spark):
    df = spark.createDataFrame([("A", "2024-02-01", "m", 3, '["x"," y "]'), ("A", "2024-01-01T00:00", "m", 4, "p| q |"), ("A", "bad", "m", 5, "z"), ("A", "2024-03-01", "m", 6, None)],
                               "video_trending_country string, date string, category string, trending_appearances long, top5_tags string")
    points = trend_series(df, "category", tags="top5_tags").orderBy("point_index").collect()
    assert [(p.point_index, p.value, p.tags) for p in points] == [(1, 4.0, ["p", "q"]), (2, 3.0, ["x", "y"]), (3, 6.0, [])]
    assert [p.tags for p in trend_series_arrays(df, "category", tags="top5_tags").first().points] == [["p", "q"], ["x", "y"], []]
    assert "tags" not in trend_series(df, "category").columns and trend_series_arrays(df, "category").select(F.explode("points").alias("p")).select("p.*").columns == ["date", "value"]


def test_results_in_splits_equal_the_one_task_read(spark, tmp_path, tiny_splits):
    (tmp_path / "r.csv").write_text('Country,Views,note\nUS,5,"a\nb"\n\nDE\n"J""P",7,\n' + 'X,1,"y, ""z"""\n' * 20)
    schema = "country string, views long, note string, more int"
    both = [read_results_csv(spark, str(tmp_path), spark.createDataFrame([], schema).schema, {"Country": "country", "Views": "views"}, in_splits=x) for x in (False, True)]
    assert both[0].columns == both[1].columns and sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
