from __future__ import annotations

import csv

import frames
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirstats import schema as S
from dirstats.operators.cleaning import clean_listings, with_features
from dirstats.sources import readers, staging, writers


def raw_csv(path, rows, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as out:
        writer = csv.DictWriter(out, S.RAW.fieldNames())
        writer.writeheader()
        writer.writerows({**frames.RAW_DEFAULTS, **row} for row in rows)
    return str(path)


ROWS = [
    {"name": 'The "Old" Inn, North', "reviews_list": 'said "good,\nvery good"\nagain'},
    {"name": "NA", "rate": "NEW", "votes": ""},
    {"name": "Last", "dish_liked": "null", "votes": 7},
]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig"])
def test_raw_csv(spark, tmp_path, encoding):
    path = raw_csv(tmp_path / "raw.csv", ROWS, encoding)
    rows = readers.read_raw(spark, path, ordinal="n").orderBy("n").collect()
    assert [r.name for r in rows] == ['The "Old" Inn, North', None, "Last"]
    assert rows[0].reviews_list == 'said "good,\nvery good"\nagain'
    assert [r.votes for r in rows] == [10, None, 7]
    assert rows[2].dish_liked is None


def test_null_tokens_are_a_parameter(spark, tmp_path):
    path = raw_csv(tmp_path / "raw.csv", ROWS)
    rows = readers.read_raw(spark, path, null_tokens=("",)).collect()
    assert "NA" in {r.name for r in rows}


def test_csv_with_other_columns_is_refused(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("location,lat,longitude\nx,1.0,2.0\n")
    with pytest.raises(Exception, match="header"):
        readers.read_coordinates(spark, str(path)).collect()


def test_coordinates_with_commas(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('location,latitude,longitude\n"Main Road, East",12.9,77.7\n')
    assert tuple(readers.read_coordinates(spark, str(path)).first()) == (
        "Main Road, East",
        12.9,
        77.7,
    )


def test_result_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('"tier","jump",bucket\n"Budget",NULL,1\n"NA","0.07",2\n')
    schema = (
        T.StructType()
        .add("tier", T.StringType())
        .add("jump", T.DoubleType())
        .add("bucket", T.IntegerType())
    )
    rows = [tuple(r) for r in readers.read_result(spark, str(path), schema).collect()]
    assert rows == [("Budget", None, 1), ("NA", 0.07, 2)]


def test_raw_csv_to_written_listings_and_back(spark, tmp_path):
    raw = readers.read_raw(spark, raw_csv(tmp_path / "raw.csv", ROWS), ordinal="n")
    listings = with_features(clean_listings(raw, ["n"]))
    folder = str(tmp_path / "listings")
    writers.write_csv(listings, folder, sort_by=["name"])
    back = readers.read_listings(spark, folder)
    assert back.schema.simpleString() == listings.schema.simpleString()
    report = writers.verify_written(listings, back).first()
    assert tuple(report) == (3, 3, 16, True, 0, 0)


def test_verify_notices_differences(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert tuple(writers.verify_written(a, b).first()) == (3, 2, 1, True, 2, 1)


def test_parquet_sink_and_pruned_scan(spark, tmp_path):
    df = frames.entities(spark, {}, {"location": "South", "rate": 2.0})
    path = str(tmp_path / "e")
    writers.write_parquet(df, path, partition_by=["location"], sort_by=["name"])
    back = readers.read_table(spark, path).filter("location = 'South' AND rate > 1").select("votes")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(location" in plan and "GreaterThan(rate,1.0)" in plan
    assert "ReadSchema: struct<rate:double,votes:bigint>" in plan
    assert back.count() == 1


def test_listings_csv_with_a_byte_order_mark(spark, tmp_path):
    writers.write_csv(frames.listings(spark, {}).coalesce(1), str(tmp_path / "l"))
    (part,) = (tmp_path / "l").glob("*.csv")
    marked = tmp_path / "marked.csv"
    marked.write_text("\ufeff" + part.read_text(encoding="utf-8"), encoding="utf-8")
    assert readers.read_listings(spark, str(marked)).first().name == "Cafe"


def test_entities_csv(spark, tmp_path):
    df = frames.entities(spark, {"rate": None}, {"name": 'a "b", c'})
    writers.write_csv(df, str(tmp_path / "e"))
    back = readers.read_entities(spark, str(tmp_path / "e"))
    assert writers.verify_written(df, back).first().rows_missing == 0


def test_replace_table_and_sql(spark):
    for rows in ([{}, {}], [{"votes": 3}]):
        writers.replace_table(frames.entities(spark, *rows), "entities_sink")
    table = spark.table("entities_sink")
    assert table.count() == 1
    found = readers.sql_over(spark, "SELECT sum(votes) AS v FROM {e}", {"e": table}).first()
    assert found.v == 3
    check = writers.table_check(frames.listings(spark, {}, {"location": "South", "rate": None}))
    assert tuple(check.first()) == (2, 2, 1, 3.9, 500, 500)


def test_write_results(spark, tmp_path):
    ordered = spark.range(5).orderBy(F.desc("id"))
    writers.write_results({"a": ordered, "b": spark.range(1)}, str(tmp_path))
    assert [r.id for r in spark.read.csv(f"{tmp_path}/a", header=True).collect()] == list("43210")
    assert spark.read.csv(f"{tmp_path}/b", header=True).count() == 1


def test_several_files_are_in_order_of_their_paths(spark, tmp_path):
    rows = [{"name": f"n{i}", "votes": i, "reviews_list": 'a "b",\nc'} for i in range(60)]
    whole = readers.read_raw(spark, raw_csv(tmp_path / "all.csv", rows), ordinal="n")
    (tmp_path / "parts").mkdir()
    for k, (at, end) in enumerate([(0, 3), (3, 50), (50, 60)]):
        raw_csv(tmp_path / "parts" / f"{k}.csv", rows[at:end])
    parts = readers.read_raw(spark, str(tmp_path / "parts"), ordinal="n")
    names = [[r.name for r in df.orderBy("n").collect()] for df in (whole, parts)]
    assert names[0] == names[1] == [f"n{i}" for i in range(60)]
    clean = [clean_listings(df, ["n"]).orderBy("name").collect() for df in (whole, parts)]
    assert clean[0] == clean[1]


def test_malformed_records_stay_with_a_note(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('location,latitude,longitude\na,1.5,2\nb,1.0\n"c, d",x,y\ne,,3\nf,1,2,3\n')
    rows = readers.read_csv(spark, str(path), S.COORD, malformed="bad", ordinal="n")
    found = {r.n: (r.location, r.latitude, r.bad) for r in rows.collect()}
    assert found == {
        0: ("a", 1.5, None),
        1: (None, None, "fields: b,1.0"),
        2: ("c, d", None, "value: latitude=x, longitude=y"),
        3: ("e", None, None),
        4: (None, None, "fields: f,1,2,3"),
    }
    assert tuple(readers.malformed_report(rows, "bad").first()) == (5, 2, 2, 1)
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_coordinates(spark, str(path)).collect()


def test_csv_keeps_white_space(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 1.0, 2.0), ('"q", ', None, -0.1)], S.COORD)
    writers.write_csv(df, str(tmp_path / "x"))
    back = readers.read_coordinates(spark, str(tmp_path / "x"))
    assert writers.verify_written(df, back).first()[3:] == (True, 0, 0)


def test_a_failed_write_keeps_the_old_table(spark, monkeypatch):
    name = "kept_table"
    writers.replace_table(spark.range(3), name)
    broken = spark.range(5).select(
        F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")).alias("id")
    )
    with pytest.raises(Exception):  # noqa: B017  its text depends on the task that fails first
        writers.replace_table(broken, name)
    assert spark.table(name).count() == 3 and not spark.catalog.tableExists(f"{name}__new")
    verify = writers.verify_written
    with monkeypatch.context() as m, pytest.raises(writers.NotWritten):
        m.setattr(writers, "verify_written", lambda a, b: verify(a, b.filter("id < 3")))
        writers.replace_table(spark.range(5), name)
    assert spark.table(name).count() == 3
    writers.replace_table(spark.table(name).select((F.col("id") + 1).alias("id")), name)
    assert sorted(r.id for r in spark.table(name).collect()) == [1, 2, 3]
    spark.sql(f"DROP TABLE {name}")


def test_verify_compares_types_and_columns(spark):
    a = spark.sql("SELECT 1 AS k, timestamp '2020-01-01 00:00:00.123456' AS t")
    assert not writers.verify_written(a, a.withColumn("k", F.col("k").cast("long"))).first()[3]
    assert not writers.verify_written(a, a.drop("k")).first().same_columns
    b = spark.sql("SELECT 1 AS k, timestamp '2020-01-01 00:00:00.123999' AS t")
    assert writers.verify_written(a, b).first().rows_missing == 1


def test_staging_writes_once_into_the_shared_folder(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    first = staging.staged_once(spark, "k", "t", build)
    again = staging.staged_once(spark, "k", "t", build)
    assert first.count() == again.count() == 3 and calls == [1]
    folder = staging.shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured.rstrip("/")
    assert all(folder in f for f in first.inputFiles())
