from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from evenstep.errors import DataSourceError
from evenstep.operators.cleaning import clean, clean_audit, duplicate_stamps
from evenstep.sources.observations import observations, read_csv, read_table


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv_is_read_typed_and_in_any_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Datetime,LOAD,extra\n2020-01-01 01:00:00,2,x\n2020-01-01 00:00:00,1.5,y\n")
    df = read_csv(spark, path, "Datetime", "LOAD", keep=("extra",))
    assert dict(df.dtypes) == {"series_id": "string", "ts": "timestamp_ntz", "value": "double", "extra": "string"}
    assert [r.value for r in df.collect()] == [2.0, 1.5]


def test_missing_file_names_the_path(spark, tmp_path):
    with pytest.raises(DataSourceError, match="nowhere.csv"):
        read_csv(spark, str(tmp_path / "nowhere.csv"), "Datetime", "LOAD")


def test_missing_columns_are_listed_sorted_beside_those_found(spark, tmp_path):
    path = write(tmp_path / "a.csv", "when,amount\n2020-01-01,1\n")
    with pytest.raises(DataSourceError, match=r"\['LOAD', 'Stamp'\].*\['when', 'amount'\]"):
        read_csv(spark, path, "Stamp", "LOAD")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_malformed_text_fails_the_query(spark, tmp_path, ansi):
    path = write(tmp_path / "a.csv", "Datetime,LOAD\nyesterday,1\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException, match="yesterday"):
            read_csv(spark, path, "Datetime", "LOAD").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_texts_for_missing_become_null(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Datetime,LOAD\n2020-01-01,NaN\n2020-01-02,\n2020-01-03,NA\n,4\n")
    got = read_csv(spark, path, "Datetime", "LOAD").collect()
    assert [r.value for r in got] == [None, None, None, 4.0]
    assert got[3].ts is None


def test_nan_is_null_from_the_scan_on(spark):
    df = spark.createDataFrame([("2020-01-01", float("nan")), ("2020-01-02", 1.0)], "t string, v double")
    assert [r.value for r in observations(df, "t", "v").collect()] == [None, 1.0]


def test_parquet_source(spark, tmp_path, ramp):
    ramp(5).write.parquet(str(tmp_path / "p"))
    assert read_table(spark, str(tmp_path / "p"), "ts", "value", "series_id").count() == 5
    with pytest.raises(DataSourceError, match="gone"):
        read_table(spark, str(tmp_path / "gone"), "ts", "value")


def test_repeated_stamps_are_averaged(spark):
    t = datetime(2014, 11, 2, 2)
    raw = spark.createDataFrame(
        [("all", t, 22935.0), ("all", t, 23755.0), ("all", datetime(2014, 11, 2, 3), 20000.0)],
        "series_id string, ts timestamp_ntz, value double",
    )
    assert rows(clean(raw)) == [("all", t, 23345.0), ("all", datetime(2014, 11, 2, 3), 20000.0)]
    assert rows(duplicate_stamps(raw)) == [("all", 1)]


def test_clean_skips_missing_readings_keeps_gaps_and_drops_null_stamps(spark):
    t0, t3 = datetime(2020, 1, 1), datetime(2020, 1, 1, 3)
    raw = spark.createDataFrame(
        [("a", t0, None), ("a", t0, 4.0), ("a", t3, None), ("a", None, 9.0), ("b", t0, float("nan"))],
        "series_id string, ts timestamp_ntz, value double",
    )
    assert rows(clean(raw)) == [("a", t0, 4.0), ("a", t3, None), ("b", t0, None)]
    assert rows(clean_audit(raw)) == [("a", 4, 2, 1, 1), ("b", 1, 1, 0, 0)]


def test_stamp_must_be_a_wall_clock(spark):
    df = spark.sql("select 'a' series_id, timestamp'2020-01-01 00:00:00' ts, 1D value")
    with pytest.raises(DataSourceError, match="timestamp_ntz"):
        clean(df)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path / "a b.csv", "Datetime,LOAD,OTHER\n2020-01-01 00:00:00,1,100\n")
    write(tmp_path / "b[1].csv", "\nDatetime,OTHER,LOAD\n2020-01-01 01:00:00,200,2\n")
    write(tmp_path / "c.csv", '"LOAD","extra, quoted",Datetime,OTHER\n3,x,2020-01-01 02:00:00,300\n')
    write(tmp_path / "d.csv", "Datetime,LOAD,OTHER\n2020-01-01 03:00:00,4,400\n")
    (tmp_path / "empty.csv").touch()
    got = read_csv(spark, str(tmp_path), "Datetime", "LOAD", keep=("OTHER",)).collect()
    assert sorted((r.ts.hour, r.value, r.OTHER) for r in got) == [(0, 1.0, "100"), (1, 2.0, "200"), (2, 3.0, "300"), (3, 4.0, "400")]


def test_a_file_that_lacks_a_column_is_named(spark, tmp_path):
    write(tmp_path / "a.csv", "Datetime,LOAD\n2020-01-01,1\n")
    write(tmp_path / "odd.csv", "Datetime,POWER\n2020-01-02,2\n")
    with pytest.raises(DataSourceError, match=r"odd.csv lacks.*\['LOAD'\]"):
        read_csv(spark, str(tmp_path), "Datetime", "LOAD")


def test_surplus_fields_are_counted_against_the_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "Datetime,LOAD\n2020-01-01,1\n")
    write(tmp_path / "b.csv", "LOAD,Datetime,extra\n2,2020-01-02,x\n")
    assert read_csv(spark, str(tmp_path), "Datetime", "LOAD").count() == 2
    write(tmp_path / "c.csv", "Datetime,LOAD\n2020-01-03,1,2\n")
    with pytest.raises(PySparkException, match="more fields"):
        read_csv(spark, str(tmp_path), "Datetime", "LOAD").collect()


def test_only_the_beginning_of_files_is_read_for_headers(spark, tmp_path):
    """A long file's later splits end after a batch; their lines are no headers."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        write(tmp_path / "a.csv", "Datetime,LOAD\n" + "".join(f"2020-01-01 00:00:{i % 60:02d},{i}\n" for i in range(1000)))
        write(tmp_path / "b.csv", "LOAD,Datetime\n" + "".join(f"{i},2020-01-01 00:00:{i % 60:02d}\n" for i in range(1000, 2000)))
        got = read_csv(spark, str(tmp_path), "Datetime", "LOAD")
        assert (got.count(), got.agg({"value": "sum"}).first()[0]) == (2000, sum(range(2000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
