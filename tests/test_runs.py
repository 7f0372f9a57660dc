"""Marts whose lines occur many times over."""

import datetime as dt
import io
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from metricloom.operators import mart
from metricloom.sources import runs


def texts(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(1)
    rows = [
        (draw.choice([None, 1, 2, 3, 4]), draw.choice([None, "a", "bé", ""]), draw.choice([None, i]), draw.choice([None, 0.5 * i, -0.0, float("nan")]), dt.date(1500, 1, 1) + dt.timedelta(2000 * i) if i % 3 else None,
         dt.datetime(1890, 1, 1, 1, 2, 3, i) + dt.timedelta(100 * i) if i % 5 else None, i % 100, None)
        for i in range(400)
    ]
    return spark.createDataFrame(rows, "k int, s string, i bigint, d double, t date, z timestamp, b tinyint, n smallint")


@pytest.mark.parametrize("sql", [
    "SELECT a.s, a.i * 2 AS twice, a.d, a.t, a.z, a.b, a.k, a.n, cast(a.d AS float) AS f, cast(a.s AS binary) AS y FROM a JOIN b ON a.k = b.k AND b.s = a.s WHERE b.b > 3",
    "SELECT b.n, b.s AS `odd name, é` FROM a JOIN b ON a.k = b.k",
    "SELECT 1 AS one FROM a JOIN b USING (k)",
])
def test_repeated_lines_are_stored_as_runs_and_read_as_rows(spark, table, tmp_path, sql):
    plain = mart.run_sql(sql, {"a": table, "b": table})
    assert mart._repeated(plain) is not None
    built = mart.build_mart(sql, {"a": table, "b": table}, str(tmp_path / "m"))
    assert built.rows_out == plain.count() and built.df.dtypes == plain.dtypes
    assert texts(built.df) == texts(plain) == texts(spark.read.parquet(str(tmp_path / "m")))
    assert pq.read_table(tmp_path / "m").num_rows == built.rows_out
    assert not [p for p in (tmp_path / "m").iterdir() if p.is_dir()]


@pytest.mark.parametrize("sql", [
    "SELECT a.i, b.s FROM a JOIN b ON a.k = b.k", "SELECT a.i FROM a JOIN b ON a.k = b.k AND a.i < b.i", "SELECT a.i FROM a LEFT JOIN b ON a.k = b.k",
    "SELECT a.i FROM a JOIN b ON a.k <=> b.k", "SELECT DISTINCT a.i FROM a JOIN b ON a.k = b.k", "SELECT a.i FROM a JOIN b ON a.d = b.d", "SELECT a.i FROM a JOIN b ON a.i = b.i", "SELECT a.k FROM a JOIN b ON a.k = b.k AND a.k > 9",
])
def test_other_statements_are_written_as_they_were(table, tmp_path, sql):
    plain = mart.run_sql(sql, {"a": table, "b": table})
    assert mart._repeated(plain) is None
    built = mart.build_mart(sql, {"a": table, "b": table}, str(tmp_path / "m"))
    assert built.rows_out == plain.count() and texts(built.df) == texts(plain)


def test_each_row_keeps_a_draw_of_its_own(table):
    assert mart._repeated(mart.run_sql("SELECT rand() AS x FROM a JOIN b ON a.k = b.k", {"a": table, "b": table})) is None


def test_a_join_with_itself_grows_by_its_lines(spark, tmp_path):
    # 10 billion rows: written one by one they would take longer than the whole suite
    rows = spark.range(100_000).select((F.col("id") % 1).alias("k"), "id")
    built = mart.build_mart("SELECT a.id FROM a JOIN b ON a.k = b.k", {"a": rows, "b": rows}, str(tmp_path / "m"), max_rows=10**12)
    assert built.rows_out == built.df.count() == 10**10
    assert sum(p.stat().st_size for p in Path(tmp_path / "m").glob("*.parquet")) < 10_000_000
    with pytest.raises(mart.MartError, match="10,000,000,000 rows"):
        mart.build_mart("SELECT a.id FROM a JOIN b ON a.k = b.k", {"a": rows, "b": rows}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 0


def test_lines_are_cut_where_they_occur_too_often(monkeypatch):
    monkeypatch.setattr(runs, "GROUP_ROWS", 100)
    out = io.BytesIO()
    out.close_for_good, out.close = out.close, lambda: None
    writer = runs.RunWriter(out, ["x", "s"], ["bigint", "string"])
    times = np.array([1, 99, 250, 3, 100, 1, 70_000])
    x, s = [5, None, 7, 5, -2, 2**62, 0], ["a", "b" * 300, None, None, "", "é", "z"]
    writer.write([pa.array(x), pa.array(s)], times)
    writer.write([pa.array([None, None], pa.int64()), pa.array(["a", "a"])], np.array([2, 3]))
    writer.close()
    found = pq.ParquetFile(io.BytesIO(out.getvalue()))
    assert found.metadata.num_rows == writer.rows == times.sum() + 5
    assert max(found.metadata.row_group(k).num_rows for k in range(found.num_row_groups)) < 200
    read = found.read()
    assert read["x"].to_pylist() == [v for v, n in zip(x, times) for _ in range(n)] + [None] * 5
    assert read["s"].to_pylist() == [v for v, n in zip(s, times) for _ in range(n)] + ["a"] * 5
