"""Message files, logs, pages and stored blocks whose cost must not follow the number of files, batches or partitions."""

import os
import uuid
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import functions as F

from metricloom.operators import mart, models
from metricloom.plans import catalog_sources
from metricloom.plans.registry import Tables
from metricloom.session import checkpoint_dir
from metricloom.sources import markup, sinks


def test_files_are_written_by_the_tasks_into_one_folder(spark, tmp_path):
    rows = [(f"m{i}.eml", f"From: a{i}@example.com\nContent-Type: text/plain; charset=utf-8\n\nHello é {i}\n") for i in range(300)]
    sinks.write_files(spark.createDataFrame(rows, "name string, content string").repartition(5), str(tmp_path / "mail"))
    assert sorted(os.listdir(tmp_path / "mail")) == sorted(n for n, _ in rows)
    found = markup.read_email(spark, str(tmp_path / "mail")).filter("line_no = 2").select("name", "text").collect()
    assert sorted(map(tuple, found)) == sorted((f"m{i}.eml", f"Hello é {i}") for i in range(300))


def test_a_forest_gets_partitions_by_its_rows(spark, monkeypatch):
    df = spark.range(1000).coalesce(1)
    assert models._dealt(df, 1000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "TASK_ROWS", 300)
    assert models._dealt(df, 1000).rdd.getNumPartitions() == 4
    assert models._dealt(df, 10**9).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_pages_are_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(markup, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4], "h": ["a" * 6, "b" * 6, None, "c"]})
    assert [s.num_rows for s in markup._slices([batch], "h")] == [2, 2]
    pages = spark.createDataFrame([(1, "<p>one</p><p>two</p>"), (2, None), (None, "<p>six</p>")], "k long, h string")
    assert sorted(map(str, markup.html_lines(pages, "k", "h").collect())) == sorted(
        ["Row(page=1, line_no=1, text='one')", "Row(page=1, line_no=2, text='two')", "Row(page=None, line_no=1, text='six')"])


def test_small_blocks_share_a_folder(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("n"))
    folder = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages = mart.store_pages(df, "n", folder, block_rows=10)
    assert len([f for f in os.listdir(f"{folder}/rows") if f.startswith(mart.PAGE_FILE)]) == 1
    assert pages.index.count() == 500
    assert [r["n"] for r in pages.page(7, 4321).collect()] == list(range(4321, 4328))
    again = mart.store_pages(df.unionByName(df), "n", folder + "b", block_rows=3)
    assert [r["n"] for r in again.page(5, 1001).collect()] == [500, 501, 501, 502, 502]


def test_every_document_of_a_log_is_well_formed(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i % 2}") for i in range(40)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(200).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "'F' AS o_orderstatus", "1.5D AS o_totalprice", "TIMESTAMP'2024-01-01' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    path = catalog_sources.xes_file(Tables(spark, str(tmp_path)))
    logs = [ET.parse(os.path.join(folder, f)).getroot() for folder, _, names in os.walk(path) for f in names if f.endswith(".txt")]
    assert sorted(len(t.findall("event")) for log in logs for t in log.findall("trace")) == [5] * 40
    assert all(log.tag == "log" for log in logs)
    assert len(logs) > 1
