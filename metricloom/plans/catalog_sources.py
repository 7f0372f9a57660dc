"""Source, sink and model queries (SRC, SNK, STA11, STA12). Files are written from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from metricloom.operators import mart, models, process
from metricloom.plans.catalog_process import event_log
from metricloom.plans.registry import query
from metricloom.session import checkpoint_dir
from metricloom.sources import files, markup, sinks, xes


def scratch(t, name):
    return f"{checkpoint_dir(t.spark)}/files-{uuid.uuid4().hex}/{name}"


@query("src1_read_parquet", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(t):
    return files.read_parquet(t.spark, f"{t.folder}/nation.parquet").filter("n_regionkey = 2").select("n_nationkey", "n_name")


@query("src2_read_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment AS c_mktsegment__2 FROM customer")
def _(t):
    path = scratch(t, "customers")
    rows = t.customer.select(F.concat_ws(";", "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_mktsegment").alias("value"))
    rows.write.text(path)
    df = files.read_csv(t.spark, path, delimiter=";", has_header=False)
    names = files.tidied_names(["c_custkey", " c_name ", "c_acctbal", "c_mktsegment", "c_mktsegment"])
    return df.toDF(*names).drop("c_mktsegment")


@query("src2_headed_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name AS \"p_name (short)\", CAST(p_size AS VARCHAR) AS cot_3 FROM part")
def _(t):
    path = scratch(t, "parts")
    sinks.write_csv(t.part.select("p_partkey", F.col("p_name").alias(" p_name {short}"), F.col("p_size").alias(" ")), path)
    return files.read_csv(t.spark, path)


@query("src3_dialect_survey", "SELECT CASE WHEN r_regionkey % 2 = 0 THEN ';' ELSE '|' END AS delimiter, r_regionkey % 2 = 0 AS has_header, true AS confident, 'utf-8-sig' AS encoding FROM region")
def _(t):
    base = scratch(t, "dialects")
    parts = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("size", F.col("n_nationkey") * 1.5)
    for region in range(5):
        mine = parts.filter(F.col("r_regionkey") == region).select("n_nationkey", "n_name", "size").coalesce(1)
        mine.write.option("sep", ";" if region % 2 == 0 else "|").option("header", region % 2 == 0).csv(f"{base}/{region}")
    return files.dialect_survey(t.spark, base, glob="*.csv").drop("name")


@query("src4_read_json", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def _(t):
    path = scratch(t, "events")
    sinks.write_json(t.events.select("event_id", "event_type"), path)
    return files.read_json(t.spark, path).select("event_id", "event_type")


@query("src6_file_survey", "SELECT kind, count(*) AS files FROM (VALUES ('table'), ('text'), ('text'), ('text')) v(kind) WHERE (SELECT count(*) FROM region) > 0 GROUP BY 1")
def _(t):
    base = scratch(t, "mixed")
    t.region.coalesce(1).write.parquet(f"{base}/a")
    t.region.coalesce(1).write.option("header", True).csv(f"{base}/b")
    t.region.coalesce(1).write.json(f"{base}/c")
    t.region.select(F.col("r_name").alias("value")).coalesce(1).write.text(f"{base}/d")
    return files.file_survey(t.spark, base, glob="part-*").groupBy("kind").agg(F.count("*").alias("files"))


@query("src7_html_lines")
def _(t):
    return markup.html_lines(t.pages, "page_id", "html")


@query("src7_html_pages", "SELECT count(*) AS pages FROM pages WHERE length(html) > 0")
def _(t):
    return markup.html_lines(t.pages, "page_id", "html").agg(F.countDistinct("page").alias("pages"))


@query("src7_html_invented", "SELECT n_regionkey AS page, title AS text FROM (SELECT DISTINCT n_regionkey FROM nation), (VALUES ('Nation Key'), ('between'), ('Copy Key')) v(title) UNION ALL SELECT n_regionkey, n_name || ' ' || n_nationkey FROM nation, (VALUES (1), (2)) w(i)")
def _(t):
    return markup.html_lines(nation_pages(t), "n_regionkey", "html").select("page", "text")


@query("src8_html_tables")
def _(t):
    return markup.html_tables(t.pages, "page_id", "html").select("page", "table_no", "title", F.array_join("header", "|").alias("header"), "row_no", F.array_join("cells", "|").alias("cells"))


def nation_pages(t):
    """One page per region with a table of its nations and a second one of the same shape."""
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), "n_nationkey", F.lit("</td></tr>"))
    rows = t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    head = "<tr><th>{}</th><th>Key</th></tr>"
    body = F.concat(F.lit("<html><body><table>" + head.format("Nation")), "rows", F.lit("</table><p>between</p><table>" + head.format("Copy")), "rows", F.lit("</table></body></html>"))
    return rows.select("n_regionkey", body.alias("html"))


@query(
    "src8_stacked_tables",
    """SELECT n_regionkey AS page, title || '|' || n_name || '|' || n_nationkey AS cells, 'Bảng|Chỉ tiêu|Key' AS header FROM nation, (VALUES ('Nation'), ('Copy')) v(title)""",
)
def _(t):
    stacked = markup.stack_tables(markup.html_tables(nation_pages(t), "n_regionkey", "html"))
    return stacked.select("page", F.array_join("cells", "|").alias("cells"), F.array_join("header", "|").alias("header"))


@query(
    "src9_email",
    """SELECT 'From: s' || s_suppkey || '@example.com' AS text FROM supplier UNION ALL SELECT 'Subject: Account ' || s_name FROM supplier UNION ALL SELECT 'Balance ' || s_acctbal FROM supplier""",
)
def _(t):
    path = scratch(t, "mail")
    message = F.concat(
        F.lit("From: s"), "s_suppkey", F.lit("@example.com\nSubject: Account "), "s_name", F.lit("\nContent-Type: text/plain; charset=utf-8\n\nBalance "), "s_acctbal", F.lit("\n-\n")
    )
    # One file per key, messages of one key below each other.
    lines = F.array_sort(F.collect_list(F.coalesce(message, F.lit(""))))
    mails = t.supplier.groupBy("s_suppkey").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    sinks.write_files(mails.select(F.concat(F.lit("mail-"), F.coalesce(F.col("s_suppkey").cast("string"), F.lit("none")), F.lit(".eml")).alias("name"), "content"), path)
    return markup.read_email(t.spark, path).select("text")


TRACE_KEYS = {"concept:name": "case_id", "Segment": "case_segment"}
EVENT_KEYS = {"concept:name": "activity", "time:timestamp": "timestamp", "Price": "price"}


def xes_file(t):
    """Orders of each customer as an event log file."""
    path = scratch(t, "log")
    attr = lambda tag, key, value: F.concat(F.lit(f'<{tag} key="{key}" value="'), value, F.lit('"/>'))
    event = F.concat(
        F.lit("<event>"), attr("string", "concept:name", F.col("o_orderstatus")), attr("date", "time:timestamp", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        attr("float", "Price", F.col("o_totalprice").cast("string")), F.lit("</event>"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    cases = joined.groupBy("c_custkey", "c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", event.alias("e")))), lambda x: x["e"]), "").alias("events"))
    trace = F.concat(F.lit("<trace>"), attr("string", "concept:name", F.col("c_custkey").cast("string")), attr("string", "Segment", F.col("c_mktsegment")), "events", F.lit("</trace>"))

    # Every folder holds one well-formed document: its opening row, its traces, its closing row. A trace of any length stays in the JVM.
    documents = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    ends = t.spark.range(documents).select(F.col("id").cast("int").alias("document"), F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(v).alias("value")) for k, v in ((0, "<log>"), (2, "</log>"))])).alias("e"))
    traces = cases.select(F.pmod(F.hash("c_custkey"), F.lit(documents)).cast("int").alias("document"), F.lit(1).alias("place"), trace.alias("value"))
    rows = traces.unionByName(ends.select("document", "e.place", "e.value"))
    rows.repartition(documents, "document").sortWithinPartitions("document", "place").select("document", "value").write.partitionBy("document").text(path)
    return path


@query(
    "src10_xes_events",
    """SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_mktsegment AS case_segment, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1)::INT AS event_seq, o_orderstatus AS activity,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    return xes.read_events(t.spark, xes_file(t), TRACE_KEYS, EVENT_KEYS).withColumn("price", F.col("price").cast("double"))


@query("src10_unmapped_keys", "SELECT 'event' AS level, 'Price' AS key FROM region LIMIT 1")
def _(t):
    return xes.unmapped_keys(t.spark, xes_file(t), TRACE_KEYS, {"concept:name": "activity", "time:timestamp": "timestamp"})


@query("src11_log_slice")
def _(t):
    return xes.slice_log(t.orders, "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"], 500)


@query("src11_whole_log", "SELECT o_orderkey FROM orders")
def _(t):
    return xes.slice_log(t.orders, "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"], 10**9).select("o_orderkey")


@query("src12_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return mart.page(t.orders, "o_orderkey", 25, 50)


@query("src12_stored_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 1240")
def _(t):
    return mart.store_pages(t.orders, "o_orderkey", scratch(t, "pages"), block_rows=500).page(25, 1240)


@query(
    "src13_span_quality",
    """SELECT o_custkey AS doc, count(*) AS spans, round(avg(c), 4) AS mean, min(c) AS lowest, count(*) FILTER (WHERE c < 0.75) AS low, count(*) FILTER (WHERE c < 0.75)::DOUBLE / count(*) > 0.15 AS needs_review
    FROM (SELECT o_custkey, (o_orderkey % 64) / 64.0::DOUBLE AS c FROM orders) GROUP BY 1""",
)
def _(t):
    spans = t.orders.select(F.col("o_custkey").alias("doc"), ((F.col("o_orderkey") % 64) / 64.0).alias("confidence"))
    return files.span_quality(spans, "doc", "confidence")


@query(
    "src14_rows_to_table",
    """SELECT l_orderkey AS doc, l_linenumber AS row_no, position::INT AS position, name AS "column", CASE position WHEN 1 THEN l_returnflag WHEN 2 THEN l_linestatus ELSE '' END AS value
    FROM lineitem, (VALUES (1, 'flag'), (2, 'cot_2'), (3, 'note')) v(position, name)""",
)
def _(t):
    head = t.lineitem.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("row_no"), F.array(F.lit(" flag "), F.lit(" "), F.lit("note")).alias("cells"))
    body = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("row_no"), F.array("l_returnflag", "l_linestatus").alias("cells"))
    return files.rows_to_table(head.unionByName(body), "doc", "row_no", "cells")


# --- sinks -----------------------------------------------------------------------


@query("snk1_write_parquet", "SELECT * FROM supplier")
def _(t):
    base = scratch(t, "layers")
    sinks.write_parquet(t.supplier.limit(0), base, "clean", "supplier")
    sinks.write_parquet(t.supplier, base, "clean", "supplier")
    return sinks.read_table(t.spark, base, "clean", "supplier")


@query("snk2_write_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def _(t):
    path = scratch(t, "csv")
    sinks.write_csv(t.supplier.select("s_suppkey", "s_name"), path)
    return files.read_csv(t.spark, path)


@query("snk3_write_json", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS o_orderdate FROM orders")
def _(t):
    path = scratch(t, "json")
    sinks.write_json(t.orders.select("o_orderkey", "o_orderdate"), path)
    return files.read_json(t.spark, path).select("o_orderkey", "o_orderdate")


@query("snk4_markdown", "SELECT '| ' || s_suppkey || ' | ' || replace(s_name, '#', '\\|') || ' |' AS value FROM supplier UNION ALL SELECT '| key | name |' UNION ALL SELECT '|---|---|'")
def _(t):
    path = scratch(t, "markdown")
    sinks.write_markdown(t.supplier.select(F.col("s_suppkey").alias("key"), F.replace("s_name", F.lit("#"), F.lit("|")).alias("name")), path)
    return t.spark.read.option("recursiveFileLookup", True).text(path).filter("value <> ''")


@query("snk4_html", "SELECT '<tr><td>' || s_suppkey || '</td><td>' || replace(s_name, '#', '&lt;') || '</td></tr>' AS value FROM supplier")
def _(t):
    path = scratch(t, "html")
    sinks.write_html(t.supplier.select(F.col("s_suppkey").alias("key"), F.replace("s_name", F.lit("#"), F.lit("<")).alias("name")), path)
    return t.spark.read.option("recursiveFileLookup", True).text(path).filter(F.col("value").contains("<td>"))


@query("snk5_run_tables", "SELECT 'process.cases' AS key, count(DISTINCT user_id)::DOUBLE AS value FROM events")
def _(t):
    base = scratch(t, "runs")
    outcome = process.mine_process(event_log(t))
    sinks.write_run(base, "r1", metrics=outcome.metrics, refusals=outcome.refused)
    sinks.write_run(base, "r2", metrics=outcome.metrics.limit(0))
    return sinks.read_run(t.spark, base, "metrics", "r1").filter("key = 'process.cases'").select("key", "value")


# --- models ----------------------------------------------------------------------


@query("sta11_importance")
def _(t):
    return models.measure_importance(t.part, "p_retailprice", ["p_partkey", "p_size"]).metrics.select("key", "value")


@query("sta11_refused")
def _(t):
    return models.measure_importance(t.supplier, "s_acctbal", ["s_suppkey", "s_nationkey"]).refused


def vector_columns(t, *extra):
    """Every element of the vectors as a column ``e0, e1, ...``, and their names."""
    width = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{i}" for i in range(width)]
    return t.embeddings.select(*extra, *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)]), names


@query("sta12_clusters")
def _(t):
    rows, names = vector_columns(t, "label")
    # Labelled vectors, moved apart by label: the groups are known.
    moved = rows.select(*[(F.col(c) + (F.col("label") % 3 == i % 3).cast("double") * 2).alias(c) for i, c in enumerate(names)])
    out = models.find_clusters(moved, names)
    return out.metrics.filter("stat IN ('count', 'silhouette', 'rows', 'size')").select("key", "value")


@query("sta12_refused")
def _(t):
    rows, names = vector_columns(t)
    return models.find_clusters(rows, names).refused.select("op", "reason", "required")
