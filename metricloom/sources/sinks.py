"""Writing tables and the results of a run."""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.sources.heads import opened

LAYERS = ("raw", "extracted", "staging", "clean", "mart", "profile", "validation", "artifacts")


def layer_path(base: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"no layer '{layer}'; known: {', '.join(LAYERS)}")
    return f"{base.rstrip('/')}/{layer}/{name}"


#: Every finished write is one row here. Rows are appended, so a write is visible at once or not at all.
VERSIONS = "run_id string, version bigint, folder string, tables array<string>"


def _publish(spark: SparkSession, base: str, run_id: str, version: int, folder: str, tables: list[str]) -> None:
    spark.createDataFrame([(run_id, version, folder, tables)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{base}/versions")


def _versions(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(VERSIONS).parquet(f"{base}/versions")


def write_parquet(df: DataFrame, base: str, layer: str, name: str) -> str:
    """Store a table in a layer, in a folder of its own, which becomes the table when it is complete. Readers see the old
    table until then, and if the write fails. Returns the folder."""
    path = layer_path(base, layer, name)
    version = time.time_ns()
    folder = f"{path}/{version}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(folder)
    _publish(df.sparkSession, path, "", version, folder, [name])
    return folder


def read_table(spark: SparkSession, base: str, layer: str, name: str) -> DataFrame:
    """The newest complete version of a table."""
    newest = _versions(spark, layer_path(base, layer, name)).orderBy(F.desc("version")).first()
    return spark.read.parquet(newest["folder"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").option("ignoreNullFields", False).json(path)


def _markdown_cell(column: Column) -> Column:
    shown = F.replace(F.replace(column.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.coalesce(shown, F.lit(""))


def _escaped(column: Column) -> Column:
    out = F.coalesce(column.cast("string"), F.lit(""))
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def markdown_lines(df: DataFrame) -> tuple[list[str], DataFrame]:
    """The two header lines, and one line per row."""
    names = [c.replace("|", "\\|").replace("\n", " ") for c in df.columns]
    head = ["| " + " | ".join(names) + " |", "|" + "|".join(["---"] * len(names)) + "|"]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_markdown_cell(F.col(f"`{c}`")) for c in df.columns]), F.lit(" |"))
    return head, df.select(line.alias("value"))


def html_lines(df: DataFrame) -> tuple[list[str], DataFrame]:
    cells = [F.concat(F.lit("<td>"), _escaped(F.col(f"`{c}`")), F.lit("</td>")) for c in df.columns]
    names = "".join(f"<th>{c.replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;')}</th>" for c in df.columns)
    return ["<table>", f"<tr>{names}</tr>"], df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def _write_lines(spark: SparkSession, head: list[str], body: DataFrame, path: str, closing: list[str] = ()) -> None:
    """A folder whose parts are, in name order, the header, the rows and the closing lines."""
    for part, lines in (("0-head", head), ("2-tail", list(closing))):
        if lines:
            spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{part}")
    body.write.mode("overwrite").text(f"{path}/1-rows")


def write_markdown(df: DataFrame, path: str) -> None:
    head, body = markdown_lines(df)
    _write_lines(df.sparkSession, head, body, path)


def write_html(df: DataFrame, path: str) -> None:
    head, body = html_lines(df)
    _write_lines(df.sparkSession, head, body, path, ["</table>"])


def write_run(base: str, run_id: str, **tables: DataFrame) -> None:
    """Store the result tables of one run (metrics, refusals, diff log, validation). All of them become visible together, when the last is
    written; until then, and if one fails, the run reads as it was. Repeating a run replaces only its own tables."""
    base = base.rstrip("/")
    version = time.time_ns()
    folder = f"{base}/{version}-{uuid.uuid4().hex[:8]}"
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(f"{folder}/{name}")
    if spark is not None:
        _publish(spark, base, run_id, version, folder, sorted(tables))


def read_run(spark: SparkSession, base: str, name: str, run_id: str) -> DataFrame:
    """A table of the newest complete write of a run."""
    base = base.rstrip("/")
    held = _versions(spark, base).filter((F.col("run_id") == run_id) & F.array_contains("tables", name))
    newest = held.orderBy(F.desc("version")).first()
    if newest is None:
        raise LookupError(f"run '{run_id}' has no table '{name}'")
    return spark.read.parquet(f"{newest['folder']}/{name}")


def write_files(df: DataFrame, folder: str) -> None:
    """One file for each row ``name, content`` (names must differ). The tasks write them side by side through the file system of the folder; nothing is renamed
    one by one at the end. A task that runs again writes the same files again."""

    def write(batches):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as stream:
                    stream.write(content.encode())
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    written = df.select(F.col("name").cast("string"), F.col("content").cast("string")).mapInArrow(write, "files bigint")
    written.agg(F.sum("files")).collect()
