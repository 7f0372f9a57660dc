"""Reading stored and delimited tables, and surveying a folder of unknown files."""

from __future__ import annotations

import csv
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.text import strip
from metricloom.sources.heads import file_heads

UNNAMED = "cot"  # fixed value: name of a column without one
SAMPLE_BYTES = 64 * 1024
HEAD_BYTES = 16
LARGE_BYTES = 100 * 1024 * 1024
LOW_CONFIDENCE = 0.75
REVIEW_SHARE = 0.15

# Encodings and delimiters in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1258", "cp1252", "latin-1")
DELIMITERS = (",", ";", "\t", "|")

# Kind, label and the bytes a file starts with (at an offset).
SIGNATURES = (
    ("table", "Parquet", (b"PAR1",), 0),
    ("pdf", "PDF", (b"%PDF-",), 0),
    ("image", "PNG", (b"\x89PNG\r\n\x1a\n",), 0),
    ("image", "JPEG", (b"\xff\xd8\xff",), 0),
    ("image", "GIF", (b"GIF87a", b"GIF89a"), 0),
    ("image", "TIFF", (b"II*\x00", b"MM\x00*"), 0),
    ("image", "BMP", (b"BM",), 0),
    ("audio", "WAV", (b"RIFF",), 0),
    ("audio", "MP3", (b"ID3", b"\xff\xfb", b"\xff\xf3", b"\xff\xf2"), 0),
    ("audio", "FLAC", (b"fLaC",), 0),
    ("audio", "OGG", (b"OggS",), 0),
    ("audio", "MP4/M4A", (b"ftyp",), 4),
    ("zip", "ZIP container", (b"PK\x03\x04", b"PK\x05\x06"), 0),
    ("ole", "Office 97-2003", (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",), 0),
)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def tidied_names(raw: Sequence[object]) -> list[str]:
    """Trimmed, braces swapped, blanks numbered, repeats suffixed ``__2``."""
    seen: dict[str, int] = {}
    names = []
    for position, value in enumerate(raw, start=1):
        name = str(value).strip().replace("{", "(").replace("}", ")") or f"{UNNAMED}_{position}"
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            name = f"{name}__{seen[name]}"
            seen[name] = 1
        names.append(name)
    return names


def read_csv(spark: SparkSession, path: str, *, encoding: str = "utf-8", delimiter: str = ",", has_header: bool = True) -> DataFrame:
    """Delimited text with every column as text. The header is read as a row of data, so
    repeated and empty names reach the tidying unchanged. Files are split among tasks unless some quoted cell spans lines, which
    shows in a line with an odd number of quotes."""
    reader = spark.read.option("sep", delimiter).option("encoding", encoding.replace("-sig", "")).option("inferSchema", False)
    reader = reader.option("quote", '"').option("escape", '"').option("nullValue", "")
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    spans = not spark.read.text(path).filter(odd % 2 == 1).isEmpty()
    reader = reader.option("multiLine", spans)
    first = reader.option("header", False).csv(path).limit(1).first()
    width = len(first) if first else 0
    names = tidied_names(["" if v is None else v for v in first]) if first and has_header else [f"{UNNAMED}_{i + 1}" for i in range(width)]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    return reader.option("header", has_header).option("enforceSchema", True).schema(schema).csv(path).toDF(*names)


def read_json(spark: SparkSession, path: str, *, lines: bool = True) -> DataFrame:
    """JSON lines or a JSON array, all values as text."""
    df = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    text = [F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.to_json(f"`{f.name}`").alias(f.name) for f in df.schema.fields]
    return df.select(*text).toDF(*tidied_names(df.columns))


@F.pandas_udf(T.BooleanType())
def _is_text(heads: pd.Series) -> pd.Series:
    def readable(head: bytes) -> bool:
        try:
            head.decode("utf-8")
        except UnicodeDecodeError as error:
            return error.start >= len(head) - 3 and error.reason == "unexpected end of data"
        return True

    return heads.map(lambda h: bool(h is not None and readable(h)))


def _kind(head: Column, text: Column, size: Column) -> tuple[Column, Column]:
    kind, label = F.when(size == 0, "unknown"), F.when(size == 0, "empty")
    for name, title, magics, offset in SIGNATURES:
        hit = F.lit(False)
        for magic in magics:
            hit = hit | (F.substring(head, offset + 1, len(magic)) == F.lit(magic))
        kind, label = kind.when(hit, name), label.when(hit, title)
    return kind.when(text, "text").otherwise("unknown"), label.when(text, "text").otherwise("not recognised")


def file_survey(spark: SparkSession, folder: str, *, glob: str = "*") -> DataFrame:
    """``name, size, kind, label, reader, warning``: what each file is by its first bytes.

    The extension only decides how text and containers are read. Of a file of any size only the first bytes are read.
    """
    rows = file_heads(spark, folder, HEAD_BYTES, glob=glob)
    kind, label = _kind(F.col("head"), _is_text("head"), F.col("size"))
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1))
    name = F.col("name")
    suffix = F.lower(F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(""))
    table = suffix.isin(".csv", ".tsv", ".jsonl", ".ndjson", ".json", ".xlsx", ".xls", ".parquet")
    document = suffix.isin(".html", ".htm", ".eml", ".msg")
    sheet = suffix.isin(".xlsx", ".xls")
    k = F.col("kind")
    reader = (
        F.when(k == "table", "table").when((k == "text") & table, "table").when(k == "text", "document").when((k == "zip") & sheet, "table").when(k == "zip", "document")
        .when((k == "ole") & (suffix == ".xls"), "table").when(k.isin("pdf", "image", "audio"), k)
    )
    notes = F.array_compact(F.array(
        F.when((k == "text") & ~table & ~document, "text that may be a table or prose, read as prose"),
        F.when(reader.isNull(), "no reader for this kind"), F.when(F.col("size") == 0, "empty file"),
        F.when(F.col("size") > LARGE_BYTES, "large file"),
    ))
    return rows.select("name", "size", kind.alias("kind"), label.alias("label")).select("*", reader.alias("reader"), F.array_join(notes, "; ").alias("warning"))


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType()), T.StructField("sniffed", T.StringType())]))
def _decoded(samples: pd.Series, cut: pd.Series) -> pd.DataFrame:
    rows = []
    for sample, was_cut in zip(samples, cut):
        for encoding in ENCODINGS:
            try:
                text = bytes(sample).decode(encoding)
            except UnicodeDecodeError as error:
                # The sample may end inside a character of a longer file.
                if not (was_cut and encoding.startswith("utf-8") and error.start >= len(sample) - 3):
                    continue
                text = bytes(sample)[: error.start].decode(encoding)
            break
        try:
            sniffed = csv.Sniffer().sniff(text[:4096], delimiters="".join(DELIMITERS)).delimiter
        except csv.Error:
            sniffed = ","
        rows.append((encoding, text, sniffed))
    return pd.DataFrame(rows, columns=["encoding", "text", "sniffed"])


def dialect_survey(spark: SparkSession, folder: str, *, glob: str = "*") -> DataFrame:
    """``name, encoding, delimiter, has_header, confident`` of every file, from its first 64 KB.

    The result gives the options of :func:`read_csv`.
    """
    heads = file_heads(spark, folder, SAMPLE_BYTES, glob=glob)
    read = heads.select("path", _decoded("head", F.col("size") > SAMPLE_BYTES).alias("d")).select("path", "d.*")
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda line: strip(line) != "")
    rows = read.withColumn("lines", lines)
    first20 = F.slice("lines", 1, 20)

    scored = [F.struct(_steady(first20, d).alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    best = F.array_max(F.array(*scored))
    rows = rows.withColumn("best", F.when(F.size("lines") > 0, best)).withColumns({
        "confident": F.coalesce(F.col("best.n") > 0, F.lit(False)),
        "delimiter": F.when(F.col("best.n") > 0, F.col("best.d")).otherwise(F.col("sniffed")),
    })
    rows = rows.withColumn("first", _split_cells(F.try_element_at("lines", F.lit(1)), F.col("delimiter")))
    numeric = F.exists("first", lambda c: F.replace(c, F.lit(","), F.lit("")).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$|^[-+]?(?i:inf|infinity|nan)$"))
    clean = (F.size("lines") > 0) & ~F.exists("first", lambda c: c == "") & (F.array_size(F.array_distinct("first")) == F.array_size("first")) & ~numeric
    # The last sampled line may be cut short, so it is not compared.
    below = F.slice("lines", 2, F.greatest(F.size("lines") - 2, F.lit(0)))
    repeats = F.when(F.size("lines") < 3, F.lit(False)).otherwise(F.exists(below, lambda line: _repeats(line, F.col("first"), F.col("delimiter"))))
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "encoding", "delimiter", F.coalesce(clean & ~repeats, F.lit(False)).alias("has_header"), "confident"
    )


def _counts(lines: Column, delimiter: str) -> Column:
    return F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))) + 1)


def _steady(lines: Column, delimiter: str) -> Column:
    """Fields per line when every line has the same number above one, otherwise 0."""
    counts = _counts(lines, delimiter)
    return F.when((F.array_size(F.array_distinct(counts)) == 1) & (F.element_at(counts, 1) > 1), F.element_at(counts, 1)).otherwise(0)


def _split_cells(line: Column, delimiter: Column) -> Column:
    parts = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))
    return F.transform(parts, lambda c: F.regexp_replace(strip(c), '^"+|"+$', ""))


def _repeats(line: Column, first: Column, delimiter: Column) -> Column:
    cells = _split_cells(line, delimiter)
    same = F.exists(F.zip_with(cells, first, lambda a, b: a == b), lambda hit: F.coalesce(hit, F.lit(False)))
    return (F.size(cells) == F.size(first)) & same


def span_quality(spans: DataFrame, doc: str, confidence: str) -> DataFrame:
    """Per document: mean and lowest confidence, how many spans are doubtful, and whether to review."""
    c = F.col(confidence)
    low = F.count_if(c < LOW_CONFIDENCE)
    return spans.groupBy(doc).agg(
        F.count("*").alias("spans"), F.round(F.avg(c), 4).alias("mean"), F.min(c).alias("lowest"), low.alias("low"),
        (low / F.count("*") > REVIEW_SHARE).alias("needs_review"),
    )


def rows_to_table(rows: DataFrame, doc: str, row_no: str, cells: str) -> DataFrame:
    """Rows of cells to named cells: ``doc, row_no, column, value``. Row 0 is the header; rows are
    padded or cut to its width; blank names are numbered."""
    header = rows.filter(F.col(row_no) == 0).select(F.col(doc).alias("_doc"), F.transform(cells, lambda c, i: F.when(strip(c) == "", F.concat(F.lit(f"{UNNAMED}_"), (i + 1).cast("string"))).otherwise(strip(c))).alias("_names"))
    body = rows.filter(F.col(row_no) > 0).join(header, F.col(doc) == F.col("_doc"))
    pairs = F.transform("_names", lambda name, i: F.struct((i + 1).alias("position"), name.alias("column"), F.coalesce(F.try_element_at(F.col(cells), i + 1), F.lit("")).alias("value")))
    return body.select(doc, row_no, F.explode(pairs).alias("p")).select(doc, row_no, "p.position", "p.column", "p.value")
