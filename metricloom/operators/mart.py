"""The SQL mart: one statement over granted tables, with size checks and a scope note."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from metricloom import scale
from metricloom.functions import numbers
from metricloom.operators.common import side_by_side
from metricloom.operators.profile import _quoted, _types
from metricloom.sources import runs

MAX_ROWS = 50_000_000
EXPLOSION = 10
FEW_ROWS = 5
PAGE_ROWS = 1_000_000
PAGE_BLOCK = "_page_block"
PAGE_FILE = "_page_file"
FILE_ROWS = 500_000  # at least, in a folder of many small blocks
#: Leaves of a plan that hold no table: constants, number ranges, and references to the statement's own WITH parts.
FREE_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef")


class MartError(RuntimeError):
    """The statement's result is refused."""


@dataclass
class Mart:
    df: DataFrame
    rows_in: dict[str, int]
    rows_out: int
    note: str


def _nodes(plan) -> Iterator:
    """Every node of a logical plan, those of subqueries in expressions included."""
    yield plan
    for branch in (plan.children(), plan.subqueries()):
        for k in range(branch.size()):
            yield from _nodes(branch.apply(k))


def _only_a_query(session: SparkSession, sql: str) -> None:
    """Whatever is not a query does not parse in the place of a subquery, and nothing has run by then."""
    try:
        session._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM (\n{sql}\n)")
    except Exception as error:
        raise MartError("only one SELECT or WITH statement is allowed") from error


def run_sql(sql: str, tables: Mapping[str, DataFrame], args: Mapping | None = None) -> DataFrame:
    """One SELECT or WITH over the granted tables.

    The statement runs in a session of its own, in which only those tables exist under these names and files cannot be
    queried. Commands are refused before they run. In the analysed plan every leaf must come from a granted
    table, and a join must have a condition. The plan stays lazy.
    """
    if not tables:
        raise MartError("no table was granted")
    base = next(iter(tables.values())).sparkSession
    session = base.newSession()
    session.conf.set("spark.sql.session.timeZone", base.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", base.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.crossJoin.enabled", "false")
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    _only_a_query(session, sql)
    token = uuid.uuid4().hex[:8]
    granted = []
    for name, df in tables.items():
        # A global view hands the plan to the other session; the local name hides it again.
        shared = f"g{token}_{name}"
        df.createOrReplaceGlobalTempView(shared)
        view = session.table(f"global_temp.{shared}")
        view.createOrReplaceTempView(name)
        granted += [n for n in _nodes(view._jdf.queryExecution().analyzed()) if not n.children().size()]
        base.catalog.dropGlobalTempView(shared)
    result = session.sql(sql, args=dict(args) if args else None)
    for node in _nodes(result._jdf.queryExecution().analyzed()):
        if not node.children().size() and node.nodeName() not in FREE_LEAVES and not any(leaf.sameResult(node) for leaf in granted):
            raise MartError(f"a table was not granted: {node.nodeName()}")
    for node in _nodes(result._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() == "Join" and node.condition().isEmpty() and node.joinType().sql() in ("CROSS", "INNER"):
            raise MartError("cross joins are refused: give the join a condition")
    return result


def _repeated(result: DataFrame) -> tuple[DataFrame, int] | None:
    """The different lines of a join with how often each occurs, and the number of rows, if all its columns come from one side, its condition is that columns
    are equal, and a line occurs ``EXPLOSION`` times or more on average. A row of that side occurs as often as its keys do on the other side, so
    the other side is counted by key instead of being joined row by row."""
    plan = result._jdf.queryExecution().optimizedPlan()
    join = plan.child() if plan.nodeName() == "Project" else None
    if join is None or join.nodeName() != "Join" or join.joinType().sql() != "INNER" or not plan.deterministic():
        return None
    sides = [join.left(), join.right()]
    if not plan.references().subsetOf(sides[0].outputSet()):
        sides.reverse()
        if not plan.references().subsetOf(sides[0].outputSet()):
            return None
    keys, open_terms = [[], []], [join.condition().get()] if join.condition().isDefined() else []
    while open_terms:
        term = open_terms.pop()
        if term.nodeName() == "And":
            open_terms += [term.left(), term.right()]
            continue
        ends = [term.left(), term.right()] if term.nodeName() == "EqualTo" else []
        if [e.nodeName() for e in ends] != ["AttributeReference"] * 2:
            return None
        if not sides[0].outputSet().contains(ends[0]):
            ends.reverse()
        for held, end in zip(keys, ends):
            held.append(end)
    if not keys[0]:
        return None
    session, jvm = result.sparkSession, result.sparkSession._jvm

    def columns(side, shown) -> DataFrame:
        chosen = jvm.org.apache.spark.api.python.PythonUtils.toSeq(shown)
        node = jvm.org.apache.spark.sql.catalyst.plans.logical.Project(chosen, side)
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(result._jdf.sparkSession(), node), session)

    places, names = [f"k{i}" for i in range(len(keys[0]))], [f"c{i}" for i in range(len(result.columns))]
    own = plan.projectList()
    lines = columns(sides[0], [*[own.apply(i) for i in range(own.size())], *keys[0]]).toDF(*names, *places)
    times = columns(sides[1], keys[1]).toDF(*places).groupBy(*places).agg(F.count("*").alias("times"))
    counted = lines.groupBy(*places).agg(F.count("*").alias("lines")).join(times, places)
    size = counted.agg(F.sum("lines").alias("lines"), F.sum(F.col("lines").cast("decimal(38)") * F.col("times")).cast("bigint").alias("rows")).first()
    if not size["rows"] or size["rows"] < EXPLOSION * size["lines"]:
        return None
    return lines.join(times, places).select(*names, "times"), size["rows"]


def _qualified(session: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it."""
    named = session._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).makeQualified(named).toString()


def build_mart(sql: str, tables: Mapping[str, DataFrame], path: str, *, max_rows: int = MAX_ROWS) -> Mart:
    """Run, store and check the size of a mart. The statement runs once and is written by all tasks; rows are counted while
    they are written, and a result that is too large is emptied again. Where a join repeats its lines, they are counted first and stored as runs."""
    result = run_sql(sql, tables)
    folder = _qualified(result.sparkSession, path)
    repeated = _repeated(result) if runs.can_hold(result.schema, folder) else None
    if repeated is not None:
        rows_out = repeated[1]
        result.limit(0).write.mode("overwrite").parquet(path)
        if rows_out <= max_rows:
            rows_out = runs.write_runs(repeated[0], result.schema, folder)
    else:
        seen = Observation()
        result.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(path)
        rows_out = seen.get["rows"]
    if rows_out > max_rows:
        result.limit(0).write.mode("overwrite").parquet(path)
        raise MartError(f"the result has {rows_out:,} rows, more than {max_rows:,}; a join may lack a condition")
    stored = result.sparkSession.read.schema(result.schema).parquet(path)
    rows_in = {name: df.count() for name, df in tables.items()}
    return Mart(stored, rows_in, rows_out, size_note(rows_in, rows_out))


def size_note(rows_in: Mapping[str, int], rows_out: int) -> str:
    largest = max(rows_in.values(), default=0)
    if largest and rows_out > largest * EXPLOSION:
        return f"{rows_out:,} rows from a largest table of {largest:,}: more than {EXPLOSION} times, check the join conditions"
    if rows_out < FEW_ROWS < largest:
        return f"only {rows_out} rows from {largest:,}"
    return ""


def scope_note(source: DataFrame, result: DataFrame, condition: str, columns: list[str]) -> DataFrame:
    """``rows_out, rows_in, condition`` and, when nothing is left, the range of each column in the condition."""
    kinds = _types(source)
    ends = [a for i, c in enumerate(columns) for x in [numbers.numeric(_quoted(c), kinds[c])] for a in (F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"))]
    whole = source.agg(F.count("*").alias("rows_in"), *ends)
    left = result.agg(F.count("*").alias("rows_out"))
    spans = F.array_join(F.array(*[F.format_string(f"{c}: %s..%s", F.col(f"l{i}").cast("string"), F.col(f"h{i}").cast("string")) for i, c in enumerate(columns)]), "; ")
    return side_by_side(whole, left).select(
        "rows_in", "rows_out", F.lit(condition).alias("condition"), F.when(F.col("rows_out") == 0, spans).otherwise("").alias("note")
    )


def rows_where(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    """Rows whose text equals the value, or any of a list of values, for every named column."""
    out = df
    for name, value in where.items():
        if name not in df.columns:
            raise MartError(f"no column '{name}'")
        wanted = value if isinstance(value, (list, tuple)) else [value]
        out = out.filter(_quoted(name).cast("string").isin([str(v) for v in wanted]))
    return out


def page(df: DataFrame, row_id: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a table in row order. The rows before it are sorted too: use ``store_pages`` for a table read page by page."""
    return df.orderBy(row_id).offset(offset).limit(limit)


@dataclass(frozen=True)
class Pages:
    """A table stored in ordered blocks, with the number of the first row of each block."""

    index: DataFrame
    folder: str
    schema: StructType
    row_id: str

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in row order; reads the folders that hold them, and of a folder the parts with their blocks."""
        hit = (
            self.index.filter((F.col("first_row") < offset + limit) & (F.col("first_row") + F.col("rows") > offset))
            .agg(F.min("first_row"), F.collect_set("file"), F.min("block"), F.max("block")).first()  # as many folders as the page spans
        )
        spark = self.index.sparkSession
        if not hit[1]:
            return spark.createDataFrame([], self.schema)
        parts = [f"{self.folder}/rows/{PAGE_FILE}={file}" for file in sorted(hit[1])]
        rows = spark.read.schema(StructType([*self.schema.fields, StructField(PAGE_BLOCK, LongType())])).parquet(*parts).filter(F.col(PAGE_BLOCK).between(hit[2], hit[3]))
        return rows.drop(PAGE_BLOCK).orderBy(self.row_id).offset(offset - hit[0]).limit(limit)


def store_pages(df: DataFrame, row_id: str, folder: str, block_rows: int = PAGE_ROWS) -> Pages:
    """Store ``df`` in blocks of about ``block_rows`` rows in the order of ``row_id`` (unique), and an index of the blocks.

    Many small blocks share a folder, so tasks and files grow with the rows and not with the blocks. The number of a block is stored beside its rows, which lie
    in order, and a stored page of a column holds no more rows than a block: reading a block passes over the rest of its folder. The first row of a block is a
    running sum over the index, so finding a page costs the same at any offset.
    """
    if {PAGE_BLOCK, PAGE_FILE} & set(df.columns):
        raise MartError(f"the names '{PAGE_BLOCK}' and '{PAGE_FILE}' are taken")
    folders = max(1, -(-df.count() // max(block_rows, FILE_ROWS)))
    ranged = df.repartitionByRange(folders, row_id).withColumn(PAGE_FILE, F.spark_partition_id())
    place = F.rank().over(Window.partitionBy(PAGE_FILE).orderBy(row_id)) - 1  # equal ids stay in one block
    block = F.col(PAGE_FILE).cast("bigint") * 2**32 + F.floor(place / block_rows)
    placed = ranged.withColumn(PAGE_BLOCK, block)
    placed.write.option("parquet.page.row.count.limit", block_rows).partitionBy(PAGE_FILE).parquet(f"{folder}/rows")
    spark = df.sparkSession
    stored = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    counted = stored.groupBy(F.col(PAGE_BLOCK).alias("block"), F.col(PAGE_FILE).alias("file")).agg(F.count("*").alias("rows"))
    summed = scale.Sequenced(counted, [], ["block"]).with_running_sum("end", "rows").rows()
    summed.select("block", "file", "rows", (F.col("end") - F.col("rows")).alias("first_row")).write.parquet(f"{folder}/index")
    return Pages(spark.read.schema("block bigint, file int, rows bigint, first_row bigint").parquet(f"{folder}/index"), folder, df.schema, row_id)
