"""Filters, samples, previews and user-written read-only SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import all_of, quoted, try_numeric
from ..functions.roles import is_datetime, numeric_columns
from ..functions.text import shorten
from .correlation import corr_ranked
from .profiling import row_digest

# Page sizes.
FILTER_PAGE = 100
SAMPLE_DEFAULT = 50
PREVIEW_ROWS, PREVIEW_WIDTH = 12, 16
NUMERIC_SAMPLE_ROWS = 5000
PAIR_SAMPLE_ROWS = 1000

Condition = tuple[str, str, float]

_COMPARE = {
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    "=": lambda c, v: c == v,
}


def between(column: str, low: float, high: float) -> list[Condition]:
    """Both ends included."""
    return [(column, ">=", low), (column, "<=", high)]


def _predicate(df: DataFrame, conditions: list[Condition]) -> Column:
    if not conditions:
        raise ValueError("at least one condition is needed")
    return all_of(
        [_COMPARE[op](try_numeric(df, c), F.lit(float(v))) for c, op, v in conditions]
    )


def filter_rows(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """All rows that meet every (column, operator, number) condition."""
    return df.where(_predicate(df, conditions))


def filter_page(
    df: DataFrame, conditions: list[Condition], order_by: list[str], limit: int = FILTER_PAGE
) -> DataFrame:
    """The first page of :func:`filter_rows` in a stated order."""
    return filter_rows(df, conditions).orderBy(*order_by).limit(limit)


def filter_count(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    return filter_rows(df, conditions).agg(F.count(F.lit(1)).alias("count"))


def filter_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return filter_rows(df, between(column, low, high))


def sample_rows(
    df: DataFrame, limit: int = SAMPLE_DEFAULT, order_by: list[str] | None = None
) -> DataFrame:
    """A page of rows; the first ones of an order, if one is given."""
    if limit < 1:
        raise ValueError(f"limit is {limit}; at least one row is needed")
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def preview_rows(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Twelve rows with every value as short text: dates by day, "-" for NULL."""
    page = (df.orderBy(*order_by) if order_by else df).limit(PREVIEW_ROWS)

    def shown(c: str) -> Column:
        col = quoted(c)
        if is_datetime(df.schema[c].dataType):
            col = col.cast("date")
        return F.coalesce(shorten(col, PREVIEW_WIDTH), F.lit("-")).alias(c)

    return page.select(*[shown(c) for c in df.columns])


def keyed_hash(key: Column, seed: int = 0) -> Column:
    """The place of a row in a sample: MD5 of seed and key, as hexadecimal text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def _bottom(df: DataFrame, lanes: list[dict[str, Column]], place: Column, limit: int) -> DataFrame:
    """(lane, fields...): of every lane the ``limit`` rows with the smallest ``place``.

    A lane is a set of fields, all of which must be there for a row to take part. A first
    scan counts the rows of each lane by the first three digits of the place; the second
    one takes only rows up to the digits that reach ``limit``, and no more than ``limit``
    of a task leave it. Rows with the same place and fields are the same in the result.
    """
    if limit < 1:
        raise ValueError(f"limit is {limit}; at least one row is needed")
    names = list(lanes[0])
    entries = [F.struct(F.lit(i).alias("lane"), *[c.alias(n) for n, c in lane.items()]) for i, lane in enumerate(lanes)]
    rows = df.select(place.alias("_h"), F.inline(F.array(*entries)))
    rows = rows.where(all_of([F.col(n).isNotNull() for n in names]))
    rows = rows.withColumn("_p", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("lane", "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("lane").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    enough = counts.withColumn("_n", F.sum("_n").over(upto)).where(F.col("_n") >= limit)
    last = enough.groupBy("lane").agg(F.min("_p").alias("_p"))
    last = last.agg(F.map_from_entries(F.collect_list(F.struct("lane", "_p")))).scalar()
    every = F.coalesce(F.element_at(last, F.col("lane")), F.lit(1 << 12))
    order = Window.partitionBy("lane").orderBy("_h", *names)
    chosen = rows.where(F.col("_p") <= every).withColumn("_n", F.row_number().over(order))
    return chosen.where(F.col("_n") <= limit).select("lane", *names)


def keyed_samples(
    df: DataFrame,
    columns: list[str] | None = None,
    key: str | None = None,
    limit: int = NUMERIC_SAMPLE_ROWS,
    seed: int = 0,
) -> DataFrame:
    """(column_name, value): up to ``limit`` numeric values of each column, drawn by a hash.

    The rows with the smallest hash of ``key`` (a column with a value of its own per row;
    without one, the whole row) and ``seed`` are taken, so the sample represents the table
    and is the same however its rows are laid out. All columns share the two scans.
    """
    columns = numeric_columns(df) if columns is None else columns
    place = keyed_hash(F.hex(row_digest(df)) if key is None else quoted(key), seed)
    found = _bottom(df, [{"value": try_numeric(df, c)} for c in columns], place, limit)
    return found.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("lane")).alias("column_name"), "value")


def numeric_sample(
    df: DataFrame,
    column: str,
    order_by: list[str] | None = None,
    limit: int = NUMERIC_SAMPLE_ROWS,
    key: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Up to ``limit`` numeric values of a column for a plot: the first ones of an order,
    if one is given, else those drawn by a hash as in :func:`keyed_samples`."""
    if not order_by:
        return keyed_samples(df, [column], key, limit, seed).select("value")
    rows = df.select(*order_by, try_numeric(df, column).alias("value")).where(F.col("value").isNotNull())
    return rows.orderBy(*order_by).limit(limit).select("value")


def pair_sample(
    df: DataFrame,
    x: str,
    y: str,
    order_by: list[str] | None = None,
    limit: int = PAIR_SAMPLE_ROWS,
    key: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Up to ``limit`` points at which both columns are numbers, the first of an order or,
    without one, drawn by a hash as in :func:`keyed_samples`."""
    point = {"x": try_numeric(df, x), "y": try_numeric(df, y)}
    if not order_by:
        place = keyed_hash(F.hex(row_digest(df)) if key is None else quoted(key), seed)
        return _bottom(df, [point], place, limit).select("x", "y")
    rows = df.select(*order_by, *[c.alias(n) for n, c in point.items()])
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.orderBy(*order_by).limit(limit).select("x", "y")


def top_correlated_points(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    pairs: int = 3,
    limit: int = PAIR_SAMPLE_ROWS,
) -> DataFrame:
    """Points of the ``pairs`` strongest correlations: (column_x, column_y, x, y).

    The winning pairs are a scalar subquery, computed once; every place of the
    ranking then takes its own bounded sample. The number of scans follows
    ``pairs``, not the number of columns.
    """
    number = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    best = (
        corr_ranked(df, columns)
        .limit(pairs)
        .agg(
            F.collect_list(
                F.struct(number[F.col("column_x")].alias("i"), number[F.col("column_y")].alias("j"))
            )
        )
        .scalar()
    )
    names = F.array(*[F.lit(c) for c in columns])
    values = F.array(*[try_numeric(df, c) for c in columns])
    pages = None
    for place in range(pairs):
        page = (
            df.select(*order_by, values.alias("_v"), F.get(best, F.lit(place)).alias("_p"))
            .select(
                *order_by,
                F.get(names, F.col("_p.i")).alias("column_x"),
                F.get(names, F.col("_p.j")).alias("column_y"),
                F.get("_v", F.col("_p.i")).alias("x"),
                F.get("_v", F.col("_p.j")).alias("y"),
            )
            .where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .orderBy(*order_by)
            .limit(limit)
            .select("column_x", "column_y", "x", "y")
        )
        pages = page if pages is None else pages.unionByName(page)
    return pages


# Spark functions that run other code than the query's.
_ESCAPES = {"java_method", "reflect", "try_reflect"}
_CATALYST = "org.apache.spark.sql.catalyst"


def clean_sql(text: str) -> str:
    """The statement in an answer: its fenced block, or from the first line that
    begins one; without the closing semicolon."""
    fenced = re.search(r"```[a-z]*\n?(.*?)(?:```|\Z)", text or "", re.DOTALL | re.IGNORECASE)
    lines = (fenced[1] if fenced else text or "").strip().splitlines()
    begins = [i for i, x in enumerate(lines) if re.match(r"\s*\(*(select|with)\b", x, re.IGNORECASE)]
    return "\n".join(lines[begins[0] if begins else 0 :]).rstrip().rstrip(";").rstrip()


def _reads_only(jvm, plan, names: set[str]) -> bool:
    """Whether every relation below a parsed plan has one of ``names`` or of the plan's own
    CTEs, and nothing is changed or run."""

    def is_a(node, kind: str) -> bool:
        return jvm.java.lang.Class.forName(f"{_CATALYST}.{kind}").isInstance(node)

    def each(found):
        return [found.apply(i) for i in range(found.size())]

    def allowed(expression) -> bool:
        if is_a(expression, "analysis.UnresolvedFunction"):
            if each(expression.nameParts())[-1].lower() in _ESCAPES:
                return False
        if is_a(expression, "expressions.PlanExpression") and not _reads_only(
            jvm, expression.plan(), names
        ):
            return False
        return all(map(allowed, each(expression.children())))

    if any(
        is_a(plan, f"plans.logical.{kind}")
        for kind in ("Command", "ParsedStatement", "CompoundPlanStatement")
    ):
        return False
    if is_a(plan, "analysis.UnresolvedRelation"):
        parts = each(plan.multipartIdentifier())
        return len(parts) == 1 and parts[0].lower() in names
    if is_a(plan, "analysis.UnresolvedTableValuedFunction"):
        if each(plan.name())[-1].lower() in _ESCAPES:
            return False
    if is_a(plan, "plans.logical.UnresolvedWith"):
        names = set(names)
        for cte in each(plan.cteRelations()):
            own = {cte._1().lower()} if plan.allowRecursion() else set()
            if not _reads_only(jvm, cte._2(), names | own):
                return False
            names.add(cte._1().lower())
        return _reads_only(jvm, plan.child(), names)
    return all(map(allowed, each(plan.expressions()))) and all(
        _reads_only(jvm, child, names) for child in each(plan.children())
    )


def is_read_only(sql: str, name: str = "main_table") -> bool:
    """One query, by Spark's own parser, that reads ``name`` and its own CTEs only."""
    spark, sql = SparkSession.active(), clean_sql(sql)
    if not re.match(r"\(*\s*(?:select|with)\b", sql, flags=re.IGNORECASE):
        return False
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException:
        return False
    return _reads_only(spark._jvm, plan, {name.lower()})


def _nodes(plan):
    """A plan, what is below it and the plans of its subqueries."""
    yield plan
    for seq in (plan.children(), plan.subqueries()):
        for i in range(seq.size()):
            yield from _nodes(seq.apply(i))


def _generated(jvm, node) -> list[float]:
    """How many rows the generators of a node make of one row; infinite if its data decide."""

    def sizes(expression):
        kind = expression.getClass().getSimpleName()
        if kind in ("Sequence", "ArrayRepeat", "StringRepeat"):
            parts = [expression.children().apply(i) for i in range(expression.children().size())]
            parts = parts if kind == "Sequence" else parts[-1:]
            values = [p.eval(None) for p in parts] if all(p.foldable() for p in parts) else [None]
            if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in values):
                yield float("inf")  # from the data, or dates and times, whose steps are not numbers
            elif kind == "Sequence":
                yield abs(values[1] - values[0]) / max(abs(values[2]) if len(values) > 2 else 1, 1e-300) + 1
            else:
                yield values[0]
        else:
            for i in range(expression.children().size()):
                yield from sizes(expression.children().apply(i))

    expressions = node.expressions()
    return [n for i in range(expressions.size()) for n in sizes(expressions.apply(i))]


def admit(df: DataFrame, side_rows: int = 1000, generated: int = 100_000) -> None:
    """ValueError if a query's plan has a step whose output is not bounded by its input.

    Refused are joins without an equality that Spark could join by, unless one side has at
    most ``side_rows`` rows for certain (an aggregate of the whole, a limit); sequences and
    repeats of more than ``generated`` elements, or of a number that comes from the data;
    and number tables longer than that. Nothing is run.
    """
    jvm = df.sparkSession._jvm
    # Before the optimiser, as that works out constant sequences.
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        kind = node.getClass().getSimpleName()
        if any(n > generated for n in _generated(jvm, node)):
            raise ValueError(f"a sequence or repeat may make more than {generated} elements")
        if kind == "Range" and int(node.numElements()) > generated:
            raise ValueError(f"a number table has more than {generated} rows")
    planning = jvm.org.apache.spark.sql.catalyst.planning
    for node in _nodes(df._jdf.queryExecution().optimizedPlan()):
        if node.getClass().getSimpleName() != "Join":
            continue
        keyed = planning.ExtractEquiJoinKeys.unapply(node).isDefined()
        keyed = keyed or planning.ExtractSingleColumnNullAwareAntiJoin.unapply(node).isDefined()
        small = [side.maxRows() for side in (node.left(), node.right())]
        if not keyed and not any(m.isDefined() and m.get() <= side_rows for m in small):
            raise ValueError("a join has no equality to join by, and no side that is small for certain")


def readonly_sql(
    df: DataFrame,
    sql: str,
    name: str = "main_table",
    max_rows: int | None = None,
    side_rows: int | None = 1000,
    generated: int = 100_000,
) -> DataFrame:
    """Run one read-only statement over ``df``, visible to it as ``main_table``.

    Nothing else of the session can be read, and no view of it is replaced. Statements
    whose plan can grow beyond the table are refused (see :func:`admit`; ``side_rows=None``
    admits them). ``max_rows`` cuts the result; None returns all of it.
    """
    if not is_read_only(sql, name):
        raise ValueError("only a single read-only SELECT or WITH statement is accepted")
    if side_rows is not None:
        # How the table itself came about plays no part: the plan judged has a table of
        # its form in its place, of which the optimiser knows no size. Nothing is run.
        unknown = df.sparkSession.createDataFrame(df.sparkSession.sparkContext.emptyRDD(), df.schema)
        admit(_statement(unknown, sql, name), side_rows, generated)
    out = _statement(df, sql, name)
    return out if max_rows is None else out.limit(max_rows)


def _statement(df: DataFrame, sql: str, name: str) -> DataFrame:
    private = f"_readonly_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(private)
    try:
        return df.sparkSession.sql(f"WITH `{name}` AS (SELECT * FROM {private}) ({clean_sql(sql)}\n)")
    finally:
        df.sparkSession.catalog.dropTempView(private)
