"""Calendar trends. Only per-period results, never rows, are compared over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import quoted, try_date, try_numeric

GRAINS = ("day", "week", "month", "year")
_STABLE_PCT = 1.0  # fixed value: changes up to this count as stable


def trend(
    df: DataFrame,
    date: str,
    metric: str,
    grain: str = "day",
    agg: str = "SUM",
    ordered: bool = True,
) -> DataFrame:
    """(period, value): the sum or average per calendar period; weeks start on Monday.

    ``ordered=False`` saves the sort where the result is aggregated further.
    """
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; one of {', '.join(GRAINS)}")
    combine = {"SUM": F.sum, "AVG": F.avg}[agg.upper()]
    day = try_date(df, date)
    period = day if grain == "day" else F.date_trunc(grain, day).cast("date")
    values = (
        df.select(period.alias("period"), try_numeric(df, metric).alias("_m"))
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(combine("_m").alias("value"))
    )
    return values.orderBy("period") if ordered else values


def daily_series(
    df: DataFrame, date: str, metric: str | None = None, ordered: bool = True
) -> DataFrame:
    """(day, value): the sum of a metric, or the number of rows, per day."""
    rows = df.select(
        try_date(df, date).alias("day"),
        (try_numeric(df, metric) if metric else F.lit(1.0)).alias("_m"),
    ).where(F.col("day").isNotNull())
    value = F.sum("_m") if metric else F.count(F.lit(1))
    values = rows.groupBy("day").agg(value.alias("value"))
    return values.orderBy("day") if ordered else values


def normalized_series(df: DataFrame, date: str, metrics: list[str]) -> DataFrame:
    """(day, metric, value, normalized) of the metrics, each scaled to 0..1."""
    if not metrics:
        raise ValueError("at least one metric is needed")
    daily = (
        df.select(
            try_date(df, date).alias("day"),
            *[try_numeric(df, m).alias(f"_m{i}") for i, m in enumerate(metrics)],
        )
        .where(F.col("day").isNotNull())
        .groupBy("day")
        .agg(
            *[F.coalesce(F.sum(f"_m{i}"), F.lit(0.0)).alias(f"_m{i}") for i in range(len(metrics))]
        )
    )
    # The ranges read the shuffle of the daily sums again, not the table.
    ranges = daily.agg(
        F.struct(
            *[F.min(f"_m{i}").alias(f"lo{i}") for i in range(len(metrics))],
            *[F.max(f"_m{i}").alias(f"hi{i}") for i in range(len(metrics))],
        )
    ).scalar()
    entries = []
    for i, m in enumerate(metrics):
        v, lo, hi = F.col(f"_m{i}"), F.col(f"_r.lo{i}"), F.col(f"_r.hi{i}")
        entries.append(
            F.struct(
                F.lit(m).alias("metric"),
                v.alias("value"),
                F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)).alias("normalized"),
            )
        )
    return daily.withColumn("_r", ranges).select("day", F.inline(F.array(*entries)))


def series_peak_low(series: DataFrame, period: str = "day", value: str = "value") -> DataFrame:
    """One row: when a series is highest and lowest; the first date wins a tie."""
    v, p = F.col(value).cast("double"), F.col(period)
    rows = series.where(v.isNotNull())
    peak = F.min_by(F.struct(p.alias("p"), v.alias("v")), F.struct((-v).alias("v"), p.alias("p")))
    low = F.min_by(F.struct(p.alias("p"), v.alias("v")), F.struct(v.alias("v"), p.alias("p")))
    return rows.agg(
        peak.getField("p").alias("peak_period"),
        peak.getField("v").alias("peak_value"),
        low.getField("p").alias("low_period"),
        low.getField("v").alias("low_value"),
    )


def trend_change(series: DataFrame, period: str = "period", value: str = "value") -> DataFrame:
    """One row: first and last value, change in percent of the first, direction.

    Needs two values; with fewer there is no row. A first value of zero gives
    no percentage and no direction.
    """
    v = F.col(value).cast("double")
    row = (
        series.where(v.isNotNull() & ~F.isnan(v))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min_by(v, period).alias("first_value"),
            F.max_by(v, period).alias("last_value"),
        )
        .where(F.col("_n") >= 2)
    )
    change: Column = F.try_divide(
        F.col("last_value") - F.col("first_value"), F.abs("first_value")
    ) * F.lit(100.0)
    return row.select("first_value", "last_value", change.alias("change_pct")).withColumn(
        "direction",
        F.when(F.col("change_pct") > _STABLE_PCT, F.lit("increased"))
        .when(F.col("change_pct") < -_STABLE_PCT, F.lit("decreased"))
        .when(F.col("change_pct").isNotNull(), F.lit("stable")),
    )


def linear_forecast(df: DataFrame, date: str, metric: str, horizon: int = 7) -> DataFrame:
    """(x, y, forecast): the daily totals continued along their least-squares line.

    Known days have ``y``, the ``horizon`` days after the last one ``forecast``.
    """
    daily = trend(df, date, metric, "day", ordered=False)
    days = F.datediff("period", F.lit("1970-01-01").cast("date")).cast("double")
    line = daily.agg(
        F.regr_slope("value", days).alias("slope"),
        F.regr_intercept("value", days).alias("intercept"),
        F.max("period").alias("last_day"),
    )
    ahead = (
        line.where(F.col("last_day").isNotNull())
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
        .withColumn("x", F.date_add("last_day", F.col("step")))
        .select(
            "x",
            F.lit(None).cast("double").alias("y"),
            (
                F.col("intercept")
                + F.col("slope")
                * F.datediff("x", F.lit("1970-01-01").cast("date")).cast("double")
            ).alias("forecast"),
        )
    )
    known = daily.select(
        F.col("period").alias("x"),
        F.col("value").alias("y"),
        F.lit(None).cast("double").alias("forecast"),
    )
    return known.unionByName(ahead)


_WEEKDAY_SPAN = 14  # fixed value: days from which weekdays are told apart


def dense_days(daily: DataFrame, by: list[str], day: str = "x", value: str = "y") -> DataFrame:
    """Daily values with the days between the first and the last of each group that have
    none, as 0.0: every row brings the missing days up to the next one. One row per group
    and day in, so what a window holds is bounded by the calendar."""
    following = F.lead(day).over(Window.partitionBy(*map(quoted, by)).orderBy(day))
    rows = daily.withColumn("_next", following)
    upto = F.coalesce(F.date_sub("_next", 1), F.col(day))
    rows = rows.select("*", F.explode(F.sequence(F.col(day), upto)).alias("_d"))
    return rows.select(
        *map(quoted, by), F.col("_d").alias(day), F.when(F.col("_d") == F.col(day), F.col(value)).otherwise(F.lit(0.0)).alias(value)
    )


def forecast_groups(
    df: DataFrame, date: str, metric: str, by: list[str], horizon: int = 7, weekday: bool = False
) -> DataFrame:
    """(by..., x, y, forecast): the daily totals of each group and their continuation.

    Every group has one row for each day from its first to its last, with ``y`` (0.0 where
    it has no rows), and one for each of the ``horizon`` days after, with ``forecast``. The
    line is the least-squares one through all its days. With ``weekday`` each day of the
    week has a level of its own beside a common slope (the least-squares solution for both
    together), in groups that span two weeks or more. A group of one day is continued at
    its value. Rows without a date are left out, NULL groups are kept. All groups are done
    at once: sums per group and weekday, of which at most seven are put together.
    """
    if horizon < 1:
        raise ValueError(f"horizon is {horizon}; at least one day is needed")
    if not by:
        raise ValueError("at least one column to group by is needed; see linear_forecast")
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.select(
        *[quoted(n).alias(k) for n, k in zip(by, names, strict=True)],
        try_date(df, date).alias("x"),
        try_numeric(df, metric).alias("_m"),
    ).where(F.col("x").isNotNull())
    daily = rows.groupBy(*names, "x").agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("y"))
    dense = dense_days(daily, names)
    t = F.datediff("x", F.lit("1970-01-01").cast("date")).cast("double")
    y = F.col("y")
    week = dense.withColumn("_t", t).groupBy(*names, F.dayofweek("x").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_t").alias("t"), F.avg(y).alias("y"),
        F.var_pop("_t").alias("tt"), F.covar_pop("_t", y).alias("ty"), F.max("x").alias("last"),
    )
    groups = week.groupBy(*names).agg(
        F.collect_list(F.struct("w", "n", "t", "y", "tt", "ty")).alias("week"), F.max("last").alias("last"), F.sum("n").alias("days")
    )

    def total(f) -> Column:
        return F.aggregate("week", F.lit(0.0), lambda a, d: a + d["n"] * f(d))

    mean_t, mean_y = total(lambda d: d["t"]) / F.col("days"), total(lambda d: d["y"]) / F.col("days")
    groups = groups.withColumns({"mt": mean_t, "my": mean_y})
    # Sums of squares within weekdays, and those of the weekdays' means around the whole.
    within = F.try_divide(total(lambda d: d["ty"]), total(lambda d: d["tt"]))
    across = F.try_divide(
        total(lambda d: d["ty"] + (d["t"] - F.col("mt")) * (d["y"] - F.col("my"))),
        total(lambda d: d["tt"] + (d["t"] - F.col("mt")) * (d["t"] - F.col("mt"))),
    )
    by_week = F.lit(weekday) & (F.col("days") >= _WEEKDAY_SPAN)
    groups = groups.withColumn("slope", F.coalesce(F.when(by_week, within).otherwise(across), F.lit(0.0)))
    own = F.map_from_entries(F.transform("week", lambda d: F.struct(d["w"], d["y"] - F.col("slope") * d["t"])))
    groups = groups.withColumn("level", F.when(by_week, own)).withColumn("base", F.col("my") - F.col("slope") * F.col("mt"))
    ahead = groups.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ahead = ahead.withColumn("x", F.date_add("last", F.col("step")))
    level = F.coalesce(F.element_at("level", F.dayofweek("x")), F.col("base"))
    none = F.lit(None).cast("double")
    out = dense.select(*names, "x", "y", none.alias("forecast")).unionByName(
        ahead.select(*names, "x", none.alias("y"), (level + F.col("slope") * t).alias("forecast"))
    )
    return out.select(*[F.col(k).alias(n) for n, k in zip(by, names, strict=True)], "x", "y", "forecast")
