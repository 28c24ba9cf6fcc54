"""Business ratios. All are ratios of sums, never means of row ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import percent_of, quoted, try_numeric

# Each takes the sums of its two columns.
_FORMULAS: dict[str, Callable[[Column, Column], Column]] = {
    "roi": lambda revenue, cost: percent_of(revenue - cost, cost),
    "profit_margin": lambda revenue, cost: percent_of(revenue - cost, revenue),
    "conversion_rate": percent_of,
    "cost_per_lead": F.try_divide,
    "revenue_per_conversion": F.try_divide,
    "profit": lambda revenue, cost: revenue - cost,
}


def _kpi(df: DataFrame, kind: str, columns: tuple[str, str]) -> Column:
    first, second = [F.sum(try_numeric(df, c)) for c in columns]
    return _FORMULAS[kind](first, second).alias("value")


def kpi(df: DataFrame, kind: str, first: str, second: str) -> DataFrame:
    """One row with the KPI named ``kind`` as ``value``; see the named functions."""
    return df.agg(_kpi(df, kind, (first, second)))


def kpi_roi(df: DataFrame, revenue: str = "revenue", cost: str = "cost") -> DataFrame:
    return kpi(df, "roi", revenue, cost)


def kpi_profit_margin(df: DataFrame, revenue: str = "revenue", cost: str = "cost") -> DataFrame:
    return kpi(df, "profit_margin", revenue, cost)


def kpi_conversion_rate(
    df: DataFrame, conversions: str = "conversions", leads: str = "leads"
) -> DataFrame:
    return kpi(df, "conversion_rate", conversions, leads)


def kpi_cost_per_lead(df: DataFrame, cost: str = "cost", leads: str = "leads") -> DataFrame:
    return kpi(df, "cost_per_lead", cost, leads)


def kpi_revenue_per_conversion(
    df: DataFrame, revenue: str = "revenue", conversions: str = "conversions"
) -> DataFrame:
    return kpi(df, "revenue_per_conversion", revenue, conversions)


def kpi_profit(df: DataFrame, revenue: str = "revenue", cost: str = "cost") -> DataFrame:
    return kpi(df, "profit", revenue, cost)


def kpi_by_group(
    df: DataFrame,
    group: str,
    kind: str,
    first: str,
    second: str,
    drop_null_group: bool = False,
) -> DataFrame:
    """(group, value), highest first. The NULL group counts unless dropped."""
    rows = df.where(quoted(group).isNotNull()) if drop_null_group else df
    return (
        rows.groupBy(quoted(group).alias(group))
        .agg(_kpi(df, kind, (first, second)))
        .orderBy(F.col("value").desc_nulls_last(), quoted(group).asc_nulls_last())
    )


def best_roi_group(
    df: DataFrame, group: str = "campaign", revenue: str = "revenue", cost: str = "cost"
) -> DataFrame:
    """The group with the highest return on cost."""
    return kpi_by_group(df, group, "roi", revenue, cost, drop_null_group=True).limit(1)


# Column names an executive summary looks for, by what they hold.
SUMMARY_ALIASES = {
    "revenue": ("revenue", "gross revenue", "sales"),
    "net_revenue": ("net revenue", "net sales"),
    "profit": ("profit", "net profit", "gross profit"),
    "marketing_spend": ("marketing spend", "advertising spend", "ad spend"),
    "cost": ("cost", "total cost", "expenses", "expense"),
    "units_sold": ("units sold", "quantity", "units"),
    "returns": ("returns", "returned units", "return units"),
    "customer_rating": ("customer rating", "rating"),
    "region": ("region", "territory", "area"),
    "team": ("team",),
    "campaign": ("campaign", "campaign name"),
    "leads": ("leads", "lead"),
    "conversions": ("conversions", "conversion"),
    "product": ("product", "product name", "item"),
    "channel": ("channel", "sales channel"),
}


def summary_fields(df: DataFrame, **given: str | None) -> dict[str, str | None]:
    """Which column holds which field: the one given, else the first with a known name."""
    plain = {}
    for c in df.columns:
        plain.setdefault(" ".join(c.lower().replace("_", " ").replace("-", " ").split()), c)
    order = {c: i for i, c in enumerate(df.columns)}
    found = {}
    for field, names in SUMMARY_ALIASES.items():
        hits = sorted((plain[n] for n in names if n in plain), key=order.__getitem__)
        found[field] = given.get(field) or (hits[0] if hits else None)
    return found


def executive_summary(df: DataFrame, **given: str | None) -> DataFrame:
    """One row of totals and weighted ratios; a field the table lacks is NULL.

    A stored profit is preferred; without one, profit is revenue minus cost.
    """
    fields = summary_fields(df, **given)

    def total(field: str) -> Column:
        return F.sum(try_numeric(df, fields[field])) if fields[field] else F.lit(None).cast("double")

    totals = {
        "total_revenue": "revenue",
        "total_net_revenue": "net_revenue",
        "_stored_profit": "profit",
        "total_marketing_spend": "marketing_spend",
        "total_cost": "cost",
        "total_units_sold": "units_sold",
        "total_returns": "returns",
        "total_leads": "leads",
        "total_conversions": "conversions",
    }
    rating = fields["customer_rating"]
    row = df.agg(
        F.count(F.lit(1)).alias("records"),
        *[total(field).alias(alias) for alias, field in totals.items()],
        (F.avg(try_numeric(df, rating)) if rating else F.lit(None).cast("double")).alias(
            "average_customer_rating"
        ),
    ).withColumn(
        "total_profit",
        F.coalesce("_stored_profit", F.col("total_revenue") - F.col("total_cost")),
    )
    margin_base = F.coalesce(F.nullif("total_net_revenue", F.lit(0.0)), "total_revenue")
    return row.select(
        "records",
        "total_revenue",
        "total_net_revenue",
        "total_profit",
        "total_marketing_spend",
        "total_cost",
        "total_units_sold",
        "total_returns",
        "total_leads",
        "total_conversions",
        "average_customer_rating",
        percent_of(F.col("total_profit"), margin_base).alias("profit_margin_percent"),
        percent_of(F.col("total_returns"), F.col("total_units_sold")).alias(
            "return_rate_percent"
        ),
        F.try_divide("total_profit", "total_marketing_spend").alias(
            "profit_to_marketing_spend_ratio"
        ),
        percent_of(F.col("total_profit"), F.col("total_cost")).alias("roi_percent"),
        percent_of(F.col("total_conversions"), F.col("total_leads")).alias(
            "conversion_rate_percent"
        ),
    )


def dimension_leaders(df: DataFrame, metric: str, dimensions: dict[str, str]) -> DataFrame:
    """(dimension, leader, total): the group with the highest total per dimension.

    ``dimensions`` maps a label to a column. All dimensions are unpivoted and
    summed in one scan.
    """
    entries = [
        F.struct(
            F.lit(label).alias("dimension"),
            quoted(column).cast("string").alias("leader"),
            F.col("_metric").alias("m"),
        )
        for label, column in dimensions.items()
    ]
    # Dimension columns come first, so a metric that is also a dimension is safe.
    source = df.select(
        *[quoted(c) for c in dict.fromkeys(dimensions.values())],
        try_numeric(df, metric).alias("_metric"),
    )
    totals = (
        source.select(F.inline(F.array(*entries)))
        .where(F.col("leader").isNotNull())
        .groupBy("dimension", "leader")
        .agg(F.sum("m").alias("total"))
    )
    ahead = F.struct(F.coalesce(-F.col("total"), F.lit(float("inf"))).alias("v"), "leader")
    return totals.groupBy("dimension").agg(
        F.min_by("leader", ahead).alias("leader"), F.min_by("total", ahead).alias("total")
    )


def summary_leaders(df: DataFrame, **given: str | None) -> DataFrame:
    """:func:`dimension_leaders` over the dimensions an executive summary names."""
    fields = summary_fields(df, **given)
    metric = fields["revenue"] or fields["net_revenue"] or fields["profit"]
    place = "region" if fields["region"] else "team"
    dimensions = {
        label: fields[label]
        for label in (place, "product", "channel", "campaign")
        if fields[label]
    }
    if not metric or not dimensions:
        raise ValueError("needs a revenue or profit column and at least one dimension")
    return dimension_leaders(df, metric, dimensions)
