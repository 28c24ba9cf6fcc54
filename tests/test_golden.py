"""Known results on two small sales tables."""

import datetime

import pytest

from siftframe.operators import aggregates as A
from siftframe.operators import correlation as C
from siftframe.operators import grouping as G
from siftframe.operators import kpis as K
from siftframe.operators import timeseries as T

# A campaign funnel
# (day, campaign, channel, team, leads, conversions, revenue, cost).
FUNNEL = [
    (1, "Diwali Mega Sale", "Digital Ads", "North", 120, 18, 54000, 12500),
    (2, "Diwali Mega Sale", "Social Media", "South", 95, 14, 42000, 9800),
    (3, "Website Retargeting", "Email", "West", 80, 16, 48000, 6200),
    (4, "New Customer Drive", "Search Ads", "South", 140, 21, 73500, 15000),
    (5, "Website Retargeting", "Digital Ads", "East", 75, 9, 27000, 7100),
    (6, "Festive Email Push", "Email", "North", 110, 22, 66000, 5200),
    (7, "New Customer Drive", "Search Ads", "South", 135, 19, 66500, 14200),
    (8, "Brand Awareness Q4", "Social Media", "West", 160, 12, 36000, 11000),
    (9, "Festive Email Push", "Email", "South", 125, 25, 87500, 6000),
    (10, "Website Retargeting", "Search Ads", "East", 90, 17, 59500, 7600),
    (11, "Diwali Mega Sale", "Social Media", "North", 150, 24, 96000, 17500),
    (12, "New Customer Drive", "Digital Ads", "West", 105, 13, 39000, 10200),
    (13, "Brand Awareness Q4", "Search Ads", "South", 170, 15, 45000, 13000),
    (14, "Festive Email Push", "Email", "East", 115, 20, 70000, 5500),
    (15, "Diwali Mega Sale", "Digital Ads", "South", 180, 32, 128000, 22000),
    (16, "Website Retargeting", "Email", "North", 100, 19, 66500, 6300),
    (17, "New Customer Drive", "Search Ads", "East", 130, 18, 63000, 13500),
    (18, "Brand Awareness Q4", "Social Media", "South", 155, 20, 60000, 12000),
    (19, "Festive Email Push", "Email", "West", 145, 28, 98000, 6500),
    (20, "Diwali Mega Sale", "Digital Ads", "South", 190, 35, 140000, 24000),
]
# transactions
# (region, product, channel, units_sold, marketing_spend, customer_rating, returns,
#  revenue, net_revenue, profit).
TRANSACTIONS = [
    ("South", "Laptop", "Online", 2, 10, 4.5, 0, 200, 200, 40),
    ("South", "Phone", "Retail", 1, 15, 4.0, 1, 200, 180, 45),
    ("East", "Laptop", "Online", 1, 8, 4.2, 0, 100, 100, 20),
    ("North", "Mouse", "Retail", 2, 5, 3.8, 0, 40, 40, 10),
    ("West", "Tablet", "Wholesale", 1, 20, 4.8, 0, 300, 270, 81),
    ("West", "Headphones", "Online", 1, 6, 4.0, 1, 50, 0, 0),
]


@pytest.fixture(scope="module")
def funnel(spark):
    rows = [(datetime.date(2026, 10, day), *rest) for day, *rest in FUNNEL]
    return spark.createDataFrame(
        rows,
        "date date, campaign string, channel string, team string, leads long,"
        " conversions long, revenue long, cost long",
    ).cache()


@pytest.fixture(scope="module")
def transactions(spark):
    return spark.createDataFrame(
        TRANSACTIONS,
        "region string, product string, channel string, units_sold long, marketing_spend long,"
        " customer_rating double, returns long, revenue long, net_revenue long, profit long",
    ).cache()


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_revenue_by_team_and_channel(funnel):
    by_team = pairs(G.group_agg(funnel, "team", "revenue"))
    assert len(by_team) == 4 and by_team["South"] == 642500
    by_channel = pairs(G.group_agg(funnel, "channel", "revenue"))
    assert len(by_channel) == 4 and by_channel["Email"] == 436000


def test_funnel_kpis(funnel):
    assert K.kpi_profit(funnel).head()[0] == 1140400
    assert K.kpi_roi(funnel).head()[0] == pytest.approx(506.6192803198578)
    assert K.kpi_conversion_rate(funnel).head()[0] == pytest.approx(15.447470817120623)


def test_funnel_summary(funnel):
    row = K.executive_summary(funnel).head()
    assert row["total_revenue"] == 1365500 and row["total_profit"] == 1140400
    assert row["roi_percent"] == pytest.approx(506.62, abs=0.005)
    assert row["total_net_revenue"] is None and row["total_marketing_spend"] is None
    leaders = {r["dimension"]: r["leader"] for r in K.summary_leaders(funnel).collect()}
    assert leaders["team"] == "South" and leaders["campaign"] == "Diwali Mega Sale"
    assert K.best_roi_group(funnel).head()["campaign"] == "Festive Email Push"


def test_daily_trend_has_one_row_a_day(funnel):
    assert T.trend(funnel, "date", "revenue").count() == 20
    forecast = T.linear_forecast(funnel, "date", "revenue").where("forecast IS NOT NULL")
    assert forecast.count() == 7


def test_transactions_by_region(transactions):
    assert pairs(G.group_agg(transactions, "region", "revenue")) == {
        "South": 400, "West": 350, "East": 100, "North": 40,
    }
    best = G.top_n_groups(transactions, "region", "revenue").collect()
    assert [(r["region"], r["value"]) for r in best] == [("South", 400)]
    assert G.top_contributor(transactions, "region", "revenue").head()["region"] == "South"
    story = G.explain_groups(G.group_agg(transactions, "region", "revenue"), "region").head()
    assert (story["top_label"], story["top_value"]) == ("South", 400)
    assert (story["lowest_label"], story["lowest_value"]) == ("North", 40)
    assert story["top_share_pct"] == pytest.approx(400 / 890 * 100)


def test_transactions_summary(transactions):
    row = K.executive_summary(transactions).head()
    assert row["records"] == 6 and row["total_revenue"] == 890
    assert row["total_net_revenue"] == 790 and row["total_profit"] == 196
    assert row["profit_margin_percent"] == pytest.approx(24.81, abs=0.005)
    assert row["return_rate_percent"] == pytest.approx(25.0)
    assert row["conversion_rate_percent"] is None
    # Marketing spend is no total cost.
    assert row["total_cost"] is None and row["roi_percent"] is None
    assert row["profit_to_marketing_spend_ratio"] == pytest.approx(196 / 64)
    leaders = {r["dimension"]: (r["leader"], r["total"]) for r in K.summary_leaders(transactions).collect()}
    assert leaders["region"] == ("South", 400) and "campaign" not in leaders


def test_average_is_used_when_asked_for(transactions):
    assert pairs(G.group_agg(transactions, "region", "revenue", "AVG"))["South"] == 200


def test_ties_go_to_the_first_group(transactions):
    assert G.group_most_records(transactions, "region").head()[:] == ("South", 2)
    assert G.group_fewest_records(transactions, "region").head()[:] == ("East", 1)


def test_ranges_and_correlations(transactions):
    assert A.numeric_range(transactions, "revenue").head()[:] == (6, 40.0, 300.0)
    assert C.corr_pairs(transactions).count() == 21


def test_share_of_spread(funnel):
    two = G.group_agg(funnel.where("team IN ('East', 'West')"), "team", "revenue")
    row = G.group_spread(two, "team").head()
    assert row["groups"] == 2 and row["highest_label"] == "West"
    assert row["spread"] == 221000 - 219500
    assert row["spread_pct_of_lowest"] == pytest.approx(1500 / 219500 * 100)
