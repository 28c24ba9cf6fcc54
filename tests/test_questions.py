"""Question logs against plain Python on small and on long conversations."""

import random

import pytest
from pyspark.sql import functions as F

from siftframe.operators import questions as Q


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    for conv, size in ((1, 400), (2, 3), (3, 1), (4, 60)):  # one conversation is most of the log
        for turn in rng.sample(range(size * 3), size):
            text = rng.choice(["", "  ", f" says {turn} ", None, f"t{turn}\n"])
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", "system"]), text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.repartition(7), rows


def by_conversation(rows):
    valid = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        if role in ("user", "assistant") and text and text.strip():
            valid.setdefault(conv, []).append((turn, role, text.strip()))
    return valid


@pytest.mark.parametrize("run", [1, 7, 64, 65_536])
def test_context_crosses_runs(log, monkeypatch, run):
    monkeypatch.setattr(Q, "TURNS_PER_RUN", run)
    df, rows = log
    answers, contexts = {}, {}
    for conv, turns in by_conversation(rows).items():
        last = None
        for i, (turn, role, text) in enumerate(turns):
            before = turns[max(0, i - 6) : i]
            contexts[conv, turn] = (
                "\n".join(f"{r.title()}: {t}" for _, r, t in before) or "No previous conversation."
            )
            if role == "user":
                answers[conv, turn] = last
            else:
                last = text
    got = {(r["conv_id"], r["turn"]): r["previous_answer"] for r in Q.previous_answer(df).collect()}
    assert got == answers
    got = {(r["conv_id"], r["turn"]): r["context"] for r in Q.recent_context(df).collect()}
    assert got == contexts


def test_valid_turns(log):
    df, rows = log
    want = {(c, *t) for c, turns in by_conversation(rows).items() for t in turns}
    assert {tuple(r) for r in Q.valid_turns(df).collect()} == want


COLUMNS = ["department", "percentage", "attendance_percent", "total_marks", "mathematics", "programming"]
NUMERIC = COLUMNS[1:]


@pytest.mark.parametrize(
    "question, intent",
    [
        ("Can you explain that?", "contextual_followup"),
        ("What is the ROI?", "derived_metrics"),
        ("Compare Mathematics and Programming", "comparison"),
        ("What if we increase by 5%", "scenario"),
        ("Forecast the next week", "forecast"),
        ("Find outliers", "anomaly_detection"),
        ("Any duplicate rows?", "data_quality"),
        ("Give me the key insight", "main_insight"),
        ("Distribution of students by department", "grouped_analysis"),
        ("Show the standard deviation", "statistics"),
        ("Show marks over time", "trend"),
        ("Percentage greater than 80", "filtering"),
        ("What is the maximum Percentage?", "numeric_analysis"),
        ("top 3 Departments by average Percentage", "grouped_analysis"),
        ("average Percentage by Department", "grouped_analysis"),
        ("What is the highest total marks?", "numeric_analysis"),
        ("What share of students passed", "percentage_analysis"),
        ("What proportion passed", "percentage_analysis"),
        ("Who is best", "grouped_analysis"),
        ("students per class", "grouped_analysis"),
        ("how many students", "numeric_analysis"),
        ("laptop stopover", "local_query"),
        ("Give me insights", "main_insight"),
        ("give me an insight please", "main_insight"),
        ("What is the main takeaway", "main_insight"),
        ("Any key findings?", "main_insight"),
        ("Compare Percentage and Attendance-Percent", "comparison"),
        ("Compare attendance percent", "percentage_analysis"),
        ("difference between Mathematics, Programming", "comparison"),
        ("Mathematics vs. Programming", "comparison"),
        ("Compare Mathematics with department", "local_query"),
        ("data quality report", "data_quality"),
        ("Which rows have missing values", "data_quality"),
        ("Are there unusual marks?", "anomaly_detection"),
        ("predict total marks", "forecast"),
        ("Is there a correlation?", "statistics"),
        ("variance of programming", "statistics"),
        ("monthly trend", "trend"),
        ("programming below 40", "filtering"),
        ("total marks at least 300", "filtering"),
        ("mathematics > 90", "filtering"),
        ("mathematics overheads", "local_query"),
        ("lowest programming", "numeric_analysis"),
        ("sum of mathematics", "numeric_analysis"),
        ("Which department has the highest programming", "grouped_analysis"),
        ("bottom 5 departments", "grouped_analysis"),
        ("bottom5 departments", "local_query"),
        ("count for each department", "grouped_analysis"),
        ("how many students per department", "grouped_analysis"),
        ("median", "statistics"),
        ("department wise", "grouped_analysis"),
        ("breakdown by department", "grouped_analysis"),
        ("breakdown by students", "grouped_analysis"),
        ("the ratio of passes", "percentage_analysis"),
        ("rate of the best", "grouped_analysis"),
        ("count of students", "numeric_analysis"),
        ("students across years", "grouped_analysis"),
        ("", "local_query"),
    ],
)
def test_intents(spark, question, intent):
    df = spark.createDataFrame([(question,)], "text string")
    assert Q.tag_intent(df, "text", COLUMNS, NUMERIC, ["department"]).head()["intent"] == intent


@pytest.mark.parametrize(
    "question, intent",
    [
        ("Compare net revenue and region", "local_query"),
        ("Compare net revenue and revenue", "local_query"),
        ("Compare revenue and net_revenue", "comparison"),
        ("Compare net-revenue", "local_query"),
    ],
)
def test_a_name_inside_a_longer_one_is_no_second_column(spark, question, intent):
    df = spark.createDataFrame([(question,)], "text string")
    numeric = ["revenue", "net_revenue"]
    assert Q.tag_intent(df, "text", ["region", *numeric], numeric).head()["intent"] == intent


def test_aggregates_and_columns(spark):
    df = spark.createDataFrame(
        [("How many rows, in total?",), ("the AVERAGE_total",), ("subtotal",)], "text string"
    )
    assert [r["aggregate"] for r in Q.detect_aggregation(df).collect()] == ["COUNT", "AVG", None]
    df = spark.createDataFrame(
        [("Net-Revenue, then revenue and COST",), ("revenue and net revenue",), ("costs",)],
        "text string",
    )
    got = [r["mentioned"] for r in Q.mentioned_columns(df, ["revenue", "net_revenue", "cost"]).collect()]
    assert got == [["net_revenue", "cost"], ["revenue", "net_revenue"], []]


def test_rules_and_phrases_are_data(spark):
    df = spark.createDataFrame([("Which region sells best?",), ("please EXPLAIN that",), ("zebra count",), (None,)], "text string")

    def tags(**tables):
        return [r["intent"] for r in Q.tag_intent(df.coalesce(1), "text", ["region"], ["sales"], ["region"], **tables).collect()]

    plain = tags()
    assert plain == tags(phrases=Q.intent_phrases(spark), rules=Q.intent_rules(spark))
    more = Q.intent_phrases(spark).union(spark.createDataFrame([("zebra", "zebra", "word")], Q.PHRASE_SCHEMA))
    rules = Q.intent_rules(spark).union(spark.createDataFrame([(-1, "animals", ["zebra"], ["followup"])], Q.RULE_SCHEMA))
    assert tags(phrases=more, rules=rules) == [*plain[:2], "animals", "local_query"]
    with pytest.raises(ValueError, match="bars"):
        tags(rules=rules.drop("bars"))


def test_the_plan_does_not_grow_with_the_phrases(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("text"))
    many = spark.range(5000).selectExpr("'c' AS clue", "concat('phrase ', id) AS phrase", "'inside' AS how")
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert size(Q.tag_intent(df, phrases=many)) < 1.5 * size(Q.tag_intent(df, phrases=many.limit(1))) + 2000


def phrase_rows(spark):
    return spark.createDataFrame(
        [("Net  Revenue", "money", 5), ("revenue", "other", 5), ("late_delivery", "late", 1), ("--", "none", 0), ("net revenue", "again", 9)],
        "phrase string, rule string, priority int",
    )


@pytest.mark.parametrize("most", [0, 100])
def test_phrases_join_the_runs_of_words(spark, most):
    rows = [(1, "x", "the NET-revenue, and revenue"), (2, None, "revenues only"), (None, "y", "Late delivery of net revenue"), (3, "z", None), (4, "", "")]
    texts = spark.createDataFrame(rows + rows[:1], "id int, phrase2 string, text string")
    got = Q.tag_by_phrases(texts.dropDuplicates(), phrase_rows(spark), ["id", "phrase2"], broadcast_rules=most).collect()
    found = {r["id"]: (r["rule"], r["phrase"]) for r in got}
    nothing = (None, None)
    assert found == {1: ("money", "Net  Revenue"), 2: nothing, None: ("late", "late_delivery"), 3: nothing, 4: nothing}
    none = Q.tag_by_phrases(texts, phrase_rows(spark).where("phrase = '--'"), ["id"], broadcast_rules=most)
    assert {r["rule"] for r in none.collect()} == {None}
