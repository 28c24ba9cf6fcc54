"""Batch operators over a log of questions and answers.

The log is a table (conversation, turn, role, text). Nothing here parses a
question in order to run it; questions are tagged, and turns get the context
that precedes them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import quoted
from ..functions.text import normalize_text, strip_space

# Turns of one conversation are handled in runs of this many turn numbers, so a
# conversation of any length is spread over tasks.
TURNS_PER_RUN = 65_536
CONTEXT_TURNS = 6  # fixed value


def valid_turns(log: DataFrame) -> DataFrame:
    """Turns of users and assistants that say something, with trimmed text."""
    return (
        log.where(F.col("role").isin("user", "assistant"))
        .withColumn("text", strip_space(F.col("text")))
        .where(F.col("text") != "")
    )


def _in_runs(log: DataFrame) -> DataFrame:
    return log.withColumn("_run", F.floor(F.col("turn") / TURNS_PER_RUN).cast("long"))


def previous_answer(log: DataFrame) -> DataFrame:
    """Every valid user turn with the latest assistant text before it, if any."""
    turns = _in_runs(valid_turns(log)).withColumn(
        "_answer", F.when(F.col("role") == "assistant", F.col("text"))
    )
    before = (
        Window.partitionBy("conv_id", "_run")
        .orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = turns.withColumn("_seen", F.last("_answer", ignorenulls=True).over(before)).where(
        F.col("role") == "user"
    )
    # Per run only its last answer is handed on to later runs.
    handed = (
        turns.groupBy("conv_id", "_run")
        .agg(F.max_by("_answer", F.when(F.col("_answer").isNotNull(), F.col("turn"))).alias("_a"))
        .withColumn(
            "_carried",
            F.last("_a", ignorenulls=True).over(
                Window.partitionBy("conv_id")
                .orderBy("_run")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("conv_id", "_run", "_carried")
    )
    return within.join(handed, ["conv_id", "_run"], "left").select(
        "conv_id", "turn", "text", F.coalesce("_seen", "_carried").alias("previous_answer")
    )


def recent_context(log: DataFrame, turns: int = CONTEXT_TURNS) -> DataFrame:
    """Every valid turn with the up to ``turns`` valid turns before it as text.

    One line per turn, "Role: text"; "No previous conversation." where nothing
    precedes.
    """
    lines = _in_runs(valid_turns(log)).withColumn(
        "_line", F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    )
    run = Window.partitionBy("conv_id", "_run")
    within = lines.withColumn(
        "_near", F.collect_list("_line").over(run.orderBy("turn").rowsBetween(-turns, -1))
    )
    # Per run only its last lines are handed on: at most ``turns`` of them.
    tails = (
        lines.withColumn("_back", F.row_number().over(run.orderBy(F.desc("turn"))))
        .where(F.col("_back") <= turns)
        .groupBy("conv_id", "_run")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "_line"))).alias("_tail"))
    )
    # Every run listed here has a line, so ``turns`` earlier runs are enough.
    handed = tails.select(
        "conv_id",
        "_run",
        F.flatten(
            F.collect_list(F.col("_tail._line")).over(
                Window.partitionBy("conv_id").orderBy("_run").rowsBetween(-turns, -1)
            )
        ).alias("_carried"),
    )
    near = F.concat(F.coalesce("_carried", F.array().cast("array<string>")), F.col("_near"))
    last = F.slice(near, F.greatest(F.size(near) - turns + 1, F.lit(1)), turns)
    return within.join(handed, ["conv_id", "_run"], "left").select(
        "conv_id",
        "turn",
        F.when(F.size(near) == 0, F.lit("No previous conversation."))
        .otherwise(F.concat_ws("\n", last))
        .alias("context"),
    )


# --------------------------------------------------------------------------
# intents
# --------------------------------------------------------------------------

# Phrases that decide what kind of analysis a question asks for.
FOLLOWUP = [
    "can you explain", "could you explain", "please explain", "explain that",
    "explain this", "explain it", "what does that mean", "what does this mean",
    "what does it mean", "tell me more", "how did you calculate that",
    "how was that calculated", "how did you get that",
]
DERIVED = [
    "profit", "roi", "return on investment", "conversion rate", "lead conversion",
    "cost per lead", "revenue per conversion", "profit margin",
]
COMPARISON = [
    "compare", "comparison", "versus", "vs", "difference between", "difference of",
    "which has", "which is higher", "which is lower", "higher", "lower", "ratio",
    "percentage higher", "percentage lower", "percentage difference",
    "percent higher", "percent lower", "percent difference", "how many times",
    "times as much", "times higher",
]
SCENARIO = [
    "what if", "suppose", "scenario", "impact if", "effect if", "increase by",
    "decrease by", "raise by", "reduce by", "grow by", "drop by",
]
FORECAST = [
    "forecast", "predict", "prediction", "future", "next week", "next month",
    "next quarter", "next year",
]
ANOMALY = [
    "anomaly", "anomalies", "outlier", "outliers", "unusual", "abnormal",
    "unexpected", "irregular",
]
QUALITY = [
    "data quality", "data-quality", "data profile", "data profiling",
    "quality summary", "missing values", "missing data", "null values",
    "null count", "duplicates", "duplicate rows", "unique values", "most unique",
    "distinct values", "most distinct", "highest distinct", "data completeness",
]
INSIGHT = [
    "main insight", "key insight", "key insights", "main finding", "key finding",
    "key findings", "important finding", "executive summary", "business summary",
    "overall summary", "dataset summary", "summarize the dataset",
    "summarize this dataset", "overall takeaway", "takeaway", "conclude",
]
LATE_INSIGHT = [
    "main insight", "key insight", "main takeaway", "key takeaway",
    "give me an insight", "give me insights", "what can you conclude",
]
DISTRIBUTION = ["distribution", "breakdown by"]
STATISTICS = [
    "correlation", "correlate", "median", "standard deviation", "std dev",
    "variance", "percentile", "quartile", "distribution", "statistics",
    "statistical",
]
TREND = [
    "trend", "over time", "time series", "historical trend", "growth over time",
    "monthly trend", "daily trend", "weekly trend", "yearly trend",
]
CONDITION_WORDS = [
    "greater than", "less than", "at least", "at most", "equal to", "above",
    "below", "over", "under",
]
RANKING = [
    "highest", "lowest", "best", "worst", "most", "least", "leading", "largest",
    "smallest", "ranked", "ranking", "rank",
]
GROUPING = [" by ", "wise", " for each ", " per ", " across ", " grouped "]
RANK_TARGETS = ["which ", "what department", "what category", "what group"]
AGGREGATION = [
    "average", "avg", "mean", "sum", "total", "maximum", "minimum", "highest",
    "lowest", "max", "min", "median",
]
GROUPED_AGGREGATION = [
    "average", "avg", "mean", "sum", "total", "count", "how many", "number of",
    "minimum", "maximum", "min", "max", "median",
]
PERCENTAGE = ["percentage", "percent", "proportion", "share of", "rate", "ratio", "return rate"]
RANKING_EXTREMES = [*RANKING, "maximum", "minimum"]
SCALAR = ["total", "sum", "average", "avg", "mean", "count", "how many", "maximum", "minimum"]

# Words that name an aggregate.
AGGREGATE_WORDS = {
    "average": "AVG",
    "avg": "AVG",
    "mean": "AVG",
    "sum": "SUM",
    "total": "SUM",
    "minimum": "MIN",
    "lowest": "MIN",
    "smallest": "MIN",
    "maximum": "MAX",
    "highest": "MAX",
    "largest": "MAX",
    "median": "MEDIAN",
    "count": "COUNT",
    "number": "COUNT",
    "how many": "COUNT",
}

_EDGE_BEFORE, _EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def _whole(text: Column, phrase: str) -> Column:
    """``phrase`` occurs in ``text`` with no letter or digit next to it.

    A plain search comes first, so the pattern is tried on few rows only.
    """
    pattern = _EDGE_BEFORE + re.escape(phrase).replace(r"\ ", " ") + _EDGE_AFTER
    return F.contains(text, F.lit(phrase)) & text.rlike(pattern)


def _is_word(phrase: str) -> bool:
    return " " not in phrase and "-" not in phrase


# How a phrase is looked for: as one whole word, anywhere in the text with a blank put
# before and behind it, anywhere in the text itself, between signs that are no letters
# or digits, or at the end of the text.
WORD, INSIDE, PART, WHOLE, ENDS = "word", "inside", "part", "whole", "ends"


def _by_shape(name: str, phrases: list[str]) -> list[tuple[str, str, str]]:
    """Single words whole, longer phrases as they are."""
    return [(name, p, WORD if _is_word(p) else INSIDE) for p in phrases]


def _default_phrases() -> list[tuple[str, str, str]]:
    """(clue, phrase, how): what in a text is a clue to an intent."""
    rows: list[tuple[str, str, str]] = []
    for name, phrases in (
        ("followup", FOLLOWUP), ("derived", DERIVED), ("comparison", COMPARISON), ("scenario", SCENARIO),
        ("forecast", FORECAST), ("anomaly", ANOMALY), ("quality", QUALITY), ("insight", INSIGHT),
        ("statistics", STATISTICS), ("trend", TREND), ("ranking", RANKING), ("aggregation", AGGREGATION),
        ("grouped aggregation", GROUPED_AGGREGATION), ("percentage", PERCENTAGE), ("late insight", LATE_INSIGHT),
        ("ranking or extreme", RANKING_EXTREMES), ("scalar", SCALAR),
    ):
        rows += _by_shape(name, phrases)
    rows += [("condition", w, WORD if _is_word(w) else WHOLE) for w in CONDITION_WORDS]
    rows += [("condition", sign, PART) for sign in (">", "<", "=")]
    rows += [("distribution", p, PART) for p in DISTRIBUTION]
    rows += [("hint", p, PART) for p in (*GROUPING, *RANK_TARGETS)]
    rows += [("grouped", p, PART) for p in (*GROUPING, " each ")] + [("grouped", " grouped", ENDS)]
    rows += [("grouping", p, PART) for p in GROUPING] + [("grouping", " grouped", ENDS)]
    rows += [("compare", "compare", PART), ("between", " between ", PART), ("and", " and ", PART)]
    return rows


def _default_rules() -> list[tuple[int, str, list[str], list[str]]]:
    """(priority, intent, clues that must be there, clues that must not)."""
    both = ["compare", "between", "and"]
    rules: list[tuple[str, list[tuple[list[str], list[str]]]]] = [
        ("contextual_followup", [(["followup"], [])]),
        ("derived_metrics", [(["derived"], [])]),
        ("comparison", [(["comparison", "two numeric"], [])]),
        ("scenario", [(["scenario"], [])]),
        ("forecast", [(["forecast"], [])]),
        ("anomaly_detection", [(["anomaly"], [])]),
        ("data_quality", [(["quality"], [])]),
        ("main_insight", [(["insight"], [])]),
        ("grouped_analysis", [(["distribution", "named group"], [])]),
        ("statistics", [(["statistics"], [])]),
        ("trend", [(["trend"], [])]),
        ("filtering", [(["mentioned", "condition"], [])]),
        ("numeric_analysis", [(["ranking", "one mentioned"], ["hint"])]),
        ("grouped_analysis", [(["top n"], []), (["ranking", "hint"], [])]),
        ("grouped_analysis", [(["grouped", "grouped aggregation"], []), ([*both, "grouped aggregation"], [])]),
        ("numeric_analysis", [(["aggregation", "mentioned"], [])]),
        ("percentage_analysis", [(["percentage"], ["ranking or extreme"])]),
        ("main_insight", [(["late insight"], [])]),
        ("grouped_analysis", [(["ranking or extreme"], [])]),
        ("grouped_analysis", [(["grouping"], []), (both, [])]),
        ("numeric_analysis", [(["scalar"], [])]),
    ]
    return [(i, intent, need, bar) for i, (intent, ways) in enumerate(rules) for need, bar in ways]


PHRASE_SCHEMA = "clue string, phrase string, how string"
RULE_SCHEMA = "priority int, intent string, needs array<string>, bars array<string>"


def intent_phrases(spark: SparkSession) -> DataFrame:
    """(clue, phrase, how): the phrases that :func:`tag_intent` looks for, as a table to change."""
    return _table(spark, _default_phrases(), PHRASE_SCHEMA)


def intent_rules(spark: SparkSession) -> DataFrame:
    """(priority, intent, needs, bars): its rules; the least priority that applies decides."""
    return _table(spark, _default_rules(), RULE_SCHEMA)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is a constant of the plan; no task runs Python for it."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = ", ".join(part.replace(" ", ":") for part in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def _as_array(table: DataFrame, schema: str, which: Column | None = None) -> Column:
    """A small table as one value, an array of its rows (of those with ``which``)."""
    names = [part.split()[0] for part in schema.split(", ")]
    missing = [n for n in names if n not in table.columns]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    table = table if which is None else table.where(which)
    return table.agg(F.array_sort(F.collect_list(F.struct(*names)))).scalar()


def _plain(name: str) -> str:
    return " ".join(re.sub(r"[_\-]+", " ", name.strip().lower()).split())


def _mentions(norm: Column, columns: list[str]) -> Column:
    """The columns named in a normalized text, in text order.

    The first place of each name counts. Where names overlap, the one that
    starts first is taken, or the longer one of two that start together.
    """
    places = []
    for c in columns:
        name = _plain(c)
        if name:
            whole = r"(?<![\p{L}\p{N}_])" + re.escape(name) + r"(?![\p{L}\p{N}_])"
            start = F.when(F.contains(norm, F.lit(name)), F.regexp_instr(norm, F.lit(whole)))
            start = start.otherwise(F.lit(0))
            places.append(
                F.struct(
                    start.alias("start"), F.lit(-len(name)).alias("size"), F.lit(c).alias("name")
                )
            )
    nothing = F.array().cast("array<string>")
    if not places:
        return nothing
    found = F.array_sort(F.filter(F.array(*places), lambda p: p["start"] > 0))
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("end"), nothing.alias("names")),
        lambda acc, p: F.when(p["start"] < acc["end"], acc).otherwise(
            F.struct(
                (p["start"] - p["size"]).alias("end"),
                F.concat(acc["names"], F.array(p["name"])).alias("names"),
            )
        ),
        lambda acc: acc["names"],
    )


def _clues(words_of: Column, phrases: Column, q: Column, words: Column) -> Column:
    """The clues of a text: by its words (``words_of``: word -> clues) and by ``phrases``."""

    def holds(p: Column, of: Column) -> Column:
        pattern = F.concat(F.lit(_EDGE_BEFORE + r"\Q"), p["phrase"], F.lit(r"\E" + _EDGE_AFTER))
        return (
            F.when(p["how"] == PART, F.contains(of["q"], p["phrase"]))
            .when(p["how"] == INSIDE, F.contains(of["padded"], p["phrase"]))
            .when(p["how"] == WHOLE, F.contains(of["q"], p["phrase"]) & F.regexp(of["q"], pattern))
            .when(p["how"] == ENDS, F.endswith(of["q"], p["phrase"]))
            .otherwise(F.lit(False))
        )

    def found(of: Column) -> Column:
        return F.transform(F.filter(phrases, lambda p: holds(p, of)), lambda p: p["clue"])

    # The forms of the text are the value of a lambda, so they are made once and not per phrase.
    padded = F.concat(F.lit(" "), q, F.lit(" "))
    forms = F.struct(q.alias("q"), padded.alias("padded"))
    by_phrase = F.get(F.transform(F.array(forms), found), F.lit(0))
    known = F.array_intersect(words, F.map_keys(words_of))
    by_word = F.flatten(F.transform(known, lambda w: F.element_at(words_of, w)))
    return F.concat(by_word, by_phrase)


def tag_intent(
    questions: DataFrame,
    text: str = "text",
    columns: list[str] | None = None,
    numeric: list[str] | None = None,
    groups: list[str] | None = None,
    phrases: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """``questions`` with ``intent``: the kind of analysis each question asks for.

    ``columns``, ``numeric`` and ``groups`` name the columns of the table the
    questions are about. The first rule that applies decides. Words count as
    whole words, with any sign next to them; so do "vs" and "versus".

    What is looked for is data: ``phrases`` (see :func:`intent_phrases`) give clues, to
    which "top n", "named group", "mentioned", "one mentioned" and "two numeric" are added
    from the names of columns, and ``rules`` (see :func:`intent_rules`) tell the intent
    that clues mean. Both are small tables that enter the scan as one value each, so the
    plan does not grow with them. A question that no rule fits is a "local_query".
    """
    columns, numeric, groups = columns or [], numeric or [], groups or []
    spark = questions.sparkSession
    phrases = intent_phrases(spark) if phrases is None else phrases
    said = _as_array(phrases, PHRASE_SCHEMA, F.col("how") != WORD)
    single = phrases.where(F.col("how") == WORD).groupBy("phrase").agg(F.collect_set("clue").alias("clues"))
    words_of = single.agg(F.map_from_entries(F.collect_list(F.struct("phrase", "clues")))).scalar()
    meant = _as_array(intent_rules(spark) if rules is None else rules, RULE_SCHEMA)
    # Worked out once per row: the text itself, its normal form, its words.
    prepared = questions.withColumns(
        {
            "_q": F.lower(strip_space(quoted(text))), "_norm": normalize_text(quoted(text)),
            "_said": said, "_meant": meant, "_words_of": words_of,
        }
    ).withColumn("_words", F.split("_q", _NOT_WORD))
    prepared = prepared.withColumn("_clues", _clues(*map(F.col, ("_words_of", "_said", "_q", "_words"))))
    q, norm = F.col("_q"), F.col("_norm")

    def count_of(tests: list[Column]) -> Column:
        total = F.lit(0)
        for test in tests:
            total = total + test.cast("int")
        return total

    # A name inside a longer one that is mentioned does not count.
    every = [*columns, *[c for c in numeric if c not in columns]]
    wanted = F.array(*[F.lit(c) for c in numeric]) if numeric else F.array().cast("array<string>")
    two_numeric = F.when(
        F.array_contains("_clues", "comparison"), F.size(F.array_intersect(_mentions(norm, every), wanted)) >= 2
    )
    named_group = count_of([_whole(norm, _plain(c)) for c in groups]) > 0
    # Columns are also recognised inside words here, as in "attendance percentages".
    mentioned = count_of(
        [F.contains(q, F.lit(c.strip().lower().replace("_", " "))) for c in columns]
    )
    top_n = q.rlike(_EDGE_BEFORE + r"(?:top|bottom)\s+\d+" + _EDGE_AFTER)
    more = F.array_compact(
        F.array(
            F.when(two_numeric, F.lit("two numeric")),
            F.when(named_group, F.lit("named group")),
            F.when(mentioned >= 1, F.lit("mentioned")),
            F.when(mentioned == 1, F.lit("one mentioned")),
            F.when(top_n, F.lit("top n")),
        )
    )
    prepared = prepared.withColumn("_clues", F.array_distinct(F.concat("_clues", more)))
    clues = F.col("_clues")
    # Rules are in order of priority, so the first one that applies decides.
    applies = F.filter(
        "_meant",
        lambda r: (F.size(F.array_except(r["needs"], clues)) == 0) & ~F.arrays_overlap(r["bars"], clues),
    )
    intent = F.get(F.transform(applies, lambda r: r["intent"]), F.lit(0))
    tagged = prepared.withColumn("intent", F.when(q.isNotNull(), intent))
    return tagged.withColumn("intent", F.coalesce("intent", F.lit("local_query"))).drop(
        "_q", "_norm", "_clues", "_said", "_meant", "_words", "_words_of"
    )


def tag_by_phrases(
    texts: DataFrame, rules: DataFrame, key: list[str], text: str = "text", broadcast_rules: int = 200_000
) -> DataFrame:
    """``texts`` with ``rule`` and ``phrase``: of the rules whose phrase a text has, the one
    with the least priority (ties: the longer phrase, then the phrase and rule in order).

    ``rules`` is a table (phrase, rule, priority) of any size. A phrase is a run of whole
    words in normal form (lower case, ``_`` and ``-`` are blanks). The runs of words of each
    text, as long as there are phrases, are joined to the table; what leaves that join is
    one best rule per task and text, then per text. The rules are broadcast up to
    ``broadcast_rules`` of them and shuffled beyond. ``key`` names columns that tell the
    texts apart. A job counts the rules first. Texts that no rule fits, and null texts,
    have NULL; rules without words never fit.
    """
    table = rules.select(
        _words(F.col("phrase")).alias("_words"), F.col("phrase").alias("phrase"), "rule", F.col("priority").cast("bigint").alias("priority")
    ).where(F.size("_words") > 0)
    table = table.select(F.array_join("_words", " ").alias("_run"), F.size("_words").alias("_n"), "phrase", "rule", "priority")
    sizes = [r["_n"] for r in table.select("_n").distinct().collect()]  # as many as phrases differ in length
    if not sizes:
        return texts.withColumns({"rule": F.lit(None).cast("string"), "phrase": F.lit(None).cast("string")})
    many = table.count() > broadcast_rules
    table = table if many else F.broadcast(table)
    words = texts.select(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(key)], _words(quoted(text)).alias("_w"))

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.array_join(F.slice("_w", i, n), " ")
        )

    runs = F.flatten(F.array(*[runs_of(n) for n in sorted(sizes)]))
    keys = [f"_k{i}" for i in range(len(key))]
    found = words.select(*keys, F.explode(F.array_distinct(runs)).alias("_run")).join(table, "_run")
    order = F.struct("priority", (-F.col("_n")).alias("size"), "phrase", "rule")
    best = found.groupBy(*keys).agg(F.min(order).alias("_best"))
    same = [quoted(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    out = texts.join(best, same, "left")
    return out.select(*[quoted(c) for c in texts.columns], F.col("_best.rule").alias("rule"), F.col("_best.phrase").alias("phrase"))


def _words(text: Column) -> Column:
    """The words of a text in normal form."""
    return F.filter(F.split(normalize_text(text), _NOT_WORD), lambda w: w != "")


def detect_aggregation(questions: DataFrame, text: str = "text") -> DataFrame:
    """``questions`` with ``aggregate``: the longest aggregate word decides."""
    prepared = questions.withColumn("_norm", normalize_text(quoted(text)))
    chain = F
    for phrase in sorted(AGGREGATE_WORDS, key=len, reverse=True):
        chain = chain.when(_whole(F.col("_norm"), phrase), F.lit(AGGREGATE_WORDS[phrase]))
    return prepared.withColumn("aggregate", chain.otherwise(F.lit(None).cast("string"))).drop(
        "_norm"
    )


def mentioned_columns(
    questions: DataFrame, columns: list[str], text: str = "text"
) -> DataFrame:
    """``questions`` with ``mentioned``: the columns named in each, in text order.

    Underscores, hyphens and case do not matter. The first place of each name
    counts. Where names overlap, the one that starts first is taken, or the
    longer one of two that start together.
    """
    prepared = questions.withColumn("_norm", normalize_text(quoted(text)))
    return prepared.withColumn("mentioned", _mentions(F.col("_norm"), columns)).drop("_norm")
