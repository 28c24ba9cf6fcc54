"""Readers, clean-up, text repair and question logs."""

from __future__ import annotations


from pyspark.sql import functions as F

from ...functions.expressions import try_numeric
from ...functions.text import (
    MOJIBAKE_LEFTOVERS,
    MOJIBAKE_REPAIRS,
    SPACING_REPAIRS,
    normalize_text,
    repair_mojibake,
)
from ...operators import questions as Q
from ...sources import cleaning, files, sniffing, store
from ...sources.scratch import scratch_path
from .registry import Tables, query

# White space written out, as the second engine has no flag for all of it.
SPACE = (
    "[\\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a"
    "\u2028\u2029\u202f\u205f\u3000]"
)

# -- sources -----------------------------------------------------------------

_CUSTOMER = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
  c_mktsegment FROM customer"""


def _round_trip(t: Tables, sep: str, reader):
    path = scratch_path(t.spark, "customer")
    t.customer.write.option("header", True).option("sep", sep).csv(path)
    return reader(t.spark, path)


@query("read_csv", _CUSTOMER)
def _(t):
    return _round_trip(t, ",", files.read_csv)


@query("read_tsv", _CUSTOMER)
def _(t):
    return _round_trip(t, "\t", files.read_tsv)


_QUOTED = """SELECT e.event_id, d.doc_id, CAST(e.ts AS DATE) AS day, NULLIF(e.event_type, 'purchase') AS kind,
  'say "' || coalesce(d.text, 'nothing') || '",' || chr(10) || 'then ' || coalesce(e.event_type, 'stop') AS note
  FROM events e FULL JOIN documents d ON d.doc_id = e.event_id"""


@query("read_csv_quoted", _QUOTED)
def _(t):
    """Line breaks, quotes, separators, NULLs, dates and long texts in the fields."""
    text = F.coalesce("text", F.lit("nothing"))
    note = F.concat(F.lit('say "'), text, F.lit('",\n'), F.lit("then "), F.coalesce("event_type", F.lit("stop")))
    rows = t.events.join(t.documents, F.col("event_id") == F.col("doc_id"), "full").select(
        "event_id",
        "doc_id",
        F.col("ts").cast("date").alias("day"),
        F.nullif("event_type", F.lit("purchase")).alias("kind"),
        note.alias("note"),
    )
    path = scratch_path(t.spark, "quoted")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(t.spark, path, multi_line=True)


# Customers as text with damage: codes with leading zeros, a few balances that are no
# numbers, dates and timestamps in one column, a number too long for 64 bits.
_DAMAGED = """SELECT c_custkey AS id, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS code,
    CASE WHEN c_custkey % 40 = 0 THEN 'n/a' WHEN c_custkey % 9 <> 0 THEN CAST(CAST(c_custkey AS DOUBLE) / 4 AS VARCHAR) END AS balance,
    CASE WHEN c_custkey % 2 = 0 THEN '2024-02-29' ELSE '2024-03-01 10:20:30' END AS seen,
    CASE WHEN c_custkey % 90 = 1 THEN 'maybe' WHEN c_custkey % 3 = 0 THEN 'TRUE' ELSE 'false' END AS flag,
    concat('9', repeat('0', 20), c_custkey) AS long
  FROM customer"""


def _damaged(t: Tables, tolerance: float) -> sniffing.Loaded:
    key = F.col("c_custkey")
    balance = F.when(key % 40 == 0, F.lit("n/a")).when(key % 9 != 0, (key.cast("double") / 4).cast("string"))
    flag = F.when(key % 90 == 1, F.lit("maybe")).when(key % 3 == 0, F.lit("TRUE")).otherwise(F.lit("false"))
    rows = t.customer.select(
        key.alias("id"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("code"),
        balance.alias("balance"),
        F.when(key % 2 == 0, F.lit("2024-02-29")).otherwise(F.lit("2024-03-01 10:20:30")).alias("seen"),
        flag.alias("flag"),
        F.concat(F.lit("9" + "0" * 20), key.cast("string")).alias("long"),
    )
    path = scratch_path(t.spark, "damaged")
    rows.write.option("header", True).csv(path)
    return sniffing.load_delimited(t.spark, path, tolerance=tolerance)


@query(
    "read_csv_sniffed",
    f"""SELECT id, code, TRY_CAST(balance AS DOUBLE) AS balance, CAST(seen AS TIMESTAMP) AS seen,
          TRY_CAST(flag AS BOOLEAN) AS flag, long FROM ({_DAMAGED})""",
)
def _(t):
    """Types from all values: codes stay text, few bad cells become NULL."""
    return _damaged(t, 0.05).table


@query(
    "read_csv_rejects",
    f"""SELECT 'balance' AS column_name, balance AS value, 'not a double' AS reason, COUNT(*) AS cells
        FROM ({_DAMAGED}) WHERE balance = 'n/a' GROUP BY ALL
        UNION ALL SELECT 'flag', flag, 'not a boolean', COUNT(*) FROM ({_DAMAGED}) WHERE flag = 'maybe' GROUP BY ALL""",
)
def _(t):
    """The cells that did not fit the type of their column."""
    return _damaged(t, 0.05).rejects.groupBy("column_name", "value", "reason").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "sniff_types",
    f"""SELECT * FROM (VALUES ('id', 'bigint'), ('code', 'string'), ('balance', 'string'), ('seen', 'timestamp_ntz'),
          ('flag', 'string'), ('long', 'string')) AS k(column_name, type)
        JOIN (SELECT column_name, COUNT(value) AS values FROM (
          UNPIVOT (SELECT CAST(id AS VARCHAR) AS id, code, balance, seen, flag, long FROM ({_DAMAGED}))
          ON id, code, balance, seen, flag, long INTO NAME column_name VALUE value) GROUP BY 1) USING (column_name)""",
)
def _(t):
    """Without tolerance a single bad cell makes a column text."""
    raw = _damaged(t, 0.05).table.select(
        F.col("id").cast("string").alias("id"), "code",
        F.coalesce(F.col("balance").cast("string"), F.when(F.col("id") % 40 == 0, F.lit("n/a"))).alias("balance"),
        F.when(F.col("id") % 2 == 0, F.lit("2024-02-29")).otherwise(F.col("seen").cast("string")).alias("seen"),
        F.coalesce(F.col("flag").cast("string"), F.lit("maybe")).alias("flag"), "long",
    )
    return sniffing.sniff_types(raw).select("column_name", "type", "values")


@query(
    "clustered_filter",
    """SELECT COUNT(*) AS count, SUM(l_quantity) AS quantity FROM lineitem
       WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-31' OR l_shipdate IS NULL""",
)
def _(t):
    """Lines stored in order of their day; the filter reads few row groups."""
    kept = store.persist_dataset(t.lineitem, scratch_path(t.spark, "clustered"), "lines", "lines", ["l_shipdate"])
    day = F.col("l_shipdate")
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1995-03-01", "1995-03-31"))
    return kept.table.where(day.between(low, high) | day.isNull()).agg(
        F.count(F.lit(1)).alias("count"), F.sum("l_quantity").alias("quantity")
    )


@query("clean_names", "SELECT c_custkey AS a, c_name AS a_2, c_acctbal AS a_1, c_nationkey AS \"ID_1\", c_mktsegment AS \"id_1_1\" FROM customer")
def _(t):
    """Repeated names, in one case or two, beside names that look like their numbers."""
    df = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")
    return files.clean_names(df.toDF("a", " a ", "a_1", "ID_1", "id_1"))


@query("read_parquet", "SELECT * FROM orders")
def _(t):
    return files.read_parquet(t.spark, f"{t.folder}/orders.parquet")


@query("persist_dataset", "SELECT 'sales' AS filename, COUNT(*) AS row_count FROM orders")
def _(t):
    root = scratch_path(t.spark, "store")
    kept = store.persist_dataset(t.orders, root, "orders", "sales")
    return kept.metadata.select("filename", "row_count")


@query("open_dataset", "SELECT * FROM customer")
def _(t):
    root = scratch_path(t.spark, "store")
    store.persist_dataset(t.orders, root, "kept", "first")
    store.persist_dataset(t.customer, root, "kept", "second")
    return store.open_dataset(t.spark, root, "kept").table


# -- clean-up ----------------------------------------------------------------


@query(
    "promote_header",
    """SELECT CAST(o_orderkey AS VARCHAR) AS "S No", o_orderstatus AS status,
              o_orderpriority AS status_1 FROM orders WHERE o_orderkey > 4""",
)
def _(t):
    """Orders as a sheet: two title rows, the header in the row of order 4."""
    key = F.col("o_orderkey")
    title = F.when(key == 4, F.lit(" S  No ")).when(key < 4, F.lit("Orders"))
    sheet = t.orders.select(
        key.alias("at"),
        F.coalesce(title, key.cast("string")).alias("a"),
        F.when(key == 4, F.lit("status")).otherwise(F.col("o_orderstatus")).alias("b"),
        F.when(key == 4, F.lit("status")).otherwise(F.col("o_orderpriority")).alias("c"),
    )
    # The mark is "s no" with one blank; the sheet's double blank is a name to clean.
    sheet = sheet.withColumn("a", F.regexp_replace("a", "  ", " "))
    return cleaning.promote_header(sheet, "at")


_GAPPY = """(SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
    CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
    CASE WHEN event_type NOT IN ('error', 'click') THEN value END AS value,
    CAST(NULL AS VARCHAR) AS note FROM events) AS gappy"""


def _gappy(t: Tables):
    kind = F.col("event_type")
    return t.events.select(
        F.when(kind != "error", F.col("event_id")).alias("event_id"),
        F.when(kind != "error", kind).alias("event_type"),
        F.when(~kind.isin("error", "click"), F.col("value")).alias("value"),
        F.lit(None).cast("string").alias("note"),
    )


@query("drop_empty_rows", f"SELECT * FROM {_GAPPY} WHERE event_id IS NOT NULL")
def _(t):
    return cleaning.drop_empty_rows(_gappy(t))


@query("drop_empty_columns", f"SELECT event_id, event_type, value FROM {_GAPPY}")
def _(t):
    return cleaning.drop_empty_columns(_gappy(t))


@query(
    "drop_repeated_headers",
    "SELECT event_type AS purchase, event_id FROM events WHERE event_type <> 'purchase'",
)
def _(t):
    sheet = t.events.select(F.col("event_type").alias("purchase"), "event_id")
    padded = sheet.withColumn(
        "purchase",
        F.when(F.col("purchase") == "purchase", F.lit(" PURCHASE ")).otherwise(F.col("purchase")),
    )
    return cleaning.drop_repeated_headers(padded)


@query("trim_strings", "SELECT event_id, event_type, props FROM events")
def _(t):
    return cleaning.trim_strings(
        t.events.select(
            "event_id",
            F.concat(F.lit(" \t"), "event_type", F.lit("\n ")).alias("event_type"),
            F.concat("props", F.lit("  ")).alias("props"),
        )
    )


_TYPED = """SELECT event_id,
  CASE WHEN user_id % 10 = 3 THEN NULL ELSE CAST(value AS DOUBLE) END AS mostly,
  CASE WHEN user_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS partly,
  props FROM events"""


@query("coerce_mostly_numeric", _TYPED)
def _(t):
    user = F.col("user_id")
    return cleaning.coerce_mostly_numeric(
        t.events.select(
            "event_id",
            F.when(user % 10 == 3, F.lit("missing"))
            .otherwise(F.col("value").cast("string"))
            .alias("mostly"),
            F.when(user % 3 == 0, F.lit("n/a")).otherwise(user.cast("string")).alias("partly"),
            "props",
        )
    )


_SPELLINGS = [
    "1d", "1_000", " 2 ", "1e3", "n/a", "-.5", "7.", "", "1__0", "+3.25", "1,000", "0x1F",
]


@query(
    "try_numeric",
    "SELECT event_id, TRY_CAST(CASE user_id % 13 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SPELLINGS))
    + " ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events",
)
def _(t):
    spelled = F.element_at(
        F.array(*[F.lit(s) for s in _SPELLINGS], F.col("value").cast("string")),
        (F.col("user_id") % 13 + 1).cast("int"),
    )
    df = t.events.select("event_id", spelled.alias("text"))
    return df.select("event_id", try_numeric(df, "text").alias("number"))


# -- text --------------------------------------------------------------------


@query(
    "normalize_text",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(
          lower(concat('  ', replace(text, ' ', ' _-'), chr(10))), '^{SPACE}+|{SPACE}+$', '', 'g'),
          '[_\\-]+', ' ', 'g'), '{SPACE}+', ' ', 'g')) AS digest,
          source FROM documents""",
)
def _(t):
    text = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" _-")), F.lit("\n"))
    return t.documents.select("doc_id", F.md5(normalize_text(text)).alias("digest"), "source")


# Debris put into the documents in place of their punctuation.
_DAMAGE = [
    (". ", "â€” x â€¦ y â€™s Â "),
    (", ", "Ã¢â‚¬Â¦Ã¢â‚¬ z â€œq â€\u009d ï¿½Â "),
]


def _damaged_sql() -> str:
    sql = "text"
    for mark, debris in _DAMAGE:
        sql = f"replace({sql}, '{mark}', '{debris}')"
    return sql


def _repaired_sql() -> str:
    sql = _damaged_sql()
    for debris, repair in MOJIBAKE_REPAIRS:
        sql = "replace({}, '{}', '{}')".format(sql, debris, repair.replace("'", "''"))
    for pattern, repair in MOJIBAKE_LEFTOVERS + SPACING_REPAIRS:
        sql = "regexp_replace({}, '{}', '{}', 'g')".format(
            sql, pattern, repair.replace("$1", "\\1")
        )
    return f"regexp_replace({sql}, '^{SPACE}+|{SPACE}+$', '', 'g')"


@query(
    "repair_mojibake",
    f"SELECT doc_id, md5({_repaired_sql()}) AS digest, length({_repaired_sql()}) AS chars FROM documents",
)
def _(t):
    text = F.col("text")
    for mark, debris in _DAMAGE:
        text = F.replace(text, F.lit(mark), F.lit(debris))
    fixed = t.documents.select("doc_id", repair_mojibake(text).alias("fixed"))
    return fixed.select(
        "doc_id", F.md5("fixed").alias("digest"), F.length("fixed").cast("bigint").alias("chars")
    )


# -- question logs -----------------------------------------------------------

_VALID = f"""(SELECT conv_id, turn, role, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text
  FROM conversations WHERE role IN ('user', 'assistant')
    AND regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') <> '') AS v"""


@query("valid_turns", f"SELECT * FROM {_VALID}")
def _(t):
    return Q.valid_turns(t.conversations)


@query(
    "previous_answer",
    f"""SELECT conv_id, turn, text, previous_answer FROM (
          SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (
                   PARTITION BY conv_id ORDER BY turn
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_answer
          FROM {_VALID}) WHERE role = 'user'""",
)
def _(t):
    return Q.previous_answer(t.conversations)


@query(
    "recent_context",
    f"""SELECT conv_id, turn, COALESCE(string_agg(
          concat(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END, ': ', text), chr(10))
          OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
          'No previous conversation.') AS context FROM {_VALID}""",
)
def _(t):
    return Q.recent_context(t.conversations)


# The conversations hold invented words, so every turn is opened with a question.
_QUESTIONS = [
    "Please explain: tell me more",
    "What is the profit margin?",
    "Compare revenue and Units_Sold",
    "What if cost would drop by 10%?",
    "Forecast revenue for next month",
    "Any unusual orders?",
    "Show missing values and duplicate rows",
    "What is the main insight?",
    "Distribution of records by region",
    "Show the distribution of revenue",
    "Monthly trend of revenue over time",
    "Orders with revenue above 500",
    "What is the highest revenue?",
    "Which region has the highest revenue?",
    "Top 3 channels for revenue",
    "Average revenue by region",
    "Total revenue",
    "What percentage of records come from abroad",
    "The worst month",
    "Sales per team",
    "How many are there",
    "Hello",
    "laptops on a desktop",
    "Net revenue and then revenue against cost-of region, units sold",
    "revenue, not net revenue",
    "Give me insights",
    "Compare net revenue and region",
    "Compare net revenue and revenue",
]
_COLUMNS = ["region", "channel", "revenue", "cost", "units_sold", "net_revenue"]
_NUMERIC = ["revenue", "cost", "units_sold", "net_revenue"]
_GROUPS = ["region", "channel"]

_ASKED = (
    "(SELECT conv_id, turn, concat(list_extract(["
    + ", ".join(f"'{q}'" for q in _QUESTIONS)
    + f"], CAST((conv_id * 7 + turn) % {len(_QUESTIONS)} AS INTEGER) + 1), ' ', text) AS text"
    " FROM conversations) AS asked"
)


def _asked(t: Tables):
    pick = ((F.col("conv_id") * 7 + F.col("turn")) % len(_QUESTIONS) + 1).cast("int")
    question = F.element_at(F.array(*[F.lit(q) for q in _QUESTIONS]), pick)
    return t.conversations.select(
        "conv_id", "turn", F.concat_ws(" ", question, "text").alias("text")
    )


def _sql_has(text: str, phrases: list[str]) -> str:
    """Any phrase in lower-case text: words whole, longer phrases anywhere."""
    tests = []
    for p in phrases:
        if " " in p or "-" in p:
            tests.append(f"contains({text}, '{p}')")
        else:
            tests.append(
                f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')"
            )
    return "(" + " OR ".join(tests) + ")"


def _sql_holds(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _sql_count(tests: list[str]) -> str:
    return "(" + " + ".join(f"CAST({x} AS INTEGER)" for x in tests) + ")"


def _intent_sql() -> str:
    def has(phrases):
        return _sql_has("q", phrases)

    def holds(parts):
        return _sql_holds("q", parts)

    # "net revenue" holds "revenue", the only name here that is part of another; the first
    # place of a name decides.
    before = "regexp_extract(n, '(?s)^(.*?)\\brevenue\\b', 1)"
    bare = (
        _sql_has("n", ["revenue"])
        + f" AND NOT regexp_matches({before}, '(^|[^\\p{{L}}\\p{{N}}_])net $')"
    )
    whole = _sql_count([_sql_has("n", [c.replace("_", " ")]) if " " not in c.replace("_", " ")
                        else f"regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_]){c.replace('_', ' ')}($|[^\\p{{L}}\\p{{N}}_])')"
                        for c in _NUMERIC if c != "revenue"]
                       + [f"({bare})"])
    mentioned = _sql_count([f"contains(q, '{c.replace('_', ' ')}')" for c in _COLUMNS])
    group = _sql_has("n", _GROUPS)
    condition = (
        "(regexp_matches(q, '[<>=]') OR regexp_matches(q, '(^|[^\\p{L}\\p{N}_])("
        + "|".join(Q.CONDITION_WORDS)
        + ")($|[^\\p{L}\\p{N}_])'))"
    )
    top_n = "regexp_matches(q, '(^|[^\\p{L}\\p{N}_])(top|bottom)\\s+\\d+($|[^\\p{L}\\p{N}_])')"
    two = "(contains(q, 'compare') AND contains(q, ' between ') AND contains(q, ' and '))"
    ends = "ends_with(q, ' grouped')"
    hinted = holds(Q.GROUPING + Q.RANK_TARGETS)
    rules = [
        (has(Q.FOLLOWUP), "contextual_followup"),
        (has(Q.DERIVED), "derived_metrics"),
        (f"{has(Q.COMPARISON)} AND {whole} >= 2", "comparison"),
        (has(Q.SCENARIO), "scenario"),
        (has(Q.FORECAST), "forecast"),
        (has(Q.ANOMALY), "anomaly_detection"),
        (has(Q.QUALITY), "data_quality"),
        (has(Q.INSIGHT), "main_insight"),
        (f"{holds(Q.DISTRIBUTION)} AND {group}", "grouped_analysis"),
        (has(Q.STATISTICS), "statistics"),
        (has(Q.TREND), "trend"),
        (f"{mentioned} > 0 AND {condition}", "filtering"),
        (f"{has(Q.RANKING)} AND NOT {hinted} AND {mentioned} = 1", "numeric_analysis"),
        (f"{top_n} OR ({has(Q.RANKING)} AND {hinted})", "grouped_analysis"),
        (
            f"({holds(Q.GROUPING + [' each '])} OR {ends} OR {two}) AND {has(Q.GROUPED_AGGREGATION)}",
            "grouped_analysis",
        ),
        (f"{has(Q.AGGREGATION)} AND {mentioned} >= 1", "numeric_analysis"),
        (f"{has(Q.PERCENTAGE)} AND NOT {has(Q.RANKING_EXTREMES)}", "percentage_analysis"),
        (has(Q.LATE_INSIGHT), "main_insight"),
        (has(Q.RANKING_EXTREMES), "grouped_analysis"),
        (f"{holds(Q.GROUPING)} OR {ends} OR {two}", "grouped_analysis"),
        (has(Q.SCALAR), "numeric_analysis"),
    ]
    cases = " ".join(f"WHEN {test} THEN '{intent}'" for test, intent in rules)
    return f"""
  SELECT conv_id, turn, text, CASE {cases} ELSE 'local_query' END AS intent
  FROM (SELECT *, lower(text) AS q,
               regexp_replace(regexp_replace(lower(text), '[_\\-]+', ' ', 'g'), '{SPACE}+', ' ', 'g') AS n
        FROM {_ASKED})"""


@query("tag_intent", _intent_sql())
def _(t):
    return Q.tag_intent(_asked(t), "text", _COLUMNS, _NUMERIC, _GROUPS)


_NORMAL = (
    "regexp_replace(regexp_replace(lower(text), '[_\\-]+', ' ', 'g'), '" + SPACE + "+', ' ', 'g')"
)
_RUN = "trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))".format(_NORMAL)


@query(
    "tag_by_phrases",
    f"""WITH d AS (SELECT doc_id, concat(' ', {_RUN}, ' ') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_RUN}, '[^ ]+') AS w FROM benchmark),
        p AS (SELECT array_to_string(w[1 : 1 + item_id % 3], ' ') AS phrase, concat('item ', item_id) AS rule,
                     item_id % 7 AS priority FROM b),
        f AS (SELECT doc_id, phrase, rule, row_number() OVER (PARTITION BY doc_id ORDER BY priority,
                len(string_split(phrase, ' ')) DESC, phrase, rule) AS k
              FROM d JOIN p ON contains(w, concat(' ', phrase, ' ')))
        SELECT documents.doc_id, n_chars, rule, phrase FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id AND k = 1""",
)
def _(t):
    """The first words of the test items as rules, over whole documents."""
    first = F.slice(Q._words(F.col("text")), 1, (1 + F.col("item_id") % 3).cast("int"))
    rules = t.benchmark.select(
        F.array_join(first, " ").alias("phrase"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("rule"),
        (F.col("item_id") % 7).alias("priority"),
    )
    return Q.tag_by_phrases(t.documents, rules, ["doc_id"]).select("doc_id", "n_chars", "rule", "phrase")


_AGG_CASES = " ".join(
    f"WHEN regexp_matches({_NORMAL}, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') THEN '{a}'"
    for w, a in sorted(Q.AGGREGATE_WORDS.items(), key=lambda x: len(x[0]), reverse=True)
)


@query(
    "detect_aggregation",
    f"SELECT conv_id, turn, text, CASE {_AGG_CASES} END AS aggregate FROM {_ASKED}",
)
def _(t):
    return Q.detect_aggregation(_asked(t))


_PLACES = " UNION ALL ".join(
    f"""SELECT conv_id, turn, '{c}' AS name, {len(c)} AS size,
          length(regexp_extract(n, '(?s)^(.*?)\\b{c.replace("_", " ")}\\b', 1)) AS start FROM n
        WHERE regexp_matches(n, '\\b{c.replace("_", " ")}\\b')"""
    for c in _COLUMNS
)


@query(
    "mentioned_columns",
    f"""WITH n AS (SELECT *, {_NORMAL} AS n FROM {_ASKED}),
             p AS ({_PLACES}),
             kept AS (SELECT * FROM p WHERE NOT EXISTS (
               SELECT 1 FROM p AS o WHERE o.conv_id = p.conv_id AND o.turn = p.turn
                 AND o.name <> p.name AND o.start <= p.start AND o.start + o.size > p.start))
        SELECT n.conv_id, n.turn, n.text, COALESCE(
          (SELECT string_agg(name, ',' ORDER BY start) FROM kept
           WHERE kept.conv_id = n.conv_id AND kept.turn = n.turn), '') AS mentioned FROM n""",
)
def _(t):
    found = Q.mentioned_columns(_asked(t), _COLUMNS)
    return found.withColumn("mentioned", F.array_join("mentioned", ","))


