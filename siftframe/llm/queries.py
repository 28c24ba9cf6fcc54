"""Registered queries of the operators for training data, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from . import (
    archives,
    decontamination,
    divergence,
    language,
    licenses,
    lm,
    near,
    neighbours,
    packing,
    periods,
    search,
    secrets,
    shards,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(spark, folder)`` under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    f"""
    WITH doc AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
    item AS (
      SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
    win AS (
      SELECT DISTINCT item_id, least(13, len(w)) AS k,
             array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
    pos AS (
      SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
      FROM doc, (SELECT DISTINCT k FROM win)),
    occ AS (
      SELECT p.r, p.i, p.k, v.item_id
      FROM pos p JOIN win v ON v.k = p.k AND v.s = array_to_string(p.w[p.i : p.i + p.k - 1], ' ')),
    hits AS (
      SELECT r, count(DISTINCT j) AS n
      FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM occ)) GROUP BY r),
    named AS (
      SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256,
           coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
    FROM doc d LEFT JOIN hits h ON h.r = d.r LEFT JOIN named n ON n.r = d.r
    """
)
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and items of every document, and whether it is contaminated."""
    found = decontamination.find_contamination(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


@query()
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secrets.LEAST),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_model(spark: SparkSession, folder: str):
    """Trained on the labelled documents that are not held out."""
    rows = table(spark, folder, "documents").where(~_held_out() & F.col("doc_id").isNotNull())
    return language.train(rows, key=F.col("doc_id"))


@query()
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = language.identify(docs, language_model(spark, folder))
    return found.select("doc_id", _held_out().alias("held_out"), "language.lang_pred", "language.score")


@query(
    f"""
    WITH RECURSIVE doc AS (
      SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w
      FROM documents WHERE doc_id IS NOT NULL),
    sh AS (
      SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
    size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
    common AS (
      SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
    link AS (
      SELECT x, y FROM common JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE c >= 0.8 * (p.n + q.n - c)),
    reach AS (
      SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
    low AS (
      SELECT x, min(d.doc_id) AS class_id FROM reach JOIN doc d ON d.r = y GROUP BY x),
    n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
    SELECT doc_id, least(doc_id, coalesce(low.class_id, doc_id)) AS class_id,
           CAST(coalesce(n.n, 0) AS BIGINT) AS n_links
    FROM doc LEFT JOIN low ON low.x = r LEFT JOIN n ON n.x = r
    UNION ALL SELECT doc_id, doc_id, 0 FROM documents WHERE doc_id IS NULL
    """
)
def op10_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document."""
    return near.near_copies(table(spark, folder, "documents"))


def public_tokenizer(name: str) -> str:
    """Where the installed public tokenizers have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence and offset of every token piece of every document."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizer("word_bpe_49k.json"))


@query(
    """
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
           CASE WHEN strlen(coalesce(html, '')) >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(coalesce(html, '')) >= 1000 AND k > 1 THEN top END AS refers_to
    FROM (SELECT page_id, html, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k,
                 max(page_id) OVER (PARTITION BY html) AS top FROM pages)
    """
)
def op1_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's WARC record, by way of an ARC archive."""
    root = scratch_path(spark, "archives")
    legacy = archives.write_arc(table(spark, folder, "pages"), f"{root}/arc")
    found = archives.read_warc(archives.convert(legacy, f"{root}/warc"))
    return found.select(
        F.col("id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def _licenses_sql() -> str:
    """Brute force over all blocks, templates and marks."""

    def text(value: str | None) -> str:
        return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"

    def around(apart: int, some: list[str], wanted: bool) -> str:
        inside = f"(i + {apart} >= 1 AND coalesce(list_contains({some}, w[i + {apart}]), false))"
        return inside if wanted else f"NOT {inside}"

    sets = [(label, sorted(set(words.split()))) for label, words in licenses.TEMPLATES + licenses.SIBLINGS]
    own = [(label, words, licenses._own_mark(label, words)) for label, words in sets]
    rows = ", ".join(
        f"('{label}', {words}, {text(mark)}, {text(licenses.UNLESS.get(mark))})" for label, words, mark in own
    )
    marks = " ".join(
        f"WHEN {' AND '.join([f"w[i] = '{word}'", *(around(*x) for x in conditions)])} THEN '{mark}'"
        for mark, word, conditions in licenses.MARKS
    )
    marked = sorted({word for _, word, _ in licenses.MARKS})
    phrases = " UNION ALL ".join(
        f"SELECT r, i - {len(before)} - 1 AS start, '{label}' AS label FROM word WHERE w[i] = '{last}' AND "
        + " AND ".join(f"w[i - {k}] = '{x}' AND i > {k}" for k, x in enumerate(reversed(before), 1))
        for label, before, last in licenses.PHRASES
    )
    return f"""
    WITH doc AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
    word AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
    place AS ({phrases}),
    base AS (
      SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word,
             list_sort(list_distinct(list(label))) AS labels FROM place GROUP BY r),
    template AS (SELECT * FROM (VALUES {rows}) AS t(label, words, own, unless)),
    block AS (
      SELECT r, s, list_distinct(w[s : s + {licenses.BLOCK - 1}]) AS b
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {licenses.STEP}, 1) + 1, {licenses.STEP})) AS s FROM doc)),
    mark AS (SELECT r, i, CASE {marks} END AS mark FROM word WHERE list_contains({marked}, w[i])),
    marks AS (
      SELECT b.r, b.s, list(DISTINCT mark) AS seen
      FROM block b JOIN mark m ON m.r = b.r AND m.i BETWEEN b.s AND b.s + {licenses.BLOCK - 1}
      WHERE mark IS NOT NULL GROUP BY b.r, b.s),
    share AS (
      SELECT r, s, label, own, unless, len(list_intersect(words, b)) / CAST(len(words) AS DOUBLE) AS share
      FROM block, template),
    found AS (
      SELECT c.r, list(DISTINCT label) AS labels, max(share) AS share
      FROM share c LEFT JOIN marks m ON m.r = c.r AND m.s = c.s
      WHERE share >= {licenses.THRESHOLD} - 1e-9
        AND (own IS NULL OR list_contains(coalesce(seen, []), own)
             OR (unless IS NOT NULL AND NOT list_contains(coalesce(seen, []), unless)))
      GROUP BY c.r)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_base,
           CAST(p.first_word AS BIGINT) AS first_word, CAST(p.last_word AS BIGINT) AS last_word,
           array_to_string(coalesce(p.labels, []), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(f.labels, [])))), ',')
             AS labels,
           greatest(coalesce(f.share, 0.0), CASE WHEN p.n > 0 THEN 1.0 ELSE 0.0 END) AS score
    FROM doc d LEFT JOIN base p ON p.r = d.r LEFT JOIN found f ON f.r = d.r
    """


@query(_licenses_sql())
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = licenses.find_licenses(table(spark, folder, "documents"), keep=["doc_id"])
    joined = {n: F.array_join(f"licenses.{n}", ",").alias(n) for n in ("base_labels", "labels")}
    plain = ("n_words", "n_base", "first_word", "last_word")
    return found.select("doc_id", *(f"licenses.{n}" for n in plain), *joined.values(), "licenses.score")


@query()
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    rows = table(spark, folder, "embeddings")
    return neighbours.nearest(rows, F.col("vec_id") % 20 == 0)


@query()
def op3_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vocabulary = lm.vocabulary_of(docs, "text")
    network = lm.train(docs, "text", vocabulary)
    return lm.score(docs, network, vocabulary).select("doc_id", "lm.*")


@query()
def op9_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """Place and contents of every token sequence, read back from the shards."""
    root, end = scratch_path(spark, "training-order"), 50256
    docs = table(spark, folder, "documents")
    manifest, layout = shards.write_shards(docs, root, public_tokenizer("byte_bpe_50k.json"), end)
    found = shards.read_shards(manifest, layout)
    return found.select(
        "doc_id",
        "piece",
        "slot",
        "shard",
        "offset",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_xxhash64"),
    )


@query(
    """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, e FROM (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    s AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT)
               AS score
      FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
    WHERE rank <= 5
"""
)
def op11_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 rows of largest inner product for every fiftieth vector."""
    rows = table(spark, folder, "embeddings")
    return search.top_k(rows, F.col("vec_id") % 50 == 0)


@query(
    r"""
    WITH doc AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    word AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
    kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    many AS (SELECT lang, source, term, count(*) AS c FROM word JOIN kept USING (lang, term) GROUP BY lang, source, term),
    grp AS (SELECT DISTINCT lang, source FROM doc),
    total AS (
      SELECT lang, source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN many USING (lang, source) GROUP BY lang, source),
    share AS (
      SELECT lang, source, term, coalesce(c, 0) AS c,
             CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5)) // (n + 5 * v) AS BIGINT) AS p
      FROM total JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN many USING (lang, source, term)),
    whole AS (
      SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)) AS BIGINT) AS q
      FROM share JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY lang) USING (lang) JOIN size USING (lang)
      GROUP BY lang, term),
    pair AS (
      SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT s.lang, s.source, o.source AS item, sum(abs(s.p - o.p)) AS value
                 FROM share s JOIN share o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source
                 GROUP BY s.lang, s.source, o.source) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    found AS (
      SELECT lang, source, 'pair' AS part, item, value FROM pair
      UNION ALL
      SELECT lang, source, 'term', term, p - q FROM share JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
    WHERE part = 'pair' OR rank <= 50
"""
)
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that mark them."""
    return divergence.audit(table(spark, folder, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents, of every tenth (by the checksum of its id) the words from some place on
    replaced by a repeated passage. Built-in functions only; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("w"), h.alias("h"))
    words = words.withColumn("n", F.size("w").cast("bigint")).withColumn("g", F.floor(F.col("h") / 10))
    words = words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    words = words.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    a, p, n = (F.col(c).cast("int") for c in ("a", "p", "n"))
    passage = F.slice("w", a + 1, p)
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    changed = F.slice(F.concat(F.slice("w", F.lit(1), a), F.flatten(F.array_repeat(passage, times))), F.lit(1), n)
    text = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(changed, " ")).otherwise(F.col("text"))
    return words.select("doc_id", text.alias("text"))


@query(
    r"""
    WITH doc AS (
      SELECT row_number() OVER () AS r, doc_id,
             coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w0,
             list_reduce(
               list_prepend(CAST(4294967295 AS BIGINT),
                            list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda x, c: list_reduce(
                 list_prepend(xor(x, c), CAST(range(8) AS BIGINT[])),
                 lambda y, i: xor(y >> 1, (y & 1) * CAST(3988292384 AS BIGINT)))) AS crc
      FROM documents),
    planted AS (
      SELECT r, doc_id, w0, len(w0) AS n, xor(crc, CAST(4294967295 AS BIGINT)) AS h,
             xor(crc, CAST(4294967295 AS BIGINT)) // 10 AS g FROM doc),
    place AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM planted),
    full_doc AS (
      SELECT r, doc_id, n,
             CASE WHEN h % 10 = 0 AND n > 0
                  THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1])
                  ELSE w0 END AS w
      FROM place),
    word AS (SELECT r, n, unnest(w) AS w, unnest(range(n)) AS i FROM full_doc),
    same AS (
      SELECT a.r, b.i - a.i AS q, a.i AS i FROM word a JOIN word b
        ON a.r = b.r AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
    stretch AS (
      SELECT r, q, min(i) AS s, count(*) + q AS l
      FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same)
      GROUP BY r, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
    run AS (SELECT r, s, l, min(q) AS q FROM stretch GROUP BY r, s, l),
    told AS (
      SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS line
      FROM run GROUP BY r),
    best AS (
      SELECT r, s, l, q FROM (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY l // q DESC, CAST(l % q AS DOUBLE) / q DESC, s, q) AS k FROM run)
      WHERE k = 1),
    gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
    short AS (
      SELECT r, string_agg(w, ' ' ORDER BY i) AS line FROM word ANTI JOIN gone USING (r, i)
      WHERE r IN (SELECT r FROM run) GROUP BY r)
    SELECT d.doc_id, CAST(coalesce(t.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start,
           CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli,
           sha256(coalesce(t.line, '')) AS runs_sha256,
           sha256(CASE WHEN t.r IS NULL THEN array_to_string(d.w, ' ') ELSE k.line END) AS collapsed_sha256
    FROM full_doc d LEFT JOIN told t ON t.r = d.r LEFT JOIN best b ON b.r = d.r LEFT JOIN short k ON k.r = d.r
    """
)
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, and the document without their repeats."""
    docs = with_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    found = periods.find_periodic_runs(docs)
    best = F.col("periodic.best")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("bigint").alias("n_runs"),
        *(best[name].cast("bigint").alias(name) for name in ("start", "length", "period")),
        F.floor(F.lit(1000).cast("bigint") * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("periodic.runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )
