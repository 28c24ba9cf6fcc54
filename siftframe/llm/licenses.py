"""License notices in texts: phrases, and an exact set-similarity join with templates.

A *block* is a stretch of 48 words, one beginning every 24 words; a template is
the set of words of a notice. A block matches a template if it holds at least
the threshold share of its words. Words are ordered by how often they occur in
the whole corpus, rarest first. With ``a`` words needed of ``t``:

* *prefix*: one of the template's first ``t - a + 1`` words is in the block, so
  only blocks with such a word are looked at, joined by it with the templates;
* *length*: the block has at least ``a`` different words of any template;
* *position*: from the first common word on, both have enough words left.

What passes is compared exactly. A short set of words does not tell a notice from
its siblings, so a match also needs the template's own *mark* in the block: a word
of its name, with what stands before and behind it. Only built-in functions are
used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import words_column

THRESHOLD = 0.8
BLOCK, STEP = 48, 24

# Notices by label. A template may have at most BLOCK - STEP + 1 words.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
# Siblings of a template above that differ from it by a word or two.
SIBLINGS: list[tuple[str, str]] = [
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
]
_KINDS = ["nc", "sa", "nd"]
_OTHER_GPL = ["lesser", "library", "affero"]
#: (mark, word, conditions on the words at a distance from it: one of, or none of if false)
MARKS: list[tuple[str, str, list[tuple[int, list[str], bool]]]] = [
    ("mit", "mit", [(-1, ["the", "under"], True)]),  # a common word of German
    ("mit", "mit", [(1, ["license"], True)]),
    ("apache", "apache", []),
    ("lgpl", "lesser", []),
    ("mpl", "mozilla", []),
    ("other gpl", "public", [(-2, _OTHER_GPL, True)]),
    ("other gpl", "public", [(-1, _OTHER_GPL, True)]),
    ("gpl", "public", []),
    ("cc-by", "by", [(-1, ["cc", "commons"], True), (1, _KINDS, False)]),
    ("cc-by-sa", "by", [(1, ["sa"], True)]),
    ("cc-by-nd", "by", [(1, ["nd"], True)]),
    ("cc-by-nc-sa", "by", [(1, ["nc"], True), (2, ["sa"], True)]),
    ("cc-by-nc-nd", "by", [(1, ["nc"], True), (2, ["nd"], True)]),
    ("cc-by-nc", "by", [(1, ["nc"], True)]),
]
#: A template with its label's mark only in other words matches unless this is there and the mark is not.
UNLESS = {"gpl": "other gpl"}
#: (label, words before, last word): where these stand in a row is a place of the label.
PHRASES = [
    ("mit", ["mit"], "license"),
    ("apache", ["apache"], "license"),
    ("gpl", ["general", "public"], "license"),
]


def _places(words: Column) -> Column:
    """Array of {start, label} of the phrases."""

    def place(w: Column, i: Column) -> Column:
        out = F.lit(None)
        for label, before, last in PHRASES:
            here = w == last
            for k, word in enumerate(reversed(before), 1):
                here = here & (F.get(words, i - k) == word)
            start = (i - len(before)).cast("bigint")
            out = F.when(here, F.struct(start.alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(words, place), lambda p: p.isNotNull())


def _mark(words: Column, i: Column) -> Column:
    """The first of ``MARKS`` that stands at place ``i`` (from 0), or null."""
    out = F.lit(None).cast("string")
    for mark, word, around in reversed(MARKS):
        here = F.get(words, i) == word
        for apart, some, wanted in around:
            inside = F.coalesce(F.get(words, i + apart).isin(some), F.lit(False))
            here = here & (inside if wanted else ~inside)
        out = F.when(here, mark).otherwise(out)
    return F.when(F.get(words, i).isin(sorted({m[1] for m in MARKS})), out)


def _own_mark(label: str, words: list[str]) -> str | None:
    """The mark that a match with a template needs: its label's, if the template has such a word."""
    return label if any(m == label and w in words for m, w, _ in MARKS) else None


def word_counts(docs: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """How often each of ``words`` occurs in all texts."""
    rows = docs.select(F.explode(words_column(F.col(text_col))).alias("word")).where(F.col("word").isin(words))
    return dict.fromkeys(words, 0) | {r["word"]: r["count"] for r in rows.groupBy("word").count().collect()}


def find_licenses(
    docs: DataFrame,
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
    into: str = "licenses",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with a column ``into``: {n_words, n_base, first_word, last_word, base_labels, labels, score}.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word``
    are their least and largest first word (from 0; null without places).
    ``base_labels`` are the labels of phrases, ``labels`` those and the labels of
    matched templates, both sorted. ``score`` is the largest share of a
    template's words found in a block of those that match, 1 for a phrase, 0
    without either. Null texts are empty; texts without words match nothing.
    Repeated rows stay separate. The columns named in ``keep`` (default: all) are
    kept, whatever their names; one named ``into`` is replaced. What is kept goes
    through the one shuffle that brings a text's blocks together again.
    """
    templates = TEMPLATES + SIBLINGS if templates is None else templates
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    if too_long := [label for label, text in templates if len(text.split()) > BLOCK - STEP + 1]:
        raise ValueError(f"templates over {BLOCK - STEP + 1} words: {too_long}")
    vocabulary = sorted({w for _, words in sets for w in words})
    counts = word_counts(docs, text_col, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words in sets:
        words = sorted(words, key=rank.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        prefix = words[: len(words) - need + 1]
        mark = _own_mark(label, words)
        unless = UNLESS.get(mark)
        rows += [(w, k, label, need, [rank[x] for x in words], mark, unless) for k, w in enumerate(prefix)]
    index = docs.sparkSession.createDataFrame(
        rows, "token string, at int, label string, need int, template array<int>, mark string, unless string"
    )
    prefixes = F.array(*(F.lit(w) for w in sorted({r[0] for r in rows})))
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))

    others = [c for c in (docs.columns if keep is None else keep) if c != into]
    words = F.coalesce(words_column(F.col(text_col)), F.array().cast("array<string>"))
    kept = docs.select(F.struct(*others).alias("kept"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    places = F.when(F.array_contains("words", "license"), _places(F.col("words"))).otherwise(none)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - STEP, F.lit(1)), F.lit(STEP))
    near = F.filter(starts, lambda s: F.arrays_overlap(F.slice("words", s, BLOCK), prefixes))

    def marks(s: Column) -> Column:
        places = F.sequence(s - 1, F.least(s + BLOCK - 1, F.size("words")) - 1)
        return F.array_distinct(F.filter(F.transform(places, lambda i: _mark(F.col("words"), i)), lambda m: m.isNotNull()))

    blocks = F.transform(
        near, lambda s: F.struct(F.array_distinct(F.slice("words", s, BLOCK)).alias("words"), marks(s).alias("marks"))
    )
    scanned = kept.select(
        "kept",
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        places.alias("places"),
        F.when(F.arrays_overlap("words", prefixes), blocks).alias("blocks"),
    )
    # A block as the sorted ranks of its words that any template has, exploded by prefix word.
    block = scanned.withColumn("found", F.explode_outer("blocks")).drop("blocks")
    block = block.withColumns({"block": F.col("found.words"), "marks": F.col("found.marks")}).drop("found")
    block = block.withColumn("token", F.explode_outer(F.array_intersect("block", prefixes)))
    own = F.array_sort(F.filter(F.transform("block", lambda w: ranks[w]), lambda x: x.isNotNull()))
    block = block.withColumn("block", F.when(F.col("token").isNotNull(), own))
    common = F.array_intersect("template", "block")
    joined = block.join(F.broadcast(index), "token", "left")  # one row per prefix word of a fixed list
    here = F.array_position("block", ranks[F.col("token")]).cast("int") - 1
    left = F.least(F.size("template") - F.col("at"), F.size("block") - here)
    passes = (F.size("block") >= F.col("need")) & (left >= F.col("need"))
    first = F.get(common, F.lit(0)) == ranks[F.col("token")]  # a pair counts at its first common word
    own_mark = F.col("mark").isNull() | F.array_contains("marks", F.col("mark"))
    own_mark = own_mark | (F.col("unless").isNotNull() & ~F.array_contains("marks", F.col("unless")))
    enough = passes & first & (F.size(common) >= F.col("need"))
    share = F.when(enough & own_mark, F.size(common) / F.size("template"))
    matched = joined.select("row", "kept", "n_words", "places", "label", share.alias("share"))
    grouped = matched.groupBy("row").agg(
        F.first("kept").alias("kept"),
        F.first("n_words").alias("n_words"),
        F.first("places").alias("places"),
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("found"),
        F.max("share").alias("share"),
    )
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    phrase = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    result = F.struct(
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.col("found"))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), phrase).alias("score"),
    )
    return grouped.select("kept", result.alias("__result__")).select("kept.*", F.col("__result__").alias(into))
