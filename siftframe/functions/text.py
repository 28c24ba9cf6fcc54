"""Text expressions over whole string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import any_of

# Debris that UTF-8 text leaves when it is read as Windows-1252,
# and its repair, applied in this order.
MOJIBAKE_REPAIRS = [
    ("â€”", "-"),
    ("â€–", "-"),
    ("â€¦", "..."),
    ("â€“", '"'),
    ("â€\u009d", '"'),
    ("â€™", "'"),
    ("â€˜", "'"),
    ("Â ", " "),
    ("Â", ""),
    ("ï¿½", ""),
    ("�", ""),
]
# Leftovers removed afterwards, as patterns, in this order.
MOJIBAKE_LEFTOVERS = [
    ("A\\s*â€¦\\s*â€[^\\p{L}\\p{N}]*", ""),
    ("[âÃ][‚€\u0080-\u009f][^\\p{L}\\p{N}\\s]*", ""),
    ("[âÃ][‚€\u0080-\u009f]", ""),
    ("â[^\\p{L}\\p{N}\\s]{1,8}", ""),
    ("â\u0080[^\\p{L}\\p{N}]*", ""),
    ("Ã[^\\p{L}\\p{N}]*", ""),
]
# Spacing put right at the end, as patterns, in this order.
SPACING_REPAIRS = [
    ("[ \\t]{2,}", " "),
    (" +([,.;:!?])", "$1"),
    ("\\n[ \\t]+", "\n"),
]


# All characters that count as white space.
SPACE_CHARS = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"\s\x1c-\x1f"  # with the flag (?U), the same characters in a Java pattern


def strip_space(col: Column) -> Column:
    """Drop white space of any kind at both ends (``trim`` drops blanks only)."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def normalize_text(col: Column) -> Column:
    """Lower case, underscores and hyphens as blanks, single blanks between words."""
    return F.regexp_replace(F.lower(strip_space(col)), rf"(?U)[{_SPACE}_\-]+", " ")


def _where(col: Column, marks: list[str], repair) -> Column:
    """``repair(text)`` for texts that hold one of ``marks``, the others as they are.

    The text is bound to a name first, so that it is worked out once.
    """

    def guarded(text: Column) -> Column:
        return F.when(any_of([F.contains(text, F.lit(m)) for m in marks]), repair(text)).otherwise(text)

    return F.get(F.transform(F.array(col), guarded), F.lit(0))


def _replaced(pairs: list[tuple[str, str]]):
    def apply(text: Column) -> Column:
        for debris, repair in pairs:
            text = F.replace(text, F.lit(debris), F.lit(repair))
        return text

    return apply


def _matched(pairs: list[tuple[str, str]]):
    def apply(text: Column) -> Column:
        for pattern, repair in pairs:
            text = F.regexp_replace(text, pattern, repair)
        return text

    return apply


def _repaired(text: Column) -> Column:
    """Literal repairs by their common beginning, then the leftovers, each only where it can match."""
    starts = ("â€", "Â", "ï¿½", "\ufffd")  # in the order of the repairs
    for start in starts:
        text = _where(text, [start], _replaced([p for p in MOJIBAKE_REPAIRS if p[0].startswith(start)]))
    first, *others = MOJIBAKE_LEFTOVERS
    text = _where(text, ["â€¦"], _matched([first]))
    return _where(text, ["â", "Ã"], _matched(others))


# What each of the spacing repairs needs to match.
_SPACING_MARKS = (["  ", "\t"], [f" {c}" for c in ",.;:!?"], ["\n ", "\n\t"])


def repair_mojibake(col: Column) -> Column:
    """Undo the usual debris of text read in the wrong encoding.

    Plain searches come before the patterns: a text without a suspicious
    character, or without the blanks that a pattern is about, skips it.
    """
    col = _where(col, ["Â", "Ã", "â", "ï", "\ufffd"], _repaired)
    for marks, repair in zip(_SPACING_MARKS, SPACING_REPAIRS, strict=True):
        col = _where(col, marks, _matched([repair]))
    return strip_space(col)


def shorten(col: Column, width: int) -> Column:
    """Text longer than ``width`` is cut to ``width`` - 1 characters plus "..."."""
    text = F.replace(col.cast("string"), F.lit("\n"), F.lit(" "))
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("..."))
    ).otherwise(text)
