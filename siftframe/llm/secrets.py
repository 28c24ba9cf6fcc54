"""Find secrets: fixed patterns, and literals assigned to sensitive names.

The second kind reads source and configuration syntax. Around every assignment
operator (``=``, ``:=``, ``=>``, ``:``) the target name before it and the
expression behind it are lexed: string literals, bare configuration values,
names and ``+`` between them. Values are kept per name in the order of the text,
so a literal is followed through constants and concatenations to the names that
receive it, and each name-literal pair is scored by the words of the name and
the looks of the literal.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import release

# The patterns that always count, with the least length of what must be long.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "literal")

# Words that make a name sensitive, and how much; pairs are neighbouring words.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "pwd": 1.0,
    "passphrase": 1.0,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.8,
    "auth": 0.8,
    "api key": 1.0,
    "access key": 1.0,
    "private key": 1.0,
    "signing key": 1.0,
    "encryption key": 1.0,
    "client key": 0.9,
}
PLACEHOLDER = re.compile(
    r"(?i)^(?:change.?me|example|sample|dummy|placeholder|your.*|x+|\*+|\.+|none|null|true|false|todo|redacted|"
    r"<.*>|\$\{.*\}|%.*%|\{\{.*\}\})$"
)
THRESHOLD = 0.75
_ENDS = 16  # characters kept from either end of a long value; more than the longest placeholder word
_BITS = 400  # of a count, which grows without bound when a constant is added to itself

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile(ACCESS), re.compile(HEX)
_LONG_HEX = re.compile(rf"{HEX[:-1]}{{{LEAST['hex']},}}")
_OPERATOR = re.compile(r"(?<![=!<>:+*/-])(?::=|=>|=(?![=>])|:(?![:/=]))")
# The target in front of an operator, read backwards from it, so that names may be of any length.
_TARGET = re.compile(
    r"[ \t]*\]?(?:[\"'`]?[\"']([\w.-]+)[\"']\[|[\"'`]?)([\w$]*[A-Za-z_$](?:[.-][\w$]*[A-Za-z_$])*)", re.ASCII
)
_TERM = re.compile(
    r"[ \t]*(?:(?:[rbuf]{0,2})(?P<quote>\"\"\"|'''|[\"'`])|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?![\w+/=-])"
    r"|(?P<bare>[A-Za-z0-9+/_.=@!#$%^&*~-]+))",
    re.ASCII,
)
_JOIN = re.compile(r"[ \t]*\+(?!=)[ \t]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = [
        (m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]
    ]
    if "AKIA" in text:
        spans += [
            (m.start(), m.end(), "access")
            for m in _ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST["access"]
        ]
    spans += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return spans


def name_score(name: str) -> float:
    """How sensitive a target name is, from its words."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, variety, not a placeholder."""
    return _looks(len(value), Counter(value), value)


def _looks(size: int, counts: Counter, seen: str) -> float:
    if size < 8 or PLACEHOLDER.match(seen) or " " in seen.strip():
        return 0.0
    shares = [n / size for n in counts.values()]
    entropy = -sum(p * math.log2(p) for p in shares if p)
    letters = "".join(counts)
    kinds = sum(bool(re.search(c, letters)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"))
    return min(1.0, 0.5 * min(1.0, entropy / 3.5) + 0.25 * min(1.0, (kinds - 1) / 1) + 0.25 * min(size, 12) / 12)


class Value:
    """Literals in a row, as spans of the text and as values of other names.

    Values share their parts, so a constant added to itself again and again stays
    as small as the text that says so. What a score needs of a value adds up over
    its parts and is found once.
    """

    __slots__ = ("parts", "_sums")

    def __init__(self) -> None:
        self.parts: list[tuple[int, int] | Value] = []
        self._sums: tuple[int, Counter, str, str, int] | None = None

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(sorted(self.spans(set())))

    def spans(self, passed: set[int]) -> set[tuple[int, int]]:
        """The different spans, without the values whose identity is in ``passed``, which grows by what is read."""
        found, open_values = set(), [self]
        while open_values:
            value = open_values.pop()
            if id(value) in passed:
                continue
            passed.add(id(value))
            for part in value.parts:
                if isinstance(part, Value):
                    open_values.append(part)
                else:
                    found.add(part)
        return found

    def sums(self, text: str) -> tuple[int, Counter, str, str, int]:
        """Length, characters with their counts, the first and the last characters, and by
        which power of two length and counts are to be multiplied."""
        waiting = [self]
        while waiting:
            value = waiting[-1]
            missing = [p for p in value.parts if isinstance(p, Value) and p._sums is None]
            if value._sums is None and missing:
                waiting += missing
                continue
            waiting.pop()
            if value._sums is None:
                value._sums = value._added(text)
        return self._sums

    def _added(self, text: str) -> tuple[int, Counter, str, str, int]:
        size, counts, head, tail = 0, Counter(), "", ""
        power = max((p._sums[4] for p in self.parts if isinstance(p, Value)), default=0)
        for part in self.parts:
            if isinstance(part, Value):
                more, chars, first, last, own = part._sums
            else:
                literal = text[part[0] : part[1]]
                more, chars, first, last, own = len(literal), Counter(literal), literal[: 2 * _ENDS], literal[-2 * _ENDS :], 0
            size += more >> (power - own)
            for char, n in chars.items():
                counts[char] += max(1, n >> (power - own))
            head = (head + first)[: 2 * _ENDS] if len(head) < 2 * _ENDS else head
            tail = (tail + last)[-2 * _ENDS :]
        if (over := size.bit_length() - _BITS) > 0:
            over += _BITS // 2
            size, power = size >> over, power + over
            counts = Counter({char: max(1, n >> over) for char, n in counts.items()})
        return size, counts, head, tail, power

    def looks(self, text: str) -> float:
        """``literal_score`` of the whole value; of a long one's middle, only which characters there are is looked at."""
        size, counts, head, tail, power = self.sums(text)
        if size <= 2 * _ENDS:
            return _looks(size, counts, head)
        head, tail = head[:_ENDS], tail[-_ENDS:]
        ends = Counter(head + tail)
        middle = sorted(char for char, n in counts.items() if power or n > ends[char])
        return _looks(size, counts, head + "".join(middle) + tail)

    def has_digit(self, text: str) -> bool:
        return any(char in self.sums(text)[1] for char in "0123456789")


class _Quotes:
    """Ends of strings in a text. Where a line ends, and from where on a quote is missing, is looked up once."""

    def __init__(self, text: str):
        self.text, self.line, self.missing = text, (0, -1), {}

    def _find(self, quote: str, at: int) -> int:
        if at >= self.missing.get(quote, len(self.text) + 1):
            return -1
        end = self.text.find(quote, at)
        if end < 0:
            self.missing[quote] = at
        return end

    def _line_end(self, at: int) -> int:
        if not self.line[0] <= at <= self.line[1]:
            end = self.text.find("\n", at)
            self.line = (at, end if end >= 0 else len(self.text))
        return self.line[1]

    def end(self, at: int, quote: str) -> int:
        """Where the string whose contents begin at ``at`` ends; -1 if it does not."""
        begin = at
        while True:
            end = self._find(quote, at)
            if end < 0 or (len(quote) == 1 and end > self._line_end(begin)):
                return -1
            slashes = 0
            while end - slashes > at and self.text[end - slashes - 1] == "\\":
                slashes += 1
            if slashes % 2 == 0:
                return end
            at = end + 1


def _expression(text: str, at: int, constants: dict[str, Value], quotes: _Quotes) -> tuple[Value, bool, int]:
    """Literals of the expression at ``at``, whether all are quoted or known names, and its end."""
    value, sure = Value(), True
    while True:
        term = _TERM.match(text, at)
        if not term:
            return value, sure, at
        at = term.end()
        if term["quote"]:
            end = quotes.end(at, term["quote"])
            if end < 0:
                return value, sure, at
            value.parts.append((at, end))
            at = end + len(term["quote"])
        elif term["name"] and (known := constants.get(term["name"].rpartition(".")[2])) is not None:
            value.parts.append(known)
        else:
            start = term.start("name") if term["name"] else term.start("bare")
            value.parts.append((start, at))
            sure = False
        join = _JOIN.match(text, at)
        if not join:
            return value, sure, at
        at = join.end()


def named_literals(text: str) -> list[tuple[str, Value, float]]:
    """(target name, its literals, score) of every assignment to a sensitive name, in order."""
    out, constants, past = [], {}, 0
    quotes, backwards = _Quotes(text), text[::-1]
    for operator in _OPERATOR.finditer(text):
        if operator.start() < past:
            continue  # inside a literal that was read already
        target = _TARGET.match(backwards, len(text) - operator.start())
        if not target:
            continue
        name = (target[1] or target[2])[::-1]
        value, sure, end = _expression(text, operator.end(), constants, quotes)
        if not value.parts:
            continue
        past = end if sure else past
        if sure:
            constants[name.rpartition(".")[2]] = value
        else:
            constants.pop(name.rpartition(".")[2], None)
        sensitive = name_score(name)
        if sensitive:
            # A bare word is no secret.
            looks = value.looks(text) if sure or value.has_digit(text) else 0.0
            out.append((name, value, sensitive * looks))
    return out


def secret_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind in the order of ``KINDS``."""
    spans = set(base_spans(text))
    if ":" in text or "=" in text:
        passed: set[int] = set()  # a value's literals are added once
        named = named_literals(text)  # keeps the values, so that their identities are theirs
        for _, value, score in named:
            if score >= threshold:
                spans.update((a, b, "literal") for a, b in value.spans(passed) if b > a)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(
    docs: DataFrame, text_col: str = "text", into: str = "secrets", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with a column ``into``: an array of {kind, start, end}.

    Offsets are code points, ends exclusive, ordered by start and then kind. A
    null text counts as empty, without spans. Spans of different kinds may
    overlap. The whole text is read, however long. Other columns are kept; one
    named ``into`` is replaced.
    """

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for texts in batches:
            rows = [
                [{"kind": k, "start": a, "end": b} for a, b, k in secret_spans(t or "", threshold)]
                for t in texts.to_pylist()
            ]
            yield pa.array(rows, pa.list_(kind))
        release()

    return docs.withColumn(into, scan.asNondeterministic()(F.col(text_col)))


def redact(docs: DataFrame, spans_col: str = "secrets", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every span (overlapping ones together) in the text by ``mask``."""

    @F.arrow_udf("string")
    def replace(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text is None or not found:
                out.append(text)
                continue
            parts, at = [], 0
            for span in found:  # by start
                if span["start"] >= at:
                    parts += [text[at : span["start"]], mask]
                at = max(at, span["end"])
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    hit = F.size(spans_col) > 0
    return docs.withColumn(
        text_col, F.when(hit, replace.asNondeterministic()(F.col(text_col), F.col(spans_col))).otherwise(F.col(text_col))
    )
