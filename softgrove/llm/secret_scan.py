"""Secret scans with a trigram inverted index.

A rule is a regular expression. From its parsed form a Boolean trigram query
is derived: strings that the expression must contain give AND of their
trigrams, alternatives give OR. Each step of texts is indexed by the trigrams
that some rule asks for (postings: the rows that hold the trigram, over the
lower-cased text), postings are intersected and united as the query says,
and the rows left are verified with the expression itself. A rule without a
mandatory trigram (such as a run of hex digits) scans every text.

The index is built and used within a step of a few megabytes, so the scan is
a plain map over the documents.

Spans are in code points, end exclusive, leftmost and non-overlapping per
rule, in order of start and then of the rules. Edge cases: a NULL text is
empty and has no spans; repeated rows give repeated rows; an empty table
gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType
from re import _constants as rc
from re import _parser as rp

from softgrove.llm.common import LOWER_TABLE, add_fields, fresh, steps, text_bytes

Query = list[set[frozenset[bytes]]]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    #: This group (0: the match) needs so many characters, else the match is dropped.
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three base kinds, in the order in which spans are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published forms of other credentials.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: Strings that a part of an expression is expanded to at most.
_EXPAND = 64


def trigram_query(pattern: str) -> Query:
    """AND of ORs of ANDs of trigrams that every match's lower-cased text
    contains; empty if the expression has no mandatory trigram."""
    query: Query = []
    _close(_sequence(rp.parse(pattern, re.ASCII), {""}, query), query)
    return query


def _close(strings: set[str], query: Query) -> None:
    """Ends a stretch that is one of ``strings``: each gives its trigrams."""
    options = {frozenset(s[k:k + 3].lower().encode() for k in range(len(s) - 2)) for s in strings}
    if options and frozenset() not in options:
        query.append({o for o in options if not any(p < o for p in options)})


def _sequence(items, strings: set[str], query: Query) -> set[str]:
    """Extends the strings of the current stretch by ``items``; what can't be
    written out closes the stretch and begins a new one."""
    for op, arg in items:
        step: set[str] | None = None
        if op is rc.LITERAL:
            step = {chr(arg)}
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
            step = {chr(a) for _, a in arg}
        elif op is rc.SUBPATTERN:
            strings = _sequence(arg[3], strings, query)
            continue
        elif op is rc.BRANCH:
            parts: list[Query] = [[] for _ in arg[1]]
            ends = [_sequence(branch, {""}, p) for branch, p in zip(arg[1], parts)]
            step = set().union(*ends) if not any(parts) else None
        elif op is rc.MAX_REPEAT and arg[1] == 1:
            inner: Query = []
            end = _sequence(arg[2], {""}, inner)
            step = None if inner else end | {""}
        elif op is rc.MAX_REPEAT and arg[0]:
            _close(strings, query)
            _close(_sequence(arg[2], {""}, query), query)
            strings = {""}
            continue
        if step is not None and len(strings) * len(step) <= _EXPAND:
            strings = {a + b for a in strings for b in step}
        else:
            _close(strings, query)
            strings = {""}
    return strings


class Scanner:
    """Indexes and scans the texts of one step."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(k, r, r.compiled(), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        asked = sorted({t for _, _, _, q in self.rules for options in q for o in options for t in o})
        if len(asked) > 254:
            raise ValueError("more than 254 trigrams")
        self.number = {t: k for k, t in enumerate(asked)}
        self.table = np.full(1 << 24, 255, dtype=np.uint8)
        for t, k in self.number.items():
            self.table[int.from_bytes(t, "big")] = k

    def postings(self, col: pa.Array) -> list[np.ndarray]:
        """Rows that hold each trigram asked for, in order."""
        data, off = text_bytes(col)
        low = LOWER_TABLE[data].astype(np.uint32)
        which = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]] if len(low) > 2 else np.zeros(0, np.uint8)
        at = np.flatnonzero(which != 255)
        row = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[row + 1]
        row, number = row[inside], which[at[inside]]
        return [np.unique(row[number == k]) for k in range(len(self.number))]

    def candidates(self, query: Query, postings: list[np.ndarray], n: int) -> np.ndarray:
        rows = np.arange(n)
        for options in query:
            found = np.zeros(n, dtype=bool)
            for trigrams in options:
                part = None
                for t in sorted(trigrams, key=lambda t: len(postings[self.number[t]])):
                    own = postings[self.number[t]]
                    part = own if part is None else np.intersect1d(part, own, assume_unique=True)
                found[part] = True
            rows = rows[found[rows]]
        return rows

    def scan(self, col: pa.Array) -> list[list[tuple[int, int, str, int]]]:
        """(start, rule number, kind, end) of each row's spans, in order."""
        texts = col.to_pylist()
        postings = self.postings(col)
        out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        for k, rule, compiled, query in self.rules:
            for row in self.candidates(query, postings, len(texts)).tolist():
                if texts[row]:
                    out[row] += [(m.start(), k, rule.kind, m.end()) for m in compiled.finditer(texts[row])
                                 if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in out]


def scan(documents: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
         keep: list[str] | None = None, name: str = "secrets") -> DataFrame:
    """Columns ``keep`` (default: all) and ``name``: an array of
    struct(kind, start, end)."""
    keep = documents.columns if keep is None else keep
    need = list(dict.fromkeys([*keep, text_col]))
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the documents have a column named {name}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in steps(batch, text_col):
                spans = [[{"kind": w, "start": a, "end": b} for a, _, w, b in x] for x in scanner.scan(part.column(text_col))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(spans, kind)], names=[*keep, name])

    df = documents.select(*[F.col(f"`{c}`") for c in need])
    schema = documents.select(*[F.col(f"`{c}`") for c in keep]).schema
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    return df.mapInArrow(run, add_fields(schema, [(name, ArrayType(span))]))


def redact(documents: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
           length_col: str | None = "n_chars") -> DataFrame:
    """The documents (all columns) with each stretch of overlapping spans
    replaced by ``[kind]`` of its first span; ``length_col``, where there is
    one, follows the new text."""
    cols = documents.columns
    mark = fresh(cols, "_secrets")

    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in steps(batch, text_col):
                texts = part.column(text_col).to_pylist()
                hit = []
                for k, spans in enumerate(scanner.scan(part.column(text_col))):
                    hit.append(bool(spans))
                    if spans:
                        texts[k] = _redacted(texts[k], spans)
                arrays = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in cols]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(hit, pa.bool_())], names=[*cols, mark])

    out = documents.mapInArrow(run, add_fields(documents.schema, [(mark, BooleanType())]))
    if length_col in cols:
        kind = documents.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(mark), F.length(text_col).cast(kind)).otherwise(F.col(f"`{length_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in cols])


def _redacted(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    out, at = [], 0
    for start, _, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
