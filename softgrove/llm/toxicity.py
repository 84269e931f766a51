"""Toxicity: Levenshtein automata intersected with a lexicon trie.

Lexicon. From a bounded sample of labelled rows, the words and word
beginnings (stems) that occur almost only in toxic texts; of nested ones with
equal counts the longest. It is kept as a trie.

Matching. The trie is walked with a Levenshtein automaton (substitutions,
insertions, deletions, exchanged neighbours; 0 edits for terms of up to 3
characters, 1 up to 7, 2 beyond). The set of trie places with their edits is
one state; states are made when first met and remembered, so each further
word costs one look-up per character and most words end after a few. A
misspelling that the sample knows (words of clean texts that happen to be near a
term) counts with its own rate there; an unknown one with that of the
term's once-seen neighbours.

Context. Each hit is looked at in a window of ``CONTEXT`` characters: between
quotation marks, or beside a word of reporting, it is a quotation and its
weight is multiplied by the rate at which quoted hits were toxic in the
sample (``QUOTED`` where there are none).

A text's score is its strongest hit's, else the toxic rate of the sample's
texts without a hit. Scoring reads whole texts and is a plain map.

Edge cases: NULL and empty texts have no hit. Labels that are NULL aren't
learned from; of several labels of an id the highest counts. If nothing can be
learned, the score is 0. Repeated rows give repeated rows; an empty table
gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from softgrove.llm.common import add_fields, steps

#: Labelled rows that are learned from at most (about; chosen by hash).
SAMPLE_ROWS = 20_000
#: Least share of toxic texts (smoothed) among a term's texts.
PRECISION = 0.72
SMOOTHING = 2.0
STEM = (3, 12)
CONTEXT = 80
QUOTED = 0.25
THRESHOLD = 0.3
MEMORY = 1 << 18

# Quotation marks and words of reporting.
_OPEN, _CLOSE = "\"“«„”‟", "\"”»“"
_REPORTING = frozenset("""said says wrote writes called calls quoted quote quotes quoting word term insult slur
dit écrit appelé citation mot sagte schrieb nannte zitat wort dijo escribió llamó cita palabra""".split())

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 7 else 2


class Automaton:
    """Levenshtein automaton over the trie of the terms (text, is a stem)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.most: list[int] = [0]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]
        for number, (text, stem) in enumerate(terms):
            k = edits_allowed(text)
            at = 0
            self.most[0] = max(self.most[0], k)
            for c in text:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                    self.ends.append([])
                at = self.child[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends[at].append((number, stem, k))
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[frozenset, tuple[int, int] | None]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0, "")}, None)

    def _state(self, places: set[tuple[int, int, str]], best: tuple[int, int] | None) -> int:
        """Number of the state: trie places (node, edits, a character still
        to come of two exchanged ones) and the best stem met so far."""
        todo = [p for p in places if not p[2]]
        while todo:  # characters of the term that the text leaves out
            node, edits, _ = todo.pop()
            for m in self.child[node].values():
                p = (m, edits + 1, "")
                if edits < self.most[m] and p not in places:
                    places.add(p)
                    todo.append(p)
        least: dict[tuple[int, str], int] = {}
        for node, edits, need in places:
            if edits < least.get((node, need), 99):
                least[node, need] = edits
        for (node, need), edits in least.items():
            for term, stem, k in self.ends[node] if not need else ():
                if stem and edits <= k and (best is None or (edits, term) < best):
                    best = (edits, term)
        if best is not None and best[0] == 0:
            least = {}
        key = (frozenset((n, e, c) for (n, c), e in least.items()), best)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            final = best
            for node, edits, need in key[0]:
                for term, stem, k in self.ends[node] if not need else ():
                    if edits <= k and (final is None or (edits, term) < final):
                        final = (edits, term)
            self.final.append(final)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        places, best = self.states[state]
        out: set[tuple[int, int, str]] = set()
        for node, edits, need in places:
            if need:
                if c == need:
                    out.add((node, edits, ""))
                continue
            if c in self.child[node]:
                out.add((self.child[node][c], edits, ""))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
            for x, m in self.child[node].items():
                if edits < self.most[m]:
                    out.add((m, edits + 1, ""))
                    y = self.child[m].get(c)
                    if y is not None and c != x and edits < self.most[y]:
                        out.add((y, edits + 1, x))
        return self._state(out, best)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term."""
        if len(self.states) > MEMORY:
            self._reset()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            state = to
            if not self.states[state][0]:
                break
        return self.final[state]


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows a quotation."""
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    before, after = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
    marks = [c for c in before if c in _OPEN or c in _CLOSE]
    opened = bool(marks) and marks[-1] in _OPEN and not (marks[-1] == '"' and marks.count('"') % 2 == 0)
    if opened and any(c in _CLOSE for c in after):
        return True
    near = _WORD.findall(before.lower())[-3:] + _WORD.findall(after.lower())[:3]
    return any(w in _REPORTING for w in near)


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    #: Rate of the near words that the sample knows, and of others by (edits, term).
    neighbour: dict[str, float] = field(default_factory=dict)
    unknown: dict[tuple[int, int], float] = field(default_factory=dict)
    quoted: float = QUOTED
    base: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.terms)
        self.memo: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        hit = self.automaton.match(word)
        if hit is None:
            return 0.0
        if hit[0] == 0:
            return self.model.weight[hit[1]]
        own = self.model.neighbour.get(word)
        return self.model.unknown[hit] * self.model.weight[hit[1]] if own is None else own

    def hits(self, text: str | None) -> dict[str, float]:
        """Weight of each word of the text that is near a term."""
        words = words_of(text)
        memo = self.memo
        if len(memo) > MEMORY:
            memo.clear()
        for w in words.difference(memo):
            memo[w] = self._weight(w)
        return {w: memo[w] for w in words if memo[w] > self.model.base}

    def score(self, text: str | None) -> float:
        found = self.hits(text)
        best = self.model.base
        if found:
            low = text.lower()
            same = len(low) == len(text)
            for m in _WORD.finditer(low):
                w = found.get(m[0], 0.0)
                if w > best:
                    if is_quoted(text if same else low, m.start(), m.end()):
                        w *= self.model.quoted
                    best = max(best, w)
        return min(1.0, best)


# ---------------------------------------------------------------------------
# learning

def _features(words: set[str]) -> set[str]:
    """Words (ending in $) and their beginnings (ending in *)."""
    out = set()
    for w in words:
        out.add(w + "$")
        for k in range(STEM[0], min(len(w), STEM[1]) + 1):
            out.add(w[:k] + "*")
    return out


def _counted(rows: DataFrame, make) -> DataFrame:
    """Sums of (name, toxic texts, clean texts), pre-added in each task."""
    def run(batches):
        count = (Counter(), Counter())
        visit = make()
        for batch in batches:
            for part in steps(batch, "text"):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    count[0 if toxic else 1].update(visit(text))
        names = list(count[0].keys() | count[1].keys())
        for k in range(0, len(names), 50_000):
            some = names[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[n] for n in some], pa.int64()) for c in count)],
                                             names=["name", "toxic", "clean"])

    return rows.mapInArrow(run, "name string, toxic long, clean long").groupBy("name").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rate(toxic: float, clean: float, prior: float, smoothing: float = SMOOTHING) -> float:
    return (toxic + smoothing * prior) / (toxic + clean + smoothing)


def sample_of(documents: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about ``sample_rows`` labelled rows, by a hash of the
    id. The labels are sampled first, so they can be broadcast."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64(id_col, F.lit(0)), F.lit(1 << 30)) < int(share * (1 << 30)))
    docs = documents.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    return docs.join(F.broadcast(own), id_col).select("text", (F.col("toxic") > 0).alias("toxic"))


def learn(sample: DataFrame) -> Model:
    """The model of a bounded sample (text, toxic): all of its terms that reach
    ``PRECISION``, and all of its words that are near one."""
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n = sizes.get(True, 0), sum(sizes.values())
    if not n_toxic:
        return Model()
    base = n_toxic / n
    rate = (F.col("toxic") + SMOOTHING * base) / (F.col("toxic") + F.col("clean") + SMOOTHING)
    # by the likelihood that a term explains; of nested terms with equal counts the longest
    gain = F.col("toxic") * F.log(F.col("rate") / base) + F.col("clean") * F.log((1 - F.col("rate")) / (1 - base))
    found = (_counted(sample, lambda: lambda text: _features(words_of(text)))
             .where((F.col("toxic") > 1) & (rate >= PRECISION)).withColumn("rate", rate)
             .orderBy(F.desc(F.round(gain, 6)), F.desc(F.length("name")), "name").collect())
    terms: list[tuple[str, bool]] = []
    weight: list[float] = []
    taken: set[str] = set()
    above: set[str] = set()
    for r in found:
        text, stem = r["name"][:-1], r["name"][-1] == "*"
        if text in above or any(text[:k] in taken for k in range(1, len(text) + 1)):
            continue
        terms.append((text, stem))
        weight.append(r.rate)
        if stem:
            taken.add(text)
        above.update(text[:k] for k in range(1, len(text) + 1))

    def near():
        automaton = Automaton(terms)

        def visit(text):
            hits = {w: automaton.match(w) for w in words_of(text)}
            out = {f"{h[0]}:{h[1]}:{w}" for w, h in hits.items() if h is not None}
            exact = {w for w, h in hits.items() if h is not None and h[0] == 0}
            if exact:
                spans = [is_quoted(text, m.start(), m.end()) for m in _WORD.finditer(text.lower()) if m[0] in exact]
                return {"quoted"} if all(spans) else {"exact"}
            return out or {"none"}
        return visit

    counts = _counted(sample, near).collect()
    model = Model(terms, weight)
    once: dict[tuple[int, int], list[int]] = {}
    nothing = [0, 0]
    for r in counts:
        if r["name"] == "quoted":
            model.quoted = _rate(r.toxic, r.clean, QUOTED, 2 * SMOOTHING)
        elif r["name"] != "exact":
            nothing = [nothing[0] + r.toxic, nothing[1] + r.clean] if r["name"] == "none" else nothing
            if r["name"] != "none":
                edits, term, word = r["name"].split(":", 2)
                model.neighbour[word] = _rate(r.toxic, r.clean, base)
                if r.toxic + r.clean == 1:
                    c = once.setdefault((int(edits), int(term)), [0, 0])
                    c[0] += r.toxic
                    c[1] += r.clean
    for number, (_, stem) in enumerate(terms):
        for edits in (1, 2):
            # a stem takes any ending, so what is near it is a weaker sign
            model.unknown[edits, number] = _rate(*once.get((edits, number), (0, 0)), base if stem else 0.5)
    model.base = min(_rate(nothing[0], nothing[1], base), THRESHOLD / 2)
    return model


def score(documents: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
          name: str = "score") -> DataFrame:
    """Columns ``keep`` (default: all) and ``name``, the toxicity (0 to 1)."""
    keep = documents.columns if keep is None else keep
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the documents have a column named {name}")
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in steps(batch, text_col):
                found = [scorer.score(t) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.float64())], names=[*keep, name])

    df = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    return df.mapInArrow(run, add_fields(df.select(*[F.col(f"`{c}`") for c in keep]).schema, [(name, DoubleType())]))
