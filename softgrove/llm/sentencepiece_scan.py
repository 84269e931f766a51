"""SentencePiece encoding and decoding by a max-plus parallel scan.

The result is that of the model's own BPE. BPE's segmentation is the one path
through the lattice of pieces on which every two neighbours are *compatible*:
encoding the two pieces' joined text gives back just these two. So edges get
the weight 0 (compatible) or minus infinity, and the best path in the
max-plus algebra, the only finite one, is the encoding.

* A state at a cut is the piece that covers it (its id and how far it
  reaches). The *transfer matrix* of a chunk holds, for each state at its
  left and each at its right end, the weight of the best path between them.
* Matrices are combined associatively (max-plus products of runs of
  ``RUN`` chunks, then a scan over the runs, then within each run), which
  gives the state at every cut; each chunk is then backtraced on its own.
* No piece goes on from another character into a white-space mark, nor over a
  character that is in no piece, so between such places paths are
  independent: the words between are encoded once and remembered (a bounded
  memory that keeps the most used), and a state there is the single state
  "cut". Chunks end at fixed places, mostly inside a word, where several
  pieces can cover the end.

Texts of up to ``GIANT`` characters are one chunk from cut to cut and are
encoded in a map. Longer ones are normalised, dealt out as chunks over the
cluster, keyed by the hash of the text (equal texts are encoded once), and
joined back to their rows.

Only models of the BPE kind with identity normalisation, where white-space
marks only begin pieces, are taken; others raise ValueError. Edge cases: a
NULL or empty text has no ids. Repeated rows give repeated rows; an empty
table gives an empty result; other columns are passed by. Decoding gives back
the text exactly but for the white-space mark U+2581 itself, which the model
can't tell from a space.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from softgrove.llm.common import add_fields, fresh, steps
from softgrove.session import materialize

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 1 << 15
CHUNK = 1 << 13
#: Chunks whose matrices are multiplied in one task.
RUN = 64
#: Words that a worker remembers.
WORDS = 1 << 19
#: Pairs of pieces that a worker remembers.
MEMORY = 1 << 18
#: Characters of a word that is walked together with others.
TOGETHER = 48
MARK = "▁"

_NONE = -9      # no path ends here
_CUT = -2       # the state (and neighbour) at a place that paths can't cross
_UNKNOWN = -1   # a character that is in no piece
_OFF = -np.inf


class PieceTable:
    """The pieces of a model, as plain values that can be broadcast."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces))
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {self.pieces[i]: (-sp.get_score(i), i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.byte_fallback = sp.is_byte(self.bytes[0])
        for probe in ("a  b ", " é①ﬁ", "Á　x"):
            if sp.normalize(probe) != normalise(probe):
                raise ValueError("the model normalises its input")
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces hold a white-space mark after another character")


def load(path: str = MODEL_PATH) -> PieceTable:
    with open(path, "rb") as f:
        return PieceTable(f.read())


def normalise(text: str) -> str:
    return (MARK + text.replace(" ", MARK)) if text else ""


class Encoder:
    """Paths through the lattice of pieces."""

    _last: Encoder | None = None

    def __init__(self, table: PieceTable):
        self.table = table
        self.rank = table.rank
        self.longest = max(map(len, table.rank))
        self.alphabet = set("".join(table.rank))
        #: trie of the pieces: character -> node, None -> id
        self.trie: dict = {}
        for piece, (_, number) in table.rank.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = number
        self._trie_arrays()
        #: neighbours within pieces; between others no piece goes on
        self.inner = {p[k:k + 2] for p in table.rank for k in range(len(p) - 1)}
        breaks = "".join(re.escape(c) for c in "\n\r\t" if c not in self.alphabet)
        self.words = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|[{breaks}]+" if breaks else ""))
        #: (a << 32) + b -> whether piece b may follow piece a; sorted copies
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.memo: dict[str, int] = {}
        self.flat, self.begin = array("i"), array("q", [0])
        #: how often each remembered word was asked for
        self.uses = np.zeros(0, dtype=np.int64)

    def _forget(self, but: set[str]) -> None:
        """Lessens a full memory to the words in hand and the quarter of it
        that was used most."""
        had, flat, begin, uses = self.memo, self.flat, self.begin, self.uses
        self.memo, self.flat, self.begin = {}, array("i"), array("q", [0])
        words = np.array(list(had), dtype=object)
        uses = np.concatenate((uses, np.zeros(max(0, len(words) - len(uses)), dtype=np.int64)))[:len(words)]
        often = set(np.argsort(-uses, kind="stable")[:WORDS // 4].tolist())
        kept = [k for k, w in enumerate(words) if k in often or w in but]
        for k in kept:
            self._remember(words[k], flat[begin[k]:begin[k + 1]])
        # what was used long ago counts for less
        self.uses = uses[kept] // 2

    def _remember(self, word: str, ids) -> None:
        self.flat.extend(ids)
        self.begin.append(len(self.flat))
        self.memo[word] = len(self.memo)

    @staticmethod
    def of(table: PieceTable) -> Encoder:
        """The encoder of a (broadcast) table; a Python worker keeps the last
        one, so that its memory lasts from task to task."""
        if Encoder._last is None or Encoder._last.table is not table:
            Encoder._last = Encoder(table)
        return Encoder._last

    # -- BPE's order of merges on a short text

    def merges(self, text: str) -> list[str]:
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r[0] < best[0]):
                    best = (r[0], k)
            if best is None:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE gives piece ``b`` after ``a`` (or after a cut)."""
        if b < 0:
            return True
        out = self.pairs.get((a << 32) + b)
        if out is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            own = [self.table.pieces[k] for k in (a, b) if k >= 0]
            out = self.pairs[(a << 32) + b] = self.merges("".join(own)) == own
        return out

    def steps_from(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that begin at a place."""
        out = []
        node = self.trie
        for end in range(at + 1, len(text) + 1):
            node = node.get(text[end - 1])
            if node is None:
                break
            if None in node:
                out.append((end, node[None]))
        return out or [(at + 1, _UNKNOWN)]

    def emit(self, piece: int, text: str) -> list[int]:
        if piece != _UNKNOWN:
            return [piece]
        return [self.table.bytes[b] for b in text.encode()] if self.table.byte_fallback else [self.table.unknown]

    # -- words between cuts

    def path(self, text: str) -> list[int]:
        """Ids along the finite path from cut to cut."""
        n, trie, pairs = len(text), self.trie, self.pairs
        last: list[int | None] = [None] * (n + 1)
        last[0] = _CUT
        back = [0] * (n + 1)
        for at in range(n):
            own = last[at]
            if own is None:
                continue
            high = own << 32
            node, end = trie, at
            for c in text[at:]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                if last[end] is None and None in node:
                    piece = node[None]
                    ok = pairs.get(high + piece)
                    if self.compatible(own, piece) if ok is None else ok:
                        last[end], back[end] = piece, at
            if end == at:
                last[at + 1], back[at + 1] = _UNKNOWN, at
        out: list[list[int]] = []
        end = n
        while end:
            out.append(self.emit(last[end], text[back[end]:end]))
            end = back[end]
        return [i for ids in reversed(out) for i in ids]

    def _trie_arrays(self) -> None:
        """The trie as sorted (node, character) keys, for walking many words
        at once."""
        keys, to, ids = [], [], [-1]
        self.letters = {c: k for k, c in enumerate(sorted(self.alphabet))}
        todo = [(self.trie, 0)]
        while todo:
            node, number = todo.pop()
            for c, child in node.items():
                if c is not None:
                    keys.append(number * len(self.letters) + self.letters[c])
                    to.append(len(ids))
                    todo.append((child, len(ids)))
                    ids.append(child.get(None, -1))
        order = np.argsort(keys)
        #: code point -> letter, -1 for those in no piece
        self.letter_of = np.full(0x110000, -1, dtype=np.int32)
        self.letter_of[[ord(c) for c in self.letters]] = list(self.letters.values())
        self.edge_keys, self.edge_to = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]
        self.node_id = np.array(ids, dtype=np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The letters of words laid end to end, and the words' sizes."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return self.letter_of[codes], np.fromiter(map(len, words), dtype=np.int64, count=len(words))

    def _edges(self, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in words laid end to end;
        ``stop`` is the end of each character's word."""
        at = np.arange(len(text))
        node = np.zeros(len(text), dtype=np.int64)
        found = []
        for k in range(self.longest):
            keep = at + k < stop[at]
            at, node = at[keep], node[keep]
            key = node * len(self.letters) + text[at + k]
            place = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            keep = self.edge_keys[place] == key
            at, node = at[keep], self.edge_to[place[keep]]
            piece = self.node_id[node]
            own = piece >= 0
            found.append((at[own], at[own] + k + 1, piece[own]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) + b
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
            known = self.pair_keys[place] == key if len(self.pair_keys) else np.zeros(len(key), dtype=bool)
            if known.all():
                break
            if len(self.pair_keys) > 2 * MEMORY:
                self.pair_keys, self.pair_ok, known = self.pair_keys[:0], self.pair_ok[:0], np.zeros(len(key), dtype=bool)
            new = np.unique(key[~known])
            ok = np.array([self.compatible(int(k >> 32), int(k & 0xFFFFFFFF)) for k in new.tolist()], dtype=bool)
            self.pairs.clear()
            keys = np.concatenate((self.pair_keys, new))
            order = np.argsort(keys, kind="stable")
            self.pair_keys, self.pair_ok = keys[order], np.concatenate((self.pair_ok, ok))[order]
        return self.pair_ok[place]

    def paths_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids along the finite paths of words (of known characters), and
        how many each has. The words' n-th characters are stepped together."""
        text, size = self._letters(words)
        begin = np.concatenate(([0], np.cumsum(size)))
        start, end, piece = self._edges(text, np.repeat(begin[1:], size))
        place = start - np.repeat(begin[:-1], size)[start]
        order = np.argsort(place, kind="stable")
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        # places between characters: word w has size + 1 of them, from begin[w] + w on
        shift = np.repeat(np.arange(len(words)), size)
        s, e = start + shift[start], end + shift[start]
        last = np.full(begin[-1] + len(words), _NONE, dtype=np.int64)
        last[begin[:-1] + np.arange(len(words))] = _CUT
        back = np.zeros(len(last), dtype=np.int64)
        edge = np.searchsorted(place, np.arange(size.max() + 1 if len(size) else 1))
        for a, b in zip(edge, edge[1:]):
            own = last[s[a:b]]
            go = np.flatnonzero((own != _NONE) & (last[e[a:b]] == _NONE))
            go = go[self._compatible(own[go], piece[a:b][go])]
            last[e[a:b][go]], back[e[a:b][go]] = piece[a:b][go], s[a:b][go]
        at = begin[1:] + np.arange(len(words))
        word = np.arange(len(words))
        steps = []
        while len(at):
            steps.append((word, last[at]))
            at = back[at]
            go = last[at] != _CUT
            at, word = at[go], word[go]
        # backwards: the last step of each word comes first
        word = np.concatenate([w for w, _ in reversed(steps)])
        ids = np.concatenate([i for _, i in reversed(steps)])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) > WORDS:
            self._forget(words)
        new = list(words.difference(self.memo))
        if not new:
            return
        text, size = self._letters(new)
        fit = ((size <= TOGETHER) & (np.minimum.reduceat(text, np.cumsum(size) - size) >= 0)).tolist()
        together = [w for w, ok in zip(new, fit) if ok]
        for at in range(0, len(together), 1 << 14):
            some = together[at:at + (1 << 14)]
            ids, size = self.paths_of(some)
            self.begin.extend((len(self.flat) + np.cumsum(size)).tolist())
            self.flat.extend(ids.tolist())
            self.memo.update(zip(some, range(len(self.memo), len(self.memo) + len(some))))
        for w, ok in zip(new, fit):
            if not ok:
                self._remember(w, self.path(w))

    def encode_all(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text, encoded as one chunk from cut to cut."""
        return self.encode_normal([normalise(t or "") for t in texts])

    def encode_normal(self, texts: list[str]) -> pa.Array:
        """The same of normalised texts, or stretches of one between cuts."""
        per = [self.words.findall(t) for t in texts]
        self._learn({w for ws in per for w in ws})
        size = np.fromiter(map(len, per), dtype=np.int64, count=len(per))
        word = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(per)), dtype=np.int64, count=int(size.sum()))
        used = np.bincount(word, minlength=len(self.memo))
        used[:len(self.uses)] += self.uses
        self.uses = used
        begin = np.array(self.begin, dtype=np.int64)
        many = begin[word + 1] - begin[word]
        ids = _gather(np.frombuffer(self.flat, dtype=np.int32).copy(), begin[word], many)
        upto = np.concatenate(([0], np.cumsum(many)))
        return pa.ListArray.from_arrays(pa.array(upto[np.concatenate(([0], np.cumsum(size)))], pa.int32()), pa.array(ids, pa.int32()))

    # -- chunks of a giant text; a chunk sees ``longest`` characters around it

    def is_cut(self, text: str, at: int) -> bool:
        return (at == 0 or at == len(text) or (text[at] == MARK and text[at - 1] != MARK)
                or text[at - 1:at + 1] not in self.inner)

    def states(self, text: str, at: int, cut: bool) -> list[tuple[int, int]]:
        """(reach beyond the place, id) of the pieces that cover a place."""
        if cut:
            return [(0, _CUT)]
        out = [(end - at, piece) for start in range(max(0, at - self.longest), at)
               for end, piece in self.steps_from(text, start) if end >= at]
        return sorted(set(out))

    def paths(self, text: str, a: int, b: int, entry: list[tuple[int, int]], end_cut: bool):
        """Walks the lattice from the entry states at ``a``. Yields, for each
        piece that covers ``b``, (reach, id, weights by entry state, trail)."""
        nodes: dict[int, dict[int, tuple[np.ndarray, tuple | None]]] = {}
        for k, (reach, piece) in enumerate(entry):
            weight = np.full(len(entry), _OFF)
            weight[k] = 0.0
            nodes.setdefault(a + reach, {})[piece] = (weight, None)
        found: dict[tuple[int, int], tuple[np.ndarray, tuple | None]] = {}

        def reach_node(end: int, piece: int, weight, trail):
            if end >= b:
                key = (0, _CUT) if end_cut and end == b else (end - b, piece)
                had = found.get(key)
                found[key] = (weight if had is None else np.maximum(had[0], weight), trail if had is None else had[1])
            else:
                here = nodes.setdefault(end, {})
                had = here.get(piece)
                here[piece] = (weight if had is None else np.maximum(had[0], weight), trail if had is None else had[1])

        for end, pieces in [(e, p) for e, p in nodes.items() if e >= b]:
            for piece, (weight, trail) in pieces.items():
                reach_node(end, piece, weight, trail)
            del nodes[end]
        while nodes:
            at = min(nodes)
            here = nodes.pop(at)
            if at > a and self.is_cut(text, at):
                # all paths meet: words up to the last cut are independent
                weight = np.maximum.reduce([w for w, _ in here.values()])
                trail = next((t for w, t in here.values() if w.max() == 0), None)
                to = next((p for p in range(b, at, -1) if self.is_cut(text, p)), at)
                if to == b and not end_cut:
                    to = next((p for p in range(b - 1, at, -1) if self.is_cut(text, p)), at)
                if to > at:
                    reach_node(to, _CUT, weight, (trail, "words", at, to))
                    continue
                here = {_CUT: (weight, trail)}
            for end, piece in self.steps_from(text, at):
                ok = [(w, t) for p, (w, t) in here.items() if self.compatible(p, piece)]
                if ok:
                    weight = np.maximum.reduce([w for w, _ in ok])
                    if weight.max() == 0:
                        trail = next(t for w, t in ok if w.max() == 0)
                        reach_node(end, piece, weight, (trail, piece, at, end))
        return found

    def matrix(self, text: str, a: int, b: int, begin_cut: bool, end_cut: bool) -> np.ndarray:
        """Transfer matrix [state at a, state at b] of text[a:b]."""
        entry, leave = self.states(text, a, begin_cut), self.states(text, b, end_cut)
        out = np.full((len(entry), len(leave)), _OFF)
        found = self.paths(text, a, b, entry, end_cut)
        for k, state in enumerate(leave):
            if state in found:
                out[:, k] = found[state][0]
        return out

    def backtrace(self, text: str, a: int, b: int, begin_cut: bool, end_cut: bool, first: int, last: int) -> list[list[int] | str]:
        """The path of the pieces that begin in text[a:b] between a state at
        ``a`` and one at ``b``: ids, and stretches of words between cuts."""
        entry = self.states(text, a, begin_cut)[first]
        state = self.states(text, b, end_cut)[last]
        trail = self.paths(text, a, b, [entry], end_cut)[state][1]
        out: list[list[int] | str] = []
        while trail is not None:
            trail, what, start, end = trail
            out.append(text[start:end] if what == "words" else self.emit(what, text[start:end]))
        return out[::-1]

    def ids_of(self, paths: list[list[list[int] | str]]) -> list[np.ndarray]:
        """Ids along backtraced paths; the words of all are encoded together."""
        words = self.encode_normal([x for path in paths for x in path if isinstance(x, str)])
        values, offsets, k, out = words.values.to_numpy(), words.offsets.to_numpy(), 0, []
        for path in paths:
            ids = [np.zeros(0, dtype=np.int32)]
            for x in path:
                if isinstance(x, str):
                    ids.append(values[offsets[k]:offsets[k + 1]])
                    k += 1
                else:
                    ids.append(np.array(x, dtype=np.int32))
            out.append(np.concatenate(ids))
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[begin:begin + size], one after the other."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return flat[shift + np.arange(total)]


# ---------------------------------------------------------------------------
# DataFrames

_CHUNK_ROWS = "key string, no int, text string, a int, b int, begin_cut boolean, end_cut boolean"


def _chunk_rows(sent, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(sent.value)
        around = encoder.longest + 1
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                text = normalise(raw)
                ends = [*range(chunk, len(text), chunk), len(text)]
                for lot in range(0, len(ends), 256):
                    rows = []
                    for no in range(lot, min(lot + 256, len(ends))):
                        a, b = (ends[no - 1] if no else 0), ends[no]
                        lo, hi = max(0, a - around), min(len(text), b + around)
                        rows.append((key, no, text[lo:hi], a - lo, b - lo, encoder.is_cut(text, a), encoder.is_cut(text, b)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()))],
                        names=["key", "no", "text", "a", "b", "begin_cut", "end_cut"])
    return run


def _pack(m: np.ndarray) -> tuple[int, bytes]:
    return m.shape[0], m.astype(np.float32).tobytes()


def _unpack(rows: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float32).reshape(rows, -1)


def _scan(matrices: list[np.ndarray], first: int, last: int | None) -> list[int]:
    """State numbers at the ends of a run of chunks whose first and last (or
    any) states are known: best weights from both sides, the path is where
    their sum is finite."""
    weight = np.full(matrices[0].shape[0], _OFF)
    weight[first] = 0.0
    ahead = []
    for m in matrices:
        weight = np.max(weight[:, None] + m, axis=0)
        ahead.append(weight)
    behind = np.zeros(matrices[-1].shape[1])
    if last is not None:
        behind[:] = _OFF
        behind[last] = 0.0
    out = []
    for m, w in zip(reversed(matrices), reversed(ahead)):
        out.append(int(np.argmax(w + behind)))
        behind = np.full(m.shape[1], _OFF)
        behind[out[-1]] = 0.0
        behind = np.max(m + behind[None, :], axis=1)
    return out[::-1]


def _giant_ids(texts: DataFrame, sent, chunk: int) -> DataFrame:
    """(key, ids) of the texts (key, text)."""
    rows = materialize(texts.mapInArrow(_chunk_rows(sent, chunk), _CHUNK_ROWS).repartition("key", "no"))

    def matrices(frames):
        encoder = Encoder.of(sent.value)
        for df in frames:
            got = [_pack(encoder.matrix(r.text, r.a, r.b, r.begin_cut, r.end_cut)) for r in df.itertuples()]
            yield pd.DataFrame({"key": df["key"], "no": df["no"], "rows": [g[0] for g in got], "data": [g[1] for g in got]})

    chunks = materialize(rows.mapInPandas(matrices, "key string, no int, rows int, data binary")
                         .withColumn("run", F.expr(f"no div {RUN}").cast("int")))

    def run_product(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("no")
        out = None
        for r in df.itertuples():
            m = _unpack(r.rows, r.data)
            out = m if out is None else product(out, m)
        n, data = _pack(out)
        return pd.DataFrame({"key": [df["key"].iloc[0]], "run": [df["run"].iloc[0]], "rows": [n], "data": [data]})

    runs = chunks.groupBy("key", "run").applyInPandas(run_product, "key string, run int, rows int, data binary")

    def over_runs(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("run")
        last = _scan([_unpack(r.rows, r.data) for r in df.itertuples()], 0, 0)
        return pd.DataFrame({"key": df["key"], "run": df["run"], "first": [0, *last[:-1]], "last": last})

    # a text has at most 2^31 / (chunk * RUN) runs
    between = runs.groupBy("key").applyInPandas(over_runs, "key string, run int, first int, last int")

    def within_run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("no")
        first, last = int(df["first"].iloc[0]), int(df["last"].iloc[0])
        states = _scan([_unpack(r.rows, r.data) for r in df.itertuples()], first, last)
        return pd.DataFrame({"key": df["key"], "no": df["no"], "first": [first, *states[:-1]], "last": states})

    states = (chunks.join(between, ["key", "run"]).groupBy("key", "run")
              .applyInPandas(within_run, "key string, no int, first int, last int"))

    def trace(frames):
        encoder = Encoder.of(sent.value)
        for df in frames:
            for at in range(0, len(df), 256):
                part = df.iloc[at:at + 256]
                paths = [encoder.backtrace(r.text, r.a, r.b, r.begin_cut, r.end_cut, r.first, r.last) for r in part.itertuples()]
                yield pd.DataFrame({"key": part["key"].values, "no": part["no"].values, "ids": encoder.ids_of(paths)})

    parts = rows.join(states, ["key", "no"]).mapInPandas(trace, "key string, no int, ids array<int>")
    return parts.groupBy("key").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda p: p.ids)).alias("ids"))


def encode(documents: DataFrame, text_col: str = "text", table: PieceTable | None = None, keep: list[str] | None = None,
           name: str = "ids", giant: int = GIANT, chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), ``name``: the ids of the text, and
    ``decoded`` if it is given: the text decoded from these ids."""
    spark: SparkSession = documents.sparkSession
    keep = documents.columns if keep is None else keep
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the documents have a column named {name}")
    need = list(dict.fromkeys([*keep, text_col]))
    table = table or load()
    sent = spark.sparkContext.broadcast(table)
    docs = documents.select(*[F.col(f"`{c}`") for c in need])
    text = F.col(f"`{text_col}`")

    def run(batches):
        encoder = Encoder.of(sent.value)
        decoder = Decoder(sent.value) if decoded else None
        for batch in batches:
            for part in steps(batch, text_col):
                ids = encoder.encode_all(part.column(text_col).to_pylist())
                new = [ids, decoder.decode_all(ids)] if decoder else [ids]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=[*keep, name, *([decoded] if decoded else [])])

    kept = [F.col(f"`{c}`") for c in keep]
    new = [(name, ArrayType(IntegerType())), *([(decoded, StringType())] if decoded else [])]
    schema = add_fields(docs.select(*kept).schema, new)
    small = docs.where(text.isNull() | (F.length(text) <= giant)).mapInArrow(run, schema)
    large = docs.where(F.length(text) > giant)
    key = fresh([*need, name], "_key")
    keyed = large.withColumn(key, F.sha2(text.cast("binary"), 256))
    ids = _giant_ids(keyed.select(F.col(key).alias("key"), text.alias("text")).dropDuplicates(["key"]), sent, chunk)
    ids = ids.select(F.col("key").alias(f"{key}2"), F.col("ids").alias(name))
    large = keyed.select(*kept, key).join(ids, F.col(key) == F.col(f"{key}2")).select(*kept, name)
    if decoded:
        large = decode(large, name, table, name=decoded)
    return small.unionByName(large)


def decode(encoded: DataFrame, ids_col: str = "ids", table: PieceTable | None = None, keep: list[str] | None = None,
           name: str = "decoded") -> DataFrame:
    """Columns ``keep`` (default: all) and ``name``: the text of the ids
    (NULL ids: empty; ids of no piece raise ValueError)."""
    keep = encoded.columns if keep is None else keep
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"there is a column named {name}")
    sent = encoded.sparkSession.sparkContext.broadcast(table or load())

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), decoder.decode_all(part.column(ids_col))],
                                                 names=[*keep, name])

    df = encoded.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, ids_col])])
    return df.mapInArrow(run, add_fields(df.select(*[F.col(f"`{c}`") for c in keep]).schema, [(name, StringType())]))


class Decoder:
    def __init__(self, table: PieceTable):
        text = [p.replace(MARK, " ").encode() for p in table.pieces]
        plain = {i for _, i in table.rank.values()}
        for i in range(len(text)):
            if i not in plain:
                text[i] = b" \xe2\x81\x87 " if i == table.unknown else b""
        if table.byte_fallback:
            for b, i in enumerate(table.bytes):
                text[i] = bytes([b])
        self.size = np.array([len(t) for t in text], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(text), dtype=np.uint8)

    def decode_all(self, col: pa.Array) -> pa.Array:
        ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.size)):
            raise ValueError("an id is not in the model")
        size = np.nan_to_num(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
        text = _gather(self.flat, self.begin[ids], self.size[ids]).tobytes()
        upto = np.concatenate(([0], np.cumsum(self.size[ids])))
        ends = upto[np.concatenate(([0], np.cumsum(size)))].tolist()
        out = [text[a:b].decode("utf-8", errors="replace") for a, b in zip(ends, ends[1:])]
        return pa.array([t[1:] if t.startswith(" ") else t for t in out], pa.string())
