"""Token counts by compiled finite-state transducers.

Two deterministic machines replace the tokenizer library on the path of the texts.

*Pieces.*  Seven states over thirteen classes of characters find where the tokenizer's pattern begins a piece.  A run of text is cut
into lanes of equal length; each lane maps every state at its start to a state at its end, the maps of the lanes are
composed by a parallel prefix scan, and with each lane's true first state all lanes mark their pieces at once.  The class of a
character, and whether the library folds it differently from Python, is asked of the library once for each page of 256 code points.

*Counts.*  Merging by rank has one property that makes it finite-state: the encoding of a prefix is the encoding of a shorter prefix and one last
token, and that token is the only one that stands unmerged beside the token before it.  A state of the word machine therefore holds, for each
suffix of what was read that may still grow into a token, the token that stood before that suffix and how many tokens fewer there were.
Reading a byte finds the last token of the longer prefix and emits the change of the count.  A suffix that no token can follow up
is dropped, and tokens before it that allow the same continuations are one.  States and transitions are compiled when text first asks for
them, into a table of bounded size that is dropped whole and compiled anew when it is full.

Every document is counted where it was read: no shuffle, and a lost task is simply rerun.

Cases: a null text counts as empty (0 bytes, 0 tokens); null and repeated ids keep a row each; texts of any length are read in spans that end
at white space (a span without any is read on until there is some); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

LIMIT = 2048
#: Characters of a span, and of a lane of the scan.
SPAN, LANE = 1 << 20, 128
#: States of the word machine that are held at once; bytes from which a piece is read alone.
STATES, LONG = 200_000, 256
#: Tokens below a suffix up to which tokens before it are told apart by what they allow.
FEW = 6

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# --- pieces ------------------------------------------------------------------------------------

#: The pattern's contractions, by their letters, and the classes of characters.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
SPACE, LETTER, NUMBER, OTHER, QUOTE = range(5)
OWN_CLASS = {c: 5 + k for k, c in enumerate("stmdrvle")}
CLASSES = 5 + len(OWN_CLASS)
UNKNOWN = 255

START_HERE, START_BEFORE = 1, 2


def _piece_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state and class.  States: gap, letters, others, quote, and a quote with the first letter of a long contraction."""
    gap, letters, others, quote = range(4)
    half = {c[0]: 4 + k for k, c in enumerate(x for x in CONTRACTIONS if len(x) == 2)}
    second = {half[c[0]]: OWN_CLASS[c[1]] for c in CONTRACTIONS if len(c) == 2}
    n = 4 + len(half)
    to, mark = np.zeros((n, CLASSES), np.uint8), np.zeros((n, CLASSES), np.uint8)

    def afresh(state: int, kind: int) -> None:
        """What a character does where a piece has just ended."""
        is_letter = kind == LETTER or kind >= 5
        to[state, kind] = letters if is_letter else {SPACE: gap, NUMBER: gap, OTHER: others, QUOTE: quote}[kind]
        mark[state, kind] = 0 if kind == SPACE else START_HERE

    for kind in range(CLASSES):
        is_letter = kind == LETTER or kind >= 5
        for state in range(n):
            afresh(state, kind)
        for state in (letters, *half.values()):
            if is_letter:
                to[state, kind], mark[state, kind] = letters, 0
        for state in (others, quote):
            if kind in (OTHER, QUOTE):
                to[state, kind], mark[state, kind] = others, 0
        for state in half.values():
            mark[state, kind] |= START_BEFORE
    for c in CONTRACTIONS:
        to[quote, OWN_CLASS[c[0]]], mark[quote, OWN_CLASS[c[0]]] = half.get(c[0], gap), 0
    for state, kind in second.items():
        to[state, kind], mark[state, kind] = gap, 0
    return to, mark


_TO, _MARK = _piece_machine()


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps: row k sends a state before lane 0 to the one after lane k."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].copy(), 1)
        step *= 2
    return out


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin in a run of classes that starts afresh and ends with white space."""
    n = len(kinds)
    lanes = -(-n // LANE)
    grid = np.zeros(lanes * LANE, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    to, mark = _TO.ravel(), _MARK.ravel()
    first = np.zeros(lanes, np.uint8)
    if lanes > 1:
        state = np.repeat(np.arange(len(_TO), dtype=np.uint8)[:, None], lanes, 1)
        for row in grid:
            state = to[state * np.uint8(CLASSES) + row]
        first[1:] = composed(np.ascontiguousarray(state.T))[:-1, 0]
    marks = np.empty((LANE, lanes), np.uint8)
    for k, row in enumerate(grid):
        at = first * np.uint8(CLASSES) + row
        marks[k], first = mark[at], to[at]
    marks = marks.T.ravel()[:n]
    begins = marks & START_HERE
    begins[:-1] |= (marks[1:] & START_BEFORE) >> 1
    return begins.view(bool)


# --- counts ------------------------------------------------------------------------------------


@cache
def _byte_names() -> list[str]:
    """The printable character by which the vocabulary names each byte: itself where it is printable, else the next free one from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Merges:
    """The vocabulary as derivations: which pairs merge at which rank, and what stands at the edges of a token at what time."""

    def __init__(self, model: dict) -> None:
        end = model["end_of_word_suffix"]
        names = _byte_names()
        self.ids: dict[str, int] = {}
        self.symbols: list[tuple[int, ...]] = []
        for s in range(512):
            self.ids[names[s & 255] + (end if s > 255 else "")] = s
            self.symbols.append((s,))
        self.rank: dict[tuple[int, int], int] = {}
        parts: list[tuple[int, int] | None] = [None] * 512
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, name = self.ids[a], self.ids[b], a + b
            self.rank[a, b] = rank
            if name not in self.ids:
                self.ids[name] = len(self.symbols)
                self.symbols.append(self.symbols[a] + self.symbols[b])
                parts.append((a, b))
        born = [-1 if p is None else self.rank[p] for p in parts]
        if any(p and max(born[p[0]], born[p[1]]) >= r for p, r in zip(parts, born, strict=True)):
            raise ValueError("a token merges before its parts do")
        # what is at the left (right) edge of each token: (piece, born at, gone at), outermost last
        never = len(model["merges"])
        self.left, self.right = [], []
        for edges, side in ((self.left, 0), (self.right, 1)):
            for t, p in enumerate(parts):
                inner = [] if p is None else edges[p[side]]
                if inner:
                    inner = [*inner[:-1], (*inner[-1][:2], born[t])]
                edges.append([*inner, (t, born[t], never)])
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` side by side stay two tokens: no merge across their border comes before those on its sides.

        Of merges of one rank the leftmost comes first, so the left side's count as earlier.
        """
        if (a, b) not in self.known:
            self.known[a, b] = not any(
                (r := self.rank.get((x, y))) is not None and max((x0, 0), (y0, 1)) < min((x1, 0), (y1, 1)) and r < x1 and r <= y1
                for x, x0, x1 in self.right[a]
                for y, y0, y1 in self.left[b]
            )
        return self.known[a, b]


class WordMachine:
    """Transitions of the word machine, by state and symbol (a byte, or a byte that ends its piece), compiled on demand."""

    def __init__(self, model: dict) -> None:
        self.merges = Merges(model)
        self.child: list[dict[int, int]] = [{}]
        self.token, self.below = [-1], [0]
        for t, symbols in enumerate(self.merges.symbols):
            node = 0
            for s in symbols:
                self.below[node] += 1
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.below.append(0)
                node = self.child[node][s]
            self.token[node] = t
        self.forget()

    def forget(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.seen: dict[tuple[int, int], int | None] = {}
        self.kinds: dict[tuple[int, frozenset], int] = {}
        self.merges.known.clear()
        self._room(1 << 18)

    def _room(self, size: int) -> None:
        self.keys, self.to, self.emit = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8)
        self.shift = np.uint64(64 - size.bit_length() + 1)

    def _tokens_below(self, node: int) -> Iterator[int]:
        todo = list(self.child[node].values())
        while todo:
            at = todo.pop()
            if self.token[at] >= 0:
                yield self.token[at]
            todo.extend(self.child[at].values())

    def _before(self, node: int, last: int) -> int | None:
        """The token that stands for ``last`` before the suffix ``node``; none if nothing that the suffix grows into may follow it."""
        if last < 0:
            return last
        if self.below[node] > FEW:
            return last
        if (node, last) not in self.seen:
            allowed = frozenset(t for t in self._tokens_below(node) if self.merges.apart(last, t))
            self.seen[node, last] = self.kinds.setdefault((node, allowed), last) if allowed else None
        return self.seen[node, last]

    def compile(self, key: int) -> tuple[int, int]:
        """Next state and change of the count for ``state * 512 + symbol``."""
        if key in self.step:
            return self.step[key]
        symbol = key & 511
        grown = [(c, last, less) for node, last, less in self.states[key >> 9] if (c := self.child[node].get(symbol))]
        token, change = next((t, less + 1) for c, last, less in grown if (t := self.token[c]) >= 0 and (last < 0 or self.merges.apart(last, t)))
        number = 0
        if symbol < 256:
            state = [(0, token, 0)]
            for c, last, less in grown:
                if self.child[c] and (before := self._before(c, last)) is not None:
                    state.append((c, before, less - change))
            state = tuple(state)
            number = self.number.setdefault(state, len(self.states))
            if number == len(self.states):
                self.states.append(state)
        self.step[key] = number, change
        return number, change

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Slots that hold ``keys``, or the free ones where they belong."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (self.keys[at[todo]] >= 0)]
        return at

    def _enter(self, keys: list[int]) -> None:
        if len(self.step) + len(keys) > len(self.keys) // 3:
            size = len(self.keys)
            while len(self.step) + len(keys) > size // 3:
                size *= 2
            self._room(size)
            keys = [*self.step, *keys]
        made = np.array([self.compile(key) for key in keys])
        todo = np.array(keys)
        while len(todo):  # of those that belong to one free slot, one takes it
            at, own = np.unique(self._place(todo), return_index=True)
            self.keys[at], self.to[at], self.emit[at] = todo[own], made[own, 0], made[own, 1]
            todo, made = np.delete(todo, own), np.delete(made, own, 0)

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[begin:end]``, all pieces in step."""
        if len(self.states) > STATES:
            self.forget()
        size = end - begin
        total = np.zeros(len(size), np.int64)
        for k in np.flatnonzero(size > LONG):
            total[k] = self._count_alone(data[begin[k] : end[k]].tolist())
        order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
        order = order[np.count_nonzero(size > LONG) :]
        begin, size = begin[order], size[order]
        state, found = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        left = len(order) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1))
        for k, n in enumerate(left.tolist()):
            key = state[:n] * 512 + data[begin[:n] + k]
            key[size[:n] == k + 1] += 256
            at = self._place(key)
            absent = self.keys[at] != key
            if absent.any():
                self._enter(np.unique(key[absent]).tolist())
                at = self._place(key)
            state[:n] = self.to[at]
            found[:n] += self.emit[at]
        total[order] = found
        return total

    def _count_alone(self, piece: list[int]) -> int:
        state = total = 0
        for s in piece[:-1]:
            state, change = self.compile(state * 512 + s)
            total += change
        return total + self.compile(state * 512 + 256 + piece[-1])[1]


class Compiled:
    """Both machines of one tokenizer file: lower-cased BPE with word ends and the piece pattern above."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        if rules["model"]["type"] != "BPE" or not rules["model"].get("end_of_word_suffix") or rules["model"].get("ignore_merges"):
            raise ValueError("not a BPE with word ends")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"]):
            raise ValueError("added tokens that reach beyond their own text")
        special = sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = WordMachine(rules["model"])
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.odd = np.zeros(0x110000, bool)

    def _meet(self, points: np.ndarray) -> None:
        """Ask the library about the pages of these code points that are new."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        for page in np.unique(points >> 8).tolist():
            if self.kind[page << 8] != UNKNOWN:
                continue
            for c in range(page << 8, (page + 1) << 8):
                if 0xD800 <= c < 0xE000:
                    self.kind[c] = OTHER
                    continue
                x = chr(c)
                if not pieces(x):
                    self.kind[c] = SPACE
                elif x in OWN_CLASS:
                    self.kind[c] = OWN_CLASS[x]
                elif x == "'":
                    self.kind[c] = QUOTE
                else:
                    self.kind[c] = NUMBER if len(pieces(x + x)) == 2 else LETTER if len(pieces("a" + x)) == 1 else OTHER
                self.odd[c] = unicodedata.category(x) == "Cn" or self.library.normalizer.normalize_str(x) != (" " if self.kind[c] == SPACE else self._fold(x))

    @staticmethod
    def _fold(text: str) -> str:
        """Composed and lower-cased, each letter for itself: no final form of sigma."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def folded(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self._meet(points)
        return self.library.normalizer.normalize_str(text) if self.odd[points].any() else self._fold(text)

    def _span(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Tokens of each part of a folded text; parts end (with white space) at ``ends``."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            self._meet(points)
            kinds = self.kind[points]
        begins = piece_starts(kinds)
        marks = np.flatnonzero(begins | (kinds == SPACE))
        is_piece = begins[marks]
        begin = marks[is_piece]
        end = marks[np.flatnonzero(is_piece) + 1]
        part = np.searchsorted(ends, begin, "right")
        if not text.isascii():
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            at = np.append(0, np.cumsum(width, dtype=np.int64))
            begin, end = at[begin], at[end]
        found = self.words.counts(np.frombuffer(text.encode("utf-8"), np.uint8), begin, end)
        return np.bincount(part, weights=found, minlength=len(ends)).astype(np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            own = [text]
            if self.special and "<" in text:
                own = self.special.split(text)
                out[k] += len(own) - 1
            parts += own
            owner += [k] * len(own)
        at = 0
        while at < len(parts):  # as many whole parts as fit a span
            run, size, first = [], 0, at
            while at < len(parts) and (not run or size + len(parts[at]) <= SPAN):
                run.append(self.folded(parts[at]) + " ")
                size += len(run[-1])
                at += 1
            if len(run) == 1 and size > SPAN:
                found = np.array([sum(int(self._span(x, np.array([len(x)]))[0]) for x in self._cut(run[0]))])
            else:
                found = self._span("".join(run), np.cumsum([len(x) for x in run]))
            np.add.at(out, owner[first:at], found)
        return out

    @staticmethod
    def _cut(text: str) -> Iterator[str]:
        """Spans of a long text that ends with white space, each up to a space."""
        at = 0
        while at < len(text):
            stop = text.find(" ", min(at + SPAN, len(text) - 1)) + 1
            yield text[at:stop]
            at = stop


@cache
def compiled(path: str) -> Compiled:
    """A worker's machines for a file, kept from task to task."""
    return Compiled(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, as the library counts with the tokenizer file at ``path``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in slices(batches, limit=4 * SPAN):
            texts = pc.fill_null(batch.column("text"), "")
            found = pa.array(machine.counts(texts.to_pylist()), pa.int64())
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, found, pc.greater(found, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(count, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
