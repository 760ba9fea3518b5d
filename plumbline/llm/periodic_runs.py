"""Maximal periodic runs of words, by recompression.

The words of some whole texts, with a separator of its own kind around each text, are compressed level by level: equal neighbours become one
block, then the symbols are halved by a bit of their hash and each left one followed by a right one becomes a pair.  Names are 64-bit
hashes of what they stand for, so that equal stretches get equal symbols but for a few at their borders.  The levels form
a run-length grammar, and the longest common extension of two positions climbs it while symbols agree and descends where they
first differ: a step or two on each of a logarithmic number of levels, for many pairs of positions in step.

A run of period p and length max(12, 2 p) or more covers two points of a grid of spacing max(p, 12 - p) and their successors p words on.  The
harmonic sum of these grids is n log n; a pair whose words, or whose neighbours on both sides, differ is passed over, and every other pair
is extended both ways by the grammar.  Of the periods found for one stretch the smallest counts (it divides the others).

Every document is handled where it was read: no shuffle, and a lost task is simply rerun.  A task holds a slice of about one megabyte of text, or
one longer text, with some 200 bytes a word; grid pairs are made in steps of a bounded number.

Cases: null and empty texts have no words, no run and the hash of the empty string; repeated rows keep a row each; a null doc_id counts as the
empty string where ids are hashed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Words, mixed, slices, table

#: Least words of a run.
LEAST = 12
#: Grid pairs that are made at once.
STEP = 1 << 20
_ONE, _TWO, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

RUN_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass
class Level:
    """One rewriting: symbols, the parent of each on the next level, and the first and last child of each parent."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    blocks: bool

    def mirrored(self) -> Level:
        n, m = len(self.symbols), len(self.first)
        return Level(self.symbols[::-1], (m - 1 - self.parent)[::-1], (n - 1 - self.last)[::-1], (n - 1 - self.first)[::-1], self.blocks)


def _level(symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> Level:
    """``starts``: whether a symbol is the first child of its parent."""
    first = np.flatnonzero(starts).astype(np.int32)
    return Level(symbols, np.cumsum(starts, dtype=np.int32) - np.int32(1), first, np.append(first[1:], np.int32(len(symbols))) - np.int32(1), blocks)


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels of block and pair compression, from the words up to one symbol."""
    levels: list[Level] = []
    k = 0
    while len(symbols) > 1:
        k += 1
        salt = np.uint64(k * int(_SALT) & (1 << 64) - 1)
        starts = np.ones(len(symbols), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=starts[1:])
        if not starts.all():
            levels.append(_level(symbols, starts, True))
            count = (levels[-1].last - levels[-1].first + 1).astype(np.uint64)
            kept = symbols[starts]
            symbols = np.where(count > 1, mixed(kept * _ONE + count * _TWO + salt), kept)
        left = mixed(symbols ^ salt) >> np.uint64(63) == 1
        starts = np.ones(len(symbols), bool)
        starts[1:] = ~(left[:-1] & ~left[1:])
        if not starts.all():
            levels.append(_level(symbols, starts, False))
            first, last = levels[-1].first, levels[-1].last
            paired = mixed(symbols[first] * _ONE ^ mixed(symbols[last] + salt))
            symbols = np.where(first < last, paired, symbols[first])
    return levels


def _advance(level: Level, x: np.ndarray, y: np.ndarray, climb: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move pairs of positions on while their symbols agree; whether each stopped at differing symbols.

    A pair that climbs stops as well where both are first children.
    """
    x, y = x.copy(), y.copy()
    differ = np.zeros(len(x), bool)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo], y[todo]
        if climb:
            stay = (level.first[level.parent[a]] != a) | (level.first[level.parent[b]] != b)
            todo, a, b = todo[stay], a[stay], b[stay]
        same = level.symbols[a] == level.symbols[b]
        differ[todo[~same]] = True
        todo, a, b = todo[same], a[same], b[same]
        go = np.minimum(level.last[level.parent[a]] - a, level.last[level.parent[b]] - b) + 1 if level.blocks else 1
        x[todo], y[todo] = a + go, b + go
    return x, y, differ


def common_extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from ``x`` and from ``y`` on agree.  All positions differ pairwise, and a symbol that occurs once ends the words."""
    at_x, at_y = x.astype(np.int64), y.astype(np.int64)
    met = np.zeros(len(x), np.int64)
    todo = np.arange(len(x))
    for k, level in enumerate(levels):
        if not len(todo):
            break
        at_x[todo], at_y[todo], differ = _advance(level, at_x[todo], at_y[todo], True)
        met[todo[differ]] = k
        todo = todo[~differ]
        at_x[todo], at_y[todo] = level.parent[at_x[todo]], level.parent[at_y[todo]]
    for k in range(int(met.max(initial=0)), 0, -1):
        todo = np.flatnonzero(met >= k)
        below = levels[k - 1]
        at_x[todo], at_y[todo], _ = _advance(below, below.first[at_x[todo]], below.first[at_y[todo]], False)
    return at_x - x


def _grids(n_words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and periods of the harmonic grids of texts that begin at ``begin``, in steps of about ``STEP``."""
    periods = n_words // 2
    periods[n_words < LEAST] = 0
    base = np.repeat(np.cumsum(periods) - periods, periods)
    p = np.arange(len(base)) - base + 1
    own = np.repeat(np.arange(len(n_words)), periods)
    gap = np.maximum(p, LEAST - p)
    count = -((p - n_words[own]) // gap)
    total = np.cumsum(count)
    at = 0
    while at < len(p):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        c = count[at:stop]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(begin[own[at:stop]], c) + k * np.repeat(gap[at:stop], c), np.repeat(p[at:stop], c)
        at = stop


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of some texts, ``first[d]:first[d + 1]`` being the words (as 64-bit hashes) of text d: text, start, end and period,
    in the order of text, start and period."""
    n_docs = len(first) - 1
    shift = np.arange(n_docs) + 1
    row = np.empty(len(words) + n_docs + 1, np.uint64)
    begin, n_words = first[:-1] + shift, np.diff(first)
    word = np.ones(len(row), bool)
    word[0] = False
    word[begin + n_words] = False
    row[word] = words
    row[~word] = mixed(np.arange(n_docs + 1, dtype=np.uint64) ^ _SALT)
    end_of_row = len(row) - 1
    levels: list[Level] = []
    mirror: list[Level] = []
    found = [np.zeros((3, 0), np.int64)]
    for i, p in _grids(n_words.copy(), begin):
        hit = np.flatnonzero(row[i] == row[i + p])
        i, p = i[hit], p[hit]
        hit = (row[i + 1] == row[i + p + 1]) | (row[i - 1] == row[i + p - 1])
        i, p = i[hit], p[hit]
        if len(i) and not levels:
            levels = grammar(row)
            mirror = [x.mirrored() for x in levels]
        end = i + p + common_extension(levels, i, i + p)
        start = i - common_extension(mirror, end_of_row - (i - 1), end_of_row - (i + p - 1))
        good = end - start >= np.maximum(LEAST, 2 * p)
        found.append(np.unique(np.stack([start[good], end[good], p[good]]), axis=1))
    start, end, p = np.concatenate(found, 1)
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    least = np.ones(len(p), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[least], end[least], p[least]
    own = np.searchsorted(begin, start, "right") - 1
    order = np.lexsort((p, start))
    return tuple(v[order] for v in (own, start - begin[own], end - begin[own], p))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word at each place of a text of ``n`` words into which the contract repeats a stretch; None where it leaves the text."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def _text_of(raw: bytes, source: np.ndarray | None, drop: np.ndarray | None) -> bytes:
    """Kept words of a text, joined by one space."""
    words = raw.split()
    if drop is not None:
        source = (np.arange(len(words)) if source is None else source)[~drop]
    return b" ".join(words if source is None else [words[k] for k in source.tolist()])


def collapsed(docs: DataFrame, plant: bool = False, with_text: bool = False) -> DataFrame:
    """One row for each document: its number of runs, the longest one, hashes of all runs and of the text without the repetitions.

    A run keeps its first period.  ``plant``: first repeat a stretch in a tenth of the documents, as the contract's query does.
    ``with_text``: the collapsed text itself as one more column.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            raws = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
            words = Words(texts)
            hashes, first = words.hash, words.first
            sources: list[np.ndarray | None] = [planted(d, n) for d, n in zip(ids, np.diff(first).tolist(), strict=True)] if plant else [None] * len(ids)
            if any(s is not None for s in sources):
                at = np.arange(len(hashes))
                for d, s in enumerate(sources):
                    if s is not None:
                        at[first[d] : first[d + 1]] = first[d] + s
                hashes = hashes[at]
            own, start, end, period = runs_of(hashes, first)
            edge = np.searchsorted(own, np.arange(len(ids) + 1))
            rows = []
            for d, doc_id in enumerate(ids):
                s, e, p = (v[edge[d] : edge[d + 1]] for v in (start, end, period))
                best: tuple[int | None, ...] = (None,) * 4
                drop = None
                if len(s):
                    k = int(np.lexsort((p, s, s - e))[0])
                    best = int(s[k]), int(e[k] - s[k]), int(p[k]), int(1000 * (e[k] - s[k]) // p[k])
                    cover = np.zeros(first[d + 1] - first[d] + 1, np.int64)
                    np.add.at(cover, s + p, 1)
                    np.add.at(cover, e, -1)
                    drop = np.cumsum(cover)[:-1] > 0
                listed = "".join(f"{a},{b - a},{c}\n" for a, b, c in zip(s.tolist(), e.tolist(), p.tolist(), strict=True))
                kept = _text_of(raws[d], sources[d], drop)
                row = (doc_id, len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode()) if with_text else row)
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.string()] * (len(names) - 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = RUN_SCHEMA + (", collapsed string" if with_text else "")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "documents"), plant=True)
