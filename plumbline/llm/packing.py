"""Packing token sequences by best fit, decreasing.

Each Spark task streams its own rows in bounded groups, so nothing is shuffled and a lost task is simply rerun:
the order of its rows, and with it every sequence, is fixed by its input split.

Within a group, documents are first cut into full windows; what is left of each is placed, longest first, into the
open window with the least room that still holds it.  A segment tree over remaining capacities finds that window.
Windows that end up half full are then dissolved, emptiest first, and their pieces fill the gaps of the others, cut
where needed.  The last window of a task is laid out as sequences whose lengths are powers of two, which
need no padding.

Cases: a null text counts as empty and still gives its end token; repeated rows are packed like others; a text of
any length is cut into full windows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, signed, slices, table

#: Tokens of a window, and of the documents that one task packs at a time.
WINDOW = 4096
GROUP_TOKENS = 1 << 22
#: Bytes of text that are encoded at once: the more, the fewer words are looked up again.
STEP = 4 << 20
#: Distinct words whose ids a task keeps at once, and words that one call of the tokenizer encodes.
CACHED_WORDS, AT_ONCE = 1_000_000, 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Token ids of whole texts, by way of their words.

    For tokenizers that never join text across ASCII white space and drop it: the ids of a text are then the ids of
    its words.  Words are told apart by 64-bit hashes, never sorted; each is encoded once while it is remembered, many
    in one call, and its ids are found again by their offsets.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder, self.end = Tokenizer.from_file(path), np.array([end_id], "<u4")
        self._forget()

    def _forget(self) -> None:
        """Row 0 of the remembered ids is the end."""
        self.row: dict[int, int] = {}
        self.flat, self.size = [self.end], [np.ones(1, np.int64)]

    def _learn(self, words: list[str]) -> None:
        """Append the ids of ``words`` to what is remembered."""
        for at in range(0, len(words), AT_ONCE * 64):
            part = words[at : at + AT_ONCE * 64]
            runs = [part[k : k + AT_ONCE] for k in range(0, len(part), AT_ONCE)]
            for run, found in zip(runs, self.encoder.encode_batch([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                begin = np.cumsum([0, *(len(w) + 1 for w in run)])
                starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
                self.flat.append(np.array(found.ids, "<u4"))
                self.size.append(np.bincount(np.searchsorted(begin, starts, "right") - 1, minlength=len(run)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, an end id after each, and where each text's ids begin (and the last end)."""
        words = Words(texts)
        n = len(words.hash)
        coded = pa.array(signed(words.hash), pa.int64()).dictionary_encode()
        distinct, inverse = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.row) + len(distinct) > CACHED_WORDS:
            self._forget()
        row = np.fromiter((self.row.get(h, -1) for h in distinct), np.int64, len(distinct))
        new = np.flatnonzero(row < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[inverse[::-1]] = np.arange(n)[::-1]
            row[new] = len(self.row) + 1 + np.arange(len(new))
            self._learn([words.raw(k).decode() for k in first[new]])
            self.row.update(zip([distinct[k] for k in new], row[new].tolist(), strict=True))
        self.flat, self.size = [np.concatenate(self.flat)], [np.concatenate(self.size)]
        flat, size = self.flat[0], self.size[0]
        begin = np.cumsum(size) - size
        n_docs = len(words.first) - 1
        order = np.insert(row[inverse], words.first[1:], 0)  # an end token after each text's words
        lengths = size[order]
        ends = np.cumsum(lengths)
        source = np.repeat(begin[order] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        stop = ends[words.first[1:] + np.arange(n_docs)]
        return flat[source], np.append(0, stop)


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, end_id: int) -> WordTokenizer:
    """The worker's tokenizer for a file, kept with its remembered words from task to task."""
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


class CapacityTree:
    """How many open windows have each remaining capacity, with the smallest fitting one in log time."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << (top + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that some window has, or -1."""
        k = need + self.leaves
        if self.count[k]:
            return need
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length); all but the last are full.  Items may be longer than the window."""
    done: list[list[tuple[int, int, int]]] = []
    rest = []
    for k, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            done.append([(k, at, window)])
            at += window
        if n > at:
            rest.append((n - at, k, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = CapacityTree(window)
    open_: dict[int, list[list[tuple[int, int, int]]]] = {}
    for n, k, at in rest:
        room = tree.tightest(n)
        if room < 0:
            room, place = window, []
        else:
            place = open_[room].pop()
            tree.add(room, -1)
        place.append((k, at, n))
        if room > n:
            open_.setdefault(room - n, []).append(place)
            tree.add(room - n, 1)
        else:
            done.append(place)
    left = sorted(((room, w) for room, ws in open_.items() for w in ws), key=lambda x: x[0])
    spare: list[tuple[int, int, int]] = []
    low, high = 0, len(left) - 1
    while low <= high:
        room, place = left[low]
        low += 1
        while room:
            if not spare:
                if low > high:
                    return [*done, place]
                spare = left[high][1]
                high -= 1
            k, at, n = spare.pop()
            cut = min(n, room)
            place.append((k, at, cut))
            room -= cut
            if cut < n:
                spare.append((k, at + cut, n - cut))
        done.append(place)
    while spare:
        place, room = [], window
        while spare and room:
            k, at, n = spare.pop()
            cut = min(n, room)
            place.append((k, at, cut))
            room -= cut
            if cut < n:
                spare.append((k, at + cut, n - cut))
        done.append(place)
    return done


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Lay pieces out as sequences whose lengths are powers of two, the longest first."""
    total = sum(n for _, _, n in pieces)
    spare = pieces[::-1]
    out = []
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        place = []
        while size:
            k, at, n = spare.pop()
            cut = min(n, size)
            place.append((k, at, cut))
            size -= cut
            if cut < n:
                spare.append((k, at + cut, n - cut))
        out.append(place)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    ``tokenizer_path`` is a file of the ``tokenizers`` library, at the same place on every executor.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path, end_id)
        base = TaskContext.get().partitionId() << 40
        made = 0
        held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, tokens of the document, ids
        weight = 0

        def emit(windows: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal made
            rows: list[tuple] = []
            for place in windows:
                offset = 0
                for k, at, n in place:
                    doc, start, tokens, ids = held[k]
                    piece = ids[at : at + n]
                    crc = zlib.crc32(piece.astype("<u4").tobytes())
                    rows.append((doc, start + at, n, crc, tokens, base + made, offset, *((piece.tolist(),) if with_ids else ())))
                    offset += n
                made += 1
            columns = list(zip(*rows, strict=True)) or [()] * (8 if with_ids else 7)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        for part in slices(batches, limit=STEP):
            ids, stop = encoder.encode(part.column("text"))
            for d, doc in enumerate(part.column("doc_id").to_pylist()):
                own = ids[stop[d] : stop[d + 1]]
                held.append((doc, 0, len(own), own))
                weight += len(own)
            if weight >= group_tokens:
                *full, last = best_fit([len(x[3]) for x in held], window)
                if sum(n for _, _, n in last) == window:
                    full, last = [*full, last], []
                if full:
                    yield emit(full)
                held = [(held[k][0], held[k][1] + at, held[k][2], held[k][3][at : at + n].copy()) for k, at, n in last]
                weight = sum(len(x[3]) for x in held)
        if held:
            *full, last = best_fit([len(x[3]) for x in held], window)
            yield emit([*full, *powers_of_two(last)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(step, schema)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())
