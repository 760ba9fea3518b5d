"""Substring dedup by difference-cover anchors.

A perfect difference set D modulo V has, for every two positions i and j, a shift below V that brings both
into D.  So if the WINDOW words from i on equal those from j on, the shorter windows of WINDOW - V + 1 words
that start at the shifted places are equal too and both start at cover positions: hashing only the cover
positions (here 5 of 21) loses no match.  Anchors that occur twice are then extended: in the texts that hold
them, every full window around them is hashed and counted.

Equal texts share one ``node`` (a hash of the text), so a large group of copies is extended and marked once.

Cases: a null text has no words; a text shorter than the window keeps all; overlapping repeats inside one text
count; white space between words does not matter; a repeated row counts as another occurrence, whatever its
``doc_id``, which may be null or repeat.  An empty table gives an empty result; other columns are ignored.
Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, signed, slices, table, written

WINDOW = 35
#: Perfect difference set (fixed values): every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def _places(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indexes at which a window of ``width`` words of one text starts, their text and place in it."""
    doc = words.doc_of()
    n = max(0, len(words.hash) - width + 1)
    at = np.arange(n)
    at = at[at + width <= words.first[doc[:n] + 1]] if n else at
    return at, doc[at], at - words.first[doc[at]]


def _cover(place: np.ndarray, period: int, cover: tuple[int, ...]) -> np.ndarray:
    inside = np.zeros(period, bool)
    inside[list(cover)] = True
    return inside[place % period]


def anchors(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """``(h, node)`` for each cover position of each text."""
    width = window - period + 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            at, doc, place = _places(words, width)
            keep = _cover(place, period, cover)
            h = words.windows(width)[at[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), part.column("node").take(pa.array(doc[keep]))], ["h", "node"])

    return docs.select("node", "text").mapInArrow(step, "h long, node long")


def _candidates(matched: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Full windows around repeated anchors: ``(h, node, pos, w)``.  Input: node, text, hs (repeated anchors).

    The merge join leaves equal texts side by side: the first of a run stands for all, with ``w`` 2 if there are more.
    """
    width = window - period + 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            node = part.column("node").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            weight = np.minimum(np.diff(np.append(first, len(node))), 2).astype(np.int8)
            part = part.take(pa.array(first))
            words = Words(part.column("text"))
            at, doc, place = _places(words, width)
            keep = _cover(place, period, cover)
            at, doc = at[keep], doc[keep]
            short = signed(words.windows(width)[at])
            known = part.column("hs")
            sizes = np.diff(known.offsets.to_numpy())
            owner = np.repeat(np.arange(part.num_rows), sizes)
            pairs = _mark(owner, known.flatten().to_numpy(), doc, short)
            hit = at[pairs]
            full, full_doc, full_place = _places(words, window)
            reach = np.zeros(len(words.hash) + 2, np.int64)
            np.add.at(reach, np.maximum(hit - period + 1, 0), 1)
            np.add.at(reach, hit + 1, -1)
            near = np.cumsum(reach)[full] > 0
            full, full_doc, full_place = full[near], full_doc[near], full_place[near]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(words.windows(window)[full])), part.column("node").take(pa.array(full_doc)), pa.array(full_place.astype(np.int32)), pa.array(weight[full_doc])],
                ["h", "node", "pos", "w"],
            )

    return matched.select("node", "text", "hs").mapInArrow(step, "h long, node long, pos int, w byte")


def _mark(owner: np.ndarray, value: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (doc, h) are among the (owner, value)."""
    if not len(value) or not len(h):
        return np.zeros(len(h), bool)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    kind = np.dtype([("d", np.int64), ("h", np.int64)])
    have, want = np.empty(len(owner), kind), np.empty(len(h), kind)
    have["d"], have["h"], want["d"], want["h"] = owner, value, doc, h
    return np.isin(_joined(want), _joined(have))


def _joined(x: np.ndarray) -> np.ndarray:
    """One 64-bit value for a (doc, h) of one slice; a clash only adds a candidate, which is then counted."""
    return x["h"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (x["d"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _cleaned(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """Input: doc_id, text, ps (starts of repeated windows, or null)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            known = part.column("ps")
            n_words, n_removed, digest, kept_text = [], [], [], []
            for d in range(part.num_rows):
                a, b = int(words.first[d]), int(words.first[d + 1])
                starts = known[d].values
                gone = np.zeros(b - a + 1, np.int64)
                if starts is not None and len(starts):
                    s = np.unique(starts.to_numpy())
                    gone[s] += 1
                    ends = s + window
                    gone[ends[ends <= b - a]] -= 1
                keep = np.flatnonzero(np.cumsum(gone[: b - a]) == 0) + a
                kept = b" ".join(words.raw(k) for k in keep)
                n_words.append(b - a)
                n_removed.append(b - a - len(keep))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return docs.mapInArrow(step, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, texts: bool = True) -> DataFrame:
    """Remove from each text the words of every ``window``-word passage that starts anywhere else too.

    Returns ``doc_id, n_words, n_removed, kept_sha256, kept_text``; see the module for the defined cases.
    ``period`` must be below ``window`` and ``cover`` a difference cover of it.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or period > window:
        raise ValueError("cover must be a difference cover of a period of at most window words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("node", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    found = anchors(docs, window, period, cover)
    # written tables, so that the joins with them may be split where a passage is very common
    repeated = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    held = found.join(repeated.hint("merge"), "h").groupBy("node").agg(F.collect_set("h").alias("hs"))
    wide = written(_candidates(docs.join(held.hint("merge"), "node"), window, period, cover))
    again = written(wide.groupBy("h").agg(F.sum("w").alias("n")).where("n > 1").select("h"))
    starts = wide.join(again.hint("merge"), "h").groupBy("node").agg(F.collect_set("pos").alias("ps"))  # at most as many as the text has words, however many copies it has
    return _cleaned(docs.join(starts.hint("merge"), "node", "left").select("doc_id", "text", "ps"), window, texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")
