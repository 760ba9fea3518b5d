"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per text.  Spark counts every token of the training texts, and, over
classes of tokens, every pair at distance one and two.  A class is one of the COMMON commonest words, the end, or the words with a like
ending; so the pair counts are bounded (2 * CLASSES ** 2) however large the corpus, while every training text enters them.

For each distance a log-bilinear model predicts a class from the class at that distance before it: the score of class w after v
is b(w) + r(v) . q(w).  It is trained in numpy by noise-contrastive estimation with the expected noise taken exactly (all classes at
once, noise = class frequencies), by Adam on the whole count table.  One batched matrix product gives the scores of all contexts, and a
softmax over the classes makes them probabilities; the two models are mixed by NEAR, with a small share of the class frequencies.
Within an ending class a word has the share (c + 0.5) / (C + 0.5 (V + 1)), with one such share for all unknown words, so the
probabilities of all tokens add up to one.

Texts are scored by table look-ups.  The counts of the commonest words travel as a table of fixed size; the other tokens are
joined to their counts in Spark, so no count is lost or approximated.

Cases: a null text is empty (its end is its only token); repeated rows count and are scored each; a null ``doc_id`` is
training text; without training texts nothing is known, the base score is 0 and classes are equally likely; an empty table gives no rows;
other columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, signed, slices, table, written

#: Words that are classes of their own, classes of like endings, and words whose counts travel with the tasks.
COMMON, ENDINGS, HEAD = 1024, 255, 65536
CLASSES = COMMON + 1 + ENDINGS
#: Model size and training.
DIM, NOISE, STEPS, RATE, RIDGE = 32, 20, 120, 0.05, 3e-5
#: Weight of the nearer context, and share of the class frequencies in each distribution.
NEAR, FLOOR = 0.75, 0.05
END = np.uint64(0x5BF03635D0E9A1C7)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending class of each token, ends included, and where each text's tokens begin (and the last end)."""
    words = Words(texts, lower=True)
    last = words.data[words.end - 1].astype(np.int64) if len(words.end) else np.zeros(0, np.int64)
    before = np.where(words.end - words.start > 1, words.data[words.end - 2] if len(words.data) > 1 else 0, 0).astype(np.int64) if len(words.end) else last
    ending = (last * 131 + before * 7) % 1021 % ENDINGS
    h = np.insert(words.hash, words.first[1:], END)
    return h, np.insert(ending, words.first[1:], 0), words.first + np.arange(len(words.first))


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, c, ending``: how often each token occurs; combined per slice of texts and again by Spark."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, ending, _ = _tokens(part.column("text"))
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c), pa.array(ending[first].astype(np.int32))], ["h", "c", "ending"])

    rows = docs.select("text").mapInArrow(step, "h long, c long, ending int")
    return rows.groupBy("h").agg(F.sum("c").alias("c"), F.min("ending").alias("ending"))


class Vocabulary:
    """The commonest tokens with their counts, and the classes."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int, ending_total: np.ndarray, ending_distinct: np.ndarray, ending: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.c, self.ending, self.total, self.distinct = h[order], c[order], ending[order], total, distinct
        single = h[h != END][:COMMON]
        at = np.argsort(single)
        self.single, self.single_class = single[at], at.astype(np.int64)
        self.ending_total, self.ending_distinct = ending_total, ending_distinct

    def classes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = COMMON + 1 + ending
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
            out = np.where(self.single[at] == h, self.single_class[at], out)
        return np.where(h == END, COMMON, out)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each token is among the commonest, and its count there."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return known, np.where(known, self.c[at], 0)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Collects ``head`` counts and one sum for each ending."""
    head = max(head, COMMON + 1)
    top = counts.orderBy(F.desc("c"), "h").limit(head).toArrow()
    h, c, ending = (top.column(k).to_numpy() for k in ("h", "c", "ending"))
    h = h.view(np.uint64) if len(h) else np.zeros(0, np.uint64)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        total[r.ending], distinct[r.ending] = r.n, r.v
    alone = np.append(np.flatnonzero(h != END)[:COMMON], np.flatnonzero(h == END))
    np.add.at(total, ending[alone], -c[alone].astype(float))
    np.add.at(distinct, ending[alone], -1)
    return Vocabulary(h, c, sums.n, sums.v, total, distinct, ending)


def class_pairs(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """``pair, n``: how often each class follows each other at distance one and two; a text is preceded by two ends."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, ending, first = _tokens(part.column("text"))
            k = sent.value.classes(h, ending)
            pair, n = np.unique(np.concatenate([v * CLASSES + k + d * CLASSES**2 for d, v in enumerate(_before(k, first))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return docs.select("text").mapInArrow(step, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _before(k: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token."""
    one = np.append(COMMON, k[:-1])
    two = np.append([COMMON, COMMON], k[:-2])[: len(k)]
    one[first[:-1]] = two[first[:-1]] = COMMON
    second = first[:-1] + 1
    two[second[second < first[1:]]] = COMMON
    return one, two


def train(counts: np.ndarray, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """Probabilities of all classes (columns) after all contexts (rows), from their counts."""
    total = np.float32(counts.sum() or 1.0)
    noise = counts.sum(axis=0, dtype=np.float64) + 0.5
    noise = (noise / noise.sum()).astype(np.float32)
    rng = np.random.default_rng(seed)
    p = {"r": rng.normal(0, 0.1, (CLASSES, DIM)), "q": rng.normal(0, 0.1, (CLASSES, DIM)), "b": np.log(noise)}
    p = {k: x.astype(np.float32) for k, x in p.items()}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    data = counts / total
    drawn = NOISE * data.sum(axis=1, keepdims=True) * noise
    lift = np.log(NOISE * noise)
    for t in range(1, steps + 1 if counts.any() else 0):
        real = 1 / (1 + np.exp(-np.clip(p["r"] @ p["q"].T + (p["b"] - lift), -30, 30)))
        g = (drawn + data) * real - data
        grad = {"q": g.T @ p["r"], "b": g.sum(axis=0), "r": g @ p["q"]}
        rate = np.float32(RATE * min(1.0, 2 * (1 - t / (steps + 1))))
        for k in p:
            if k != "b":
                grad[k] += np.float32(RIDGE) * p[k]
            m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * grad[k]
            s[k] = np.float32(0.99) * s[k] + np.float32(0.01) * grad[k] ** 2
            p[k] -= rate * (m[k] / np.float32(1 - 0.9**t)) / (np.sqrt(s[k] / np.float32(1 - 0.99**t)) + np.float32(1e-10))
    score = p["r"] @ p["q"].T + p["b"]
    score -= score.max(axis=1, keepdims=True)
    probability = np.exp(score)
    probability /= probability.sum(axis=1, keepdims=True)
    return (1 - FLOOR) * probability + FLOOR * noise


def train_both(pair: np.ndarray, n: np.ndarray, steps: int = STEPS) -> list[np.ndarray]:
    """The models of distance one and two."""
    out = []
    for d in (0, 1):
        counts = np.zeros(CLASSES**2, np.float32)
        own = pair // CLASSES**2 == d
        counts[pair[own] % CLASSES**2] = n[own]
        out.append(train(counts.reshape(CLASSES, CLASSES), steps).astype(np.float32))
    return out


def score(docs: DataFrame, words: Vocabulary, counts: DataFrame, models: list[np.ndarray]) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row."""
    # what a word's ending class leaves to its words, apart from the word's own count
    share = np.zeros(CLASSES)
    share[COMMON + 1 :] = -np.log10(words.ending_total + 0.5 * (words.ending_distinct + 1))
    sent = docs.sparkSession.sparkContext.broadcast((words, models, share))
    whole = float(np.log10(words.total + 0.5 * (words.distinct + 1)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (near, far), share = sent.value
        at_row = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            h, ending, first = _tokens(part.column("text"))
            k = words.classes(h, ending)
            rest = k > COMMON
            one, two = _before(k, first)
            model = np.log10(NEAR * near[one, k] + (1 - NEAR) * far[two, k]).astype(np.float64) + share[k]
            some, back = np.unique(h, return_inverse=True)
            known, c = words.find(some)
            own = np.where(known, np.log10(c + 0.5), 0.0)
            known, own = known[back], own[back]
            starts = first[:-1]
            tail = signed(h[~known])
            ends = np.cumsum(~known)[first[1:] - 1]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(tail))
            n = np.diff(first)
            columns = {
                "row": pa.array(at_row + np.arange(part.num_rows)),
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "n_tokens": pa.array(n),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                "own": pa.array(np.add.reduceat(own, starts)),
                "own_class": pa.array(np.add.reduceat(np.where(rest, own, 0.0), starts)),
                "model": pa.array(np.add.reduceat(model, starts)),
                "tail": lists,
            }
            at_row += part.num_rows
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, own double, own_class double, model double, tail array<long>"
    rows = written(docs.select("doc_id", "text", "held_out").mapInArrow(step, schema))
    # tokens beyond the commonest; none of them is a class of its own
    tail = rows.select("row", F.explode("tail").alias("h")).join(counts.select("h", "c").hint("merge"), "h", "left")
    tail = tail.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"))
    out = rows.drop("tail").join(tail.hint("merge"), "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"),
        (F.col("own") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("model") + F.col("own_class") + more).alias("score"),
    )


def lm_scores(docs: DataFrame, head: int = HEAD, steps: int = STEPS) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", held_out())
    training = docs.where("not held_out")
    counts = written(token_counts(training))
    words = vocabulary(counts, head)
    # bounded: at most 2 * CLASSES ** 2 counts
    pairs = class_pairs(training, words).toArrow()
    return score(docs, words, counts, train_both(pairs.column("pair").to_numpy(), pairs.column("n").to_numpy(), steps))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
