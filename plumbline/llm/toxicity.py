"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over all ordered triples of characters that occur in both with at most GAP characters
skipped, the product of their decays DECAY ** span, and is normalised.  Insults are thus met with inserted
characters, in inflected forms and inside longer words.  Runs of single characters ("i d i o t") count as one word,
and a word with other characters inside also counts with its letters alone.

The machine is trained on labelled texts, LABELLED at most, by hash of the id.  A text scores what its worst word scores, and the
hinge is on the texts' labels (a latent machine, as for multiple instances): first every word takes the label of its
text, weighted by how many texts hold it; then, ROUNDS times, each toxic text is represented by the word that scores highest in it, and each
clean text by its highest ones, which gather from round to round.  The landmarks are words of the training texts: those whose
share of toxic texts stands out, later the words that represent toxic texts, and the commonest words.  Words that represent a toxic
text are also shown with an inserted character.  A logistic curve over the texts' scores, weighted back to
the share of toxic texts among all labelled ones, makes a probability.  Since the machine is linear in the kernel, its landmarks fold
into one weight for each hashed triple, and a whole text is scored by table look-ups.

Cases: null, blank and unlabelled texts are scored like any other (a text without words gets the sample's lowest
score); without both labels in the sample every score is the share of toxic rows in it (0 where there are
none); a word of more than LONG characters counts as its overlapping runs of LONG characters; repeated rows are scored alike; an empty
table gives no rows; only the text enters a score.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, slices, table

#: Labelled documents that training takes at most.
LABELLED = 3000
LANDMARKS, GAP, DECAY = 384, 2, 0.8
#: Words of each label that the first round takes, and rounds after it.
WORDS, ROUNDS = 6000, 5
#: Characters of a word, and of the words that are scored at once.
LONG, STEP_CHARS = 200, 1 << 16
#: What the curve sees of a text, and words whose kernel rows are computed at once.
POOLED, KERNEL_ROWS = 6, 100
#: Hashed triples.
BITS = 18
CUT = 0.3

_RUN = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_WORD = re.compile(r"\S+")
_BROKEN = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_EDGE = "\"'.,;:!?()[]{}<>«»“”„‘’…-_*/\\|~`"


def words_of(text: str | None) -> set[str]:
    """Lower-cased words without punctuation at their ends, runs of single characters joined, broken words mended."""
    low = (text or "").lower()
    found = set(_WORD.findall(low))
    found.update("".join(m.split()) for m in _RUN.findall(low))
    out = {w.strip(_EDGE) for w in found}
    out.update([_NO_LETTER.sub("", w) for w in out if _BROKEN.search(w)])
    out.discard("")
    for w in [w for w in out if len(w) > LONG]:
        out.discard(w)
        out.update(w[k : k + LONG] for k in range(0, len(w), LONG // 2))
    return {sys.intern(w) for w in out}


def _spans() -> list[tuple[int, int, float]]:
    return [(a, b, DECAY ** (b + 1)) for b in range(2, 3 + GAP) for a in range(1, b)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, hashed triple and decay of every triple; a word is framed by two edge characters."""
    text = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[word] - np.arange(len(chars))  # characters of the word from here on
    out = []
    for a, b, decay in _spans():
        at = np.flatnonzero(left > b)
        key = mixed(chars[at] * np.uint64(0x9E3779B97F4A7C15) + mixed(chars[at + a] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(chars[at + b])))
        out.append((word[at], (key >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(at), decay)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if words else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _summed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, hashed triple and normalised weight, each triple of a word once, in order of words."""
    w, k, d = triples(words)
    pair = w * (1 << BITS) + k
    order = np.argsort(pair, kind="stable")
    pair, d = pair[order], d[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, int)
    total = np.add.reduceat(d, first) if len(first) else np.zeros(0)
    word, key = pair[first] >> BITS, pair[first] & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(word, total * total, len(words)))
    return word, key, total / np.maximum(norm[word], 1e-12)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel between two lists of words."""
    word, key, value = _summed(right)
    keys, at = np.unique(key, return_inverse=True)
    table_ = np.zeros((len(keys) + 1, len(right)), np.float32)
    table_[at, word] = value
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(left), KERNEL_ROWS):
        word, key, value = _summed(left[a : a + KERNEL_ROWS])
        at = np.searchsorted(keys, key)
        known = keys[np.minimum(at, len(keys) - 1)] == key
        at = np.where(known, at, len(keys))
        if len(word):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            out[word[first] + a] = np.add.reduceat(table_[at] * value[:, None].astype(np.float32), first, axis=0)
    return out


class Machine:
    """Weights of hashed triples, a bias, and the logistic curve over what a text's words score."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray) -> None:
        self.weights, self.bias, self.curve = weights.astype(np.float32), bias, curve
        self.seen: dict[str, float] = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        ends = np.cumsum([len(w) for w in words])
        at = 0
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_CHARS, "right")))
            word, key, value = _summed(words[at:stop])
            out[at:stop] += np.bincount(word, value * self.weights[key], stop - at)
            at = stop
        return out

    def pooled(self, bags: list[set[str]]) -> np.ndarray:
        """Pooled word scores of each text; every distinct word is scored once while it is remembered."""
        new = list(set().union(*bags) - self.seen.keys()) if bags else []
        if len(self.seen) + len(new) > 150_000:
            self.seen.clear()
            new = list(set().union(*bags))
        self.seen.update(zip(new, self.word_scores(new).tolist(), strict=True))
        return np.array([_pooled(np.array([self.seen[w] for w in b])) for b in bags]).reshape(len(bags), POOLED)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic."""
        return _curve(self.pooled([words_of(t) for t in texts]), self.curve)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}


def _pooled(score: np.ndarray) -> np.ndarray:
    """The three highest word scores, how much lies above the border, and its share of the words; and a constant."""
    best = np.full(3, -1.0)
    top = np.sort(np.clip(score, -1, 1.5))[: -4 : -1]
    best[: len(top)] = np.maximum(top, -1)
    above = float(np.clip(score, 0, 1).sum())
    return np.array([*best, np.log1p(above), 10 * above / (len(score) + 20), 1.0])


def _curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2e-3, steps: int = 12) -> np.ndarray:
    """Linear machine of squared hinge loss, by Newton steps over the points inside the margin; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(len(w))
    for _ in range(steps):
        inside = np.flatnonzero(y * (x @ w.astype(np.float32)) < 1)
        part = x[inside] * np.sqrt(2 * weight[inside]).astype(np.float32)[:, None]
        new = np.linalg.solve((part.T @ part).astype(np.float64) + eye, part.T.astype(np.float64) @ (np.sqrt(2 * weight[inside]) * y[inside]))
        if np.abs(new - w).max() < 1e-4 * (1 + np.abs(w).max()):
            break
        w = new if not w.any() else (w + 2 * new) / 3
    return w


def _with_insertions(words: list[str]) -> list[str]:
    """Each word and a few forms of it with a character put in or doubled, the same each time."""
    out = []
    for w in words:
        out.append(w)
        for k in range(1, min(len(w), 4)):
            at = 1 + (zlib.crc32(w.encode()) + k) % max(1, len(w) - 1)
            out.append(w[:at] + ("x" if k == 1 else "*" if k == 2 else w[at - 1]) + w[at:])
    return out


def train(texts: list[str | None], toxic: list[int], share: float | None = None) -> Machine:
    """Fit a machine on labelled texts; see the module.  ``share`` is that of toxic texts where these were drawn from.

    The curve is fitted on scores that each half of the texts gets from a machine of the other half.
    """
    y = np.array(toxic, int)
    own = float(y.mean()) if len(y) else 0.0
    share = own if share is None else share
    bags = [words_of(t) for t in texts]
    half = np.array([zlib.crc32("\n".join(sorted(b)[:3]).encode()) >> 8 & 1 for b in bags], bool)  # near copies mostly stay together
    if min(y[half].sum(), y[~half].sum()) < 3 or min((1 - y[half]).sum(), (1 - y[~half]).sum()) < 3:
        half = np.arange(len(y)) % 2 > 0
    if not 0 < own < 1 or len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        return Machine(np.zeros(1 << BITS), 0.0, np.append(np.zeros(POOLED - 1), np.log(max(own, 1e-9) / max(1 - own, 1e-9))))
    x = np.zeros((len(y), POOLED))
    for side in (half, ~half):
        other = _latent([b for b, h in zip(bags, side, strict=True) if not h], y[~side])
        x[side] = other.pooled([b for b, h in zip(bags, side, strict=True) if h])
        del other  # with the words it remembers
    machine = _latent(bags, y)
    machine.curve = _logistic(x, y, np.where(y == 1, share / own, (1 - share) / (1 - own)))
    return machine


def _latent(bags: list[set[str]], y: np.ndarray) -> Machine:
    """The word machine of some labelled texts."""
    names = sorted(set().union(*bags), key=lambda w: (zlib.crc32(w.encode()), w))
    at = {w: k for k, w in enumerate(names)}
    held = [np.array(sorted(at[w] for w in b), np.int64) for b in bags]
    groups = _copies(held, y)
    many = np.zeros((2, len(names)))
    for k in groups:
        many[y[k], held[k]] += 1
    count = [max(1, sum(y[k] == v for k in groups)) for v in (0, 1)]
    rate = many / np.array(count)[:, None]
    stands_out = (rate[1] - rate[0]) / np.sqrt(rate.sum(axis=0) / 2 / count[1] + 1 / count[1] ** 2)
    common = [names[k] for k in np.argsort(-many[0], kind="stable")[:WORDS] if many[0, k]]
    marked = _spread([names[k] for k in np.argsort(-stands_out, kind="stable")[: 20 * LANDMARKS]], LANDMARKS * 3 // 4)
    plus = np.flatnonzero(many[1])
    plus = plus[np.argsort(-stands_out[plus], kind="stable")][: WORDS // 4]
    minus = np.unique(np.append([at[w] for w in common[: WORDS // 2]], np.flatnonzero(many[0])[: WORDS // 2]).astype(np.int64))
    machine = _fit(marked, common, [names[k] for k in plus], many[1, plus] * stands_out[plus].clip(0.1), [names[k] for k in minus], many[0, minus])
    likely = rate[1] > 2 * rate[0]  # what clean texts hold about as often does not represent a toxic one
    plain = {names[k]: 0.2 for k in minus[: WORDS // 2]}
    hard: Counter = Counter()
    for _ in range(ROUNDS):
        score = machine.word_scores(names)
        worst: Counter = Counter()
        for k in groups:
            order = held[k][np.argsort(-score[held[k]], kind="stable")]
            if y[k]:
                worst.update(names[i] for i in order[likely[order]][:1])
            else:
                hard.update(names[i] for i in order[:4] if score[i] > -1)
        marked = _spread([w for w, _ in sorted(worst.items(), key=lambda x: (-x[1], x[0]))], LANDMARKS // 2)
        marked += _spread([w for w, _ in sorted(hard.items(), key=lambda x: (-x[1], x[0]))], LANDMARKS // 3)
        shown = _with_insertions(list(worst))
        weight = np.array([float(worst[w]) if w in worst else 0.25 for w in shown])
        against = plain | {w: float(min(n, 30)) for w, n in hard.most_common(WORDS)}
        machine = _fit(list(dict.fromkeys(marked)), common, shown, weight, list(against), np.array(list(against.values())))
    return machine


def _copies(held: list[np.ndarray], y: np.ndarray) -> list[int]:
    """One text of each set of near copies, which mostly share their first words by hash; texts without words are left out."""
    first: dict[tuple, int] = {}
    for k, h in enumerate(held):
        if len(h):
            first.setdefault((*h[:3].tolist(), int(y[k])), k)
    return list(first.values())


def _fit(marked: list[str], common: list[str], plus: list[str], plus_weight: np.ndarray, minus: list[str], minus_weight: np.ndarray) -> Machine:
    """A machine from weighted words of either side; both sides weigh alike."""
    landmarks = list(dict.fromkeys(marked + common[: LANDMARKS - len(marked)]))
    whiten = _whitener(kernel(landmarks, landmarks)).astype(np.float32)
    x = np.hstack([kernel(plus + minus, landmarks).astype(np.float32) @ whiten, np.ones((len(plus) + len(minus), 1), np.float32)])
    side = np.append(np.ones(len(plus)), -np.ones(len(minus)))
    weight = np.append(plus_weight / plus_weight.sum(), minus_weight / minus_weight.sum())
    w = _hinge(x, side, weight)
    return _folded(landmarks, whiten @ w[:-1], float(w[-1]))


def _spread(words: list[str], n: int, alike: int = 4) -> list[str]:
    """The first words, but few that begin alike, so that they cover different stems."""
    taken, heads = [], Counter()
    for w in words:
        if heads[w[:4]] < alike and len(taken) < n:
            heads[w[:4]] += 1
            taken.append(w)
    return taken


def _whitener(k: np.ndarray) -> np.ndarray:
    """The inverse square root of the landmarks' kernel (the Nystroem map)."""
    value, vector = np.linalg.eigh(k.astype(np.float64))
    keep = value > 1e-6 * value.max()
    return vector[:, keep] / np.sqrt(value[keep])


def _folded(landmarks: list[str], alpha: np.ndarray, bias: float) -> Machine:
    weights = np.zeros(1 << BITS)
    word, key, value = _summed(landmarks)
    np.add.at(weights, key, value * alpha[word])
    return Machine(weights, bias, np.zeros(POOLED))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic curve with Platt's smoothed targets, by Newton steps; only the constant may be negative and is not held down."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, held = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    held[-1, -1] = 1e-3
    for _ in range(steps):
        p = _curve(x, w)
        grad = x.T @ (weight * (p - target)) + held @ w
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + held, grad).clip(-4, 4)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[list[str | None], list[int], float | None]:
    """Texts and labels of at most ``most`` labelled documents, clean and toxic half each if there are as many, and the
    share of toxic ones among all labelled documents."""
    ids = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    ids = ids.join(docs.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    texts = []
    for kind in (0, 1):
        order = F.xxhash64(F.lit(3), "doc_id")
        some = ids.where(F.col("toxic") == kind).orderBy(order).limit(most // 2)
        # at most ``most`` short ids: a proven bound
        texts.append(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic"))
    rows = texts[0].unionByName(texts[1]).orderBy(F.xxhash64("text"), "text").collect()
    return [r.text for r in rows], [r.toxic for r in rows], ids.agg(F.avg("toxic")).first()[0]


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = sent.value.scores(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(step, "doc_id long, score double")


def filtered(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            p = sent.value.scores(part.column(at).to_pylist())
            yield part.filter(pa.array(p < cut))

    return plain.mapInArrow(step, plain.schema).toDF(*names)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels are learnt only from rows that are not held out."""
    scored = score(docs, train(*labelled_sample(docs.where(~held_out()), labels)))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
