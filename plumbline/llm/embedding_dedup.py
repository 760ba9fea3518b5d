"""Near-duplicate vectors by spherical-cap filters.

The filters are caps around the words of random product codes: the space is cut into BLOCKS runs of dimensions (after a
random rotation with a fixed seed), each with a code of a few directions, and a filter is one direction of each block.  A
vector belongs to the filters whose direction it exceeds by its own height: that of its EACH-th best word in each of CODES codes,
so every vector has as many filters.  List decoding finds exactly these from the sorted scores of each block: the
n-th best sum uses block ranks whose product is at most n.  Vectors meet where they share a filter and are then
compared exactly, in double precision.

The codes grow with the number of distinct vectors, so that a filter holds a bounded number of unrelated vectors, and with its
logarithm the number of filters of a vector.
Equal vectors are one class with a count, so copies are never paired; a hot filter is dealt out as pairs of
bounded blocks; a pair that shares several filters counts in the smallest only.

Cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing and keep themselves;
vectors of different dimensions do not link; repeated ids are one vector each; labels and other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, pair_cells, table, written
from .jaccard_join import spanning

COSINE = 0.95
BLOCKS = 4
#: Codes, filters of each vector in each code, and unrelated vectors that a filter should hold.
CODES, EACH, LOAD = 2, 10, 32
#: Members of a cell that are compared at once.
CELL = 256


class ProductCode:
    """Random product code for ``dim`` dimensions with about ``n_filters`` words."""

    def __init__(self, dim: int, n_filters: int, each: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.blocks = max(1, min(BLOCKS, dim))
        self.size = max(2, math.ceil(n_filters ** (1 / self.blocks)))
        self.each = min(each, self.size**self.blocks)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cut = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cut, self.cut[1:], strict=False):
            c = rng.standard_normal((self.size, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        ranks = [((), 1)]
        for _ in range(self.blocks):
            ranks = [((*r, k), n * (k + 1)) for r, n in ranks for k in range(min(self.size, self.each // n))]
        self.ranks = np.array([r for r, _ in ranks])

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """For each unit vector the ``each`` filters that it exceeds by most."""
        x = unit @ self.turn
        total, word = np.zeros((len(x), len(self.ranks))), np.zeros((len(x), len(self.ranks)), np.int64)
        for k, c in enumerate(self.codes):
            score = x[:, self.cut[k] : self.cut[k + 1]] @ c.T
            best = np.argsort(-score, axis=1, kind="stable")[:, : self.each]
            total += np.take_along_axis(score, best, 1)[:, self.ranks[:, k]]
            word = word * self.size + best[:, self.ranks[:, k]]
        top = np.argpartition(-total, self.each - 1, axis=1)[:, : self.each]
        return np.take_along_axis(word, top, 1)


def filters_of(unit: np.ndarray, codes: list[ProductCode]) -> np.ndarray:
    """Sorted filters of each vector over all codes; the dimension is part of a filter's number."""
    parts, base = [], 0
    for c in codes:
        parts.append(c.decode(unit) + base)
        base += c.size**c.blocks
    return np.sort(np.concatenate(parts, axis=1) * 65536 + unit.shape[1] % 65536, axis=1)


def _memberships(classes: DataFrame, n_filters: int, each: int, n_codes: int) -> DataFrame:
    """``group, rep, n, embedding, filters``: each class in each of its filters."""
    kind = classes.schema["embedding"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                vectors = [np.asarray(v, np.float64) for v in part.column("embedding").to_pylist()]
                for dim in sorted({len(v) for v in vectors}):
                    which = np.array([k for k, v in enumerate(vectors) if len(v) == dim])
                    x = np.stack([vectors[k] for k in which])
                    if dim not in codes:
                        codes[dim] = [ProductCode(dim, n_filters, each, seed) for seed in range(n_codes)]
                    found = filters_of(x / _norm(x), codes[dim])
                    held = part.take(pa.array(np.repeat(which, found.shape[1])))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size * found.shape[1] + 1, found.shape[1], dtype=np.int32)), pa.array(np.repeat(found, found.shape[1], axis=0).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), held.column("rep"), held.column("n"), held.column("embedding"), lists], ["group", "rep", "n", "embedding", "filters"])

    return classes.select("rep", "n", "embedding").mapInArrow(step, f"group long, rep long, n long, embedding {kind}, filters array<long>")


def _norm(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return np.sqrt(np.sum(x * x, axis=1, keepdims=True)) * top


def _links(cosine: float):
    """For one bounded cell: links of each class, counted in the smallest filter that the two share, and a forest."""

    def step(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        group = cell.column("group")[0].as_py()
        rep = cell.column("rep").to_numpy()
        weight = cell.column("n").to_numpy()
        block = cell.column("block").to_numpy()
        two = cell.column("cell_a")[0].as_py() != cell.column("cell_b")[0].as_py()
        x = np.stack([np.asarray(v, np.float64) for v in cell.column("embedding").to_pylist()])
        x /= _norm(x)
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if two:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(near))
        filters = cell.column("filters").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)  # one dimension, so of one length
        mine = first_shared(filters, a, b) == group
        a, b = a[mine], b[mine]
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
        own = np.zeros_like(near)
        own[a, b] = own[b, a] = True
        s, t = spanning(own)
        some = np.flatnonzero(n)
        return pa.table({
            "a": pa.array(np.concatenate([rep[some], rep[s]]), pa.int64()),
            "b": pa.array(np.concatenate([rep[some], rep[t]]), pa.int64()),
            "n": pa.array(np.concatenate([n[some], np.zeros(len(s), np.int64)]), pa.int64()),
        })

    return step


def first_shared(filters: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    """The smallest filter that the rows of each pair share, or the largest number, in blocks of pairs."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for at in range(0, len(a), step):
        x, y = filters[a[at : at + step]], filters[b[at : at + step]]
        shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[at : at + step] = np.where(shared, x, none).min(axis=1)
    return out


def filters_each(total: int, each: int = EACH) -> int:
    """Filters of a vector in each code: more for more vectors, since the words of a larger code lie closer together."""
    return max(each, math.ceil(each * (math.log10(max(10, total)) - 3) / 3))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, each: int = EACH, load: int = LOAD, n_codes: int = CODES, cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row; links have a cosine of at least ``cosine``."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("embedding", F.when(usable, F.col("embedding"))).withColumn("key", F.xxhash64("embedding"))
    # equal vectors: grouped by hash and vector, so that the shuffle carries each vector once per task
    classes = written(rows.where("embedding is not null").groupBy("key", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("rep is not null"))
    total = classes.count()
    each = filters_each(total, each)
    members = written(_memberships(classes, max(16, total * each // load), each, n_codes))
    links = pair_cells(members, "group", "rep", cell).groupBy("group", "cell_a", "cell_b").applyInArrow(_links(cosine), "a long, b long, n long")
    links = written(links)
    counted = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("other_links"))
    roots = components(links.where("n = 0").select("a", "b"))
    # classes are found again by their first id
    named = rows.join(classes.select("key", F.col("embedding").alias("same"), "rep", "n").hint("merge"), "key", "left").where("same is null or embedding is null or same = embedding")
    named = named.join(counted.hint("merge"), F.col("rep") == F.col("a"), "left").join(roots.hint("merge"), F.col("rep") == F.col("id"), "left")
    component = F.coalesce("root", "rep", "vec_id")
    return named.select(
        "vec_id",
        (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("other_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
