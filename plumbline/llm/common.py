"""Shared pieces: scratch tables, word hashing over Arrow buffers, pair cells and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is cut at white space.
STEP_BYTES = 1 << 20
#: Rows of two numbers that may be broadcast, after counting them.
SHORT_LIST = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as Parquet to the shared folder and read back.

    It cuts lineage, gives Spark true sizes and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/plumbline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words -----------------------------------------------------------------------------------


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = base, np.uint64(_inverse(int(base)))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = (self._run(b, size) for b in (self.base, self.inv))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(b: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WORD_BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words (runs without ASCII white space) of some texts: 64-bit hashes and byte spans.

    ``first[d]:first[d + 1]`` are the words of text ``d``; ``start``/``end`` index ``data``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if pa.types.is_large_string(texts.type):
            offs = np.frombuffer(texts.buffers()[1], np.int64)
        else:
            offs = np.frombuffer(texts.buffers()[1], np.int32)
        offs = offs[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = data[offs[0] : offs[-1]]
        self.offs = offs - offs[0]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        n = len(data)
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        before = np.ones(n, bool)
        after = np.ones(n, bool)
        if n:
            before[1:] = gap[:-1]
            after[:-1] = gap[1:]
        word = ~gap
        self.start = np.flatnonzero(word & (before | cut[:-1]))
        self.end = np.flatnonzero(word & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.offs)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at, n = 0, len(self.start)
        while at < n:
            base = int(self.start[at])
            stop = max(at + 1, int(np.searchsorted(self.end, base + STEP_BYTES, "right")))
            s, e = self.start[at:stop] - base, self.end[at:stop] - base
            size = int(e[-1])
            up, down = _BYTE_POWERS.get(size + 1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum((self.data[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
            out[at:stop] = mixed((total[e] - total[s]) * down[s])
            at = stop
        return out

    def windows(self, width: int) -> np.ndarray:
        """A hash for each word position: of the ``width`` words from it on, whatever text they are in."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.uint64)
        out = np.empty(n - width + 1, np.uint64)
        step = 1 << 18
        for at in range(0, len(out), step):
            stop = min(at + step, len(out))
            h = self.hash[at : stop + width - 1]
            up, down = _WORD_POWERS.get(len(h) + 1)
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[: len(h)], out=total[1:])
            k = np.arange(stop - at)
            out[at:stop] = mixed((total[k + width] - total[k]) * down[k])
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def raw(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- pairs within groups -----------------------------------------------------------------------


def pair_cells(rows: DataFrame, group: str, member: str, limit: int) -> DataFrame:
    """Deal out the members of each group so that every two of them meet in one bounded cell.

    A group of up to ``limit`` members is one cell.  A larger one is split by hash into blocks of about
    ``limit`` and each two blocks form a cell, so a hot group becomes many tasks of one size and none of its
    pairs is made as a row.  Adds ``cell_a``, ``cell_b`` (the cell is group, cell_a, cell_b) and ``block``; in
    a cell with ``cell_a < cell_b`` only members of different blocks are still to be compared.

    The members of large groups stay where they are: there is at most one such group for ``limit`` rows, so the list of them
    is counted and, if it is short, broadcast.  ``rows`` is read three times and should be a written table.
    """
    sizes = written(rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1"))
    large = sizes.where(F.col("_n") > limit)
    way = "broadcast" if large.count() <= SHORT_LIST else "merge"
    alone = rows.join(large.select(group).hint(way), group, "left_anti").join(sizes.where(F.col("_n") <= limit).select(group).hint("merge"), group)
    alone = alone.select("*", *(F.lit(0).alias(c) for c in ("block", "cell_a", "cell_b")))
    dealt = rows.join(large.hint(way), group).withColumn("_k", F.ceil(F.col("_n") / F.lit(limit)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.col("_k")).cast("int"))
    cells = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    cells = cells.select("*", F.least("block", "_other").alias("cell_a"), F.greatest("block", "_other").alias("cell_b")).drop("_n", "_k", "_other")
    return alone.unionByName(cells)


# --- connected components ----------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """The smallest id that each node of an undirected edge list can reach: ``(id, root)``.

    Alternates large-star and small-star steps (Kiveris et al. 2014).  Each step takes a minimum per node,
    which combines map-side, and joins it back by a merge join that may be split where a node is hot.  Every
    round is written to the shared folder.  Nulls and loops are ignored; no edges give no rows.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    )
    if now.isEmpty():
        return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = written(small.distinct())
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components: no fixed point")
    pairs = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return pairs.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over 0..n-1 for use inside one bounded cell."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


