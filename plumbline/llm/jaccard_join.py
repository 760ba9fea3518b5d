"""Exact n-gram Jaccard join by pivots, regions and triangle-inequality windows.

1. Texts with the same shingle set form one class; only classes go on.
2. Regions.  Documents are ringed by set size (distance from the empty set), each ring's border reaching into the
   next.  Within a ring the shingle universe is cut into more parts than two linked sets can differ in, so
   linked sets agree exactly on some part that is not empty.  The smallest class of each such part is its pivot; documents joined
   to common pivots form a region, and no link leaves its region.  (Unrelated texts all have distance 1 from any
   pivot text, so distances alone cannot open the first regions.)
3. A region that is too large gets pivots of its own.  Each member goes to its nearest pivot's cell and, as a
   window, to every cell whose pivot is at most 2 * radius further: if d(x, y) <= r and x's nearest pivot is p,
   then d(y, p) <= d(y, nearest of y) + 2r.  Cells that are still too large and did shrink are cut again; the
   rest are dealt out as pairs of bounded blocks.
4. Each bounded cell compares its sets exactly and returns a spanning forest of its links; their connected
   components are the groups.

Cases: a null or blank text has an empty set and links with nothing; fewer words than the shingle width make the
whole sequence one shingle; repeated rows are copies; rows that share a ``doc_id`` but not their text are compared by their own texts;
a null ``doc_id`` takes part and gets its group's component, null if no id is in the group; empty tables
give empty results; other columns are ignored.  Texts, shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SHORT_LIST, Words, components, mixed, pair_cells, signed, slices, table, written

#: Members of a cell that are compared at once.
CELL = 256
#: Pivots for each cut of a large region, and cuts before the rest goes to block pairs.
PIVOTS, CUTS = 8, 2
#: Tasks that share the reading of a large region, and sampled texts among which a signature counts as common.
SALTS, ONE_IN, OFTEN = 16, 16, 50


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    grams = words.windows(width)
    out = []
    for d in range(len(words.first) - 1):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = mixed(short * np.uint64(31) + words.hash[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Rings:
    """Size rings for a threshold of ``percent``, and the most that two linked sets of a ring can differ in."""

    def __init__(self, percent: int, common: np.ndarray | None = None) -> None:
        self.percent, self.top, self.differ = percent, [], []
        self.common = common

    def ring(self, n: int) -> int:
        while not self.top or self.top[-1] < n:
            top = ((self.top[-1] if self.top else 0) + 1) * 100 // self.percent
            most = top + top * 100 // self.percent
            self.top.append(top)
            self.differ.append(most * (100 - self.percent) // (100 + self.percent))
        return int(np.searchsorted(self.top, n))

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Hashes of the set's parts, for its own ring and as the larger partner of the ring below.

        Two linked sets differ in at most d members.  A set with more than d parts that are not empty therefore shares one of
        these with each partner, so empty parts count only for sets with fewer.  The same holds for the members that
        are not common; all members count only for sets that have too few parts of those.
        """
        i = self.ring(len(shingles))
        out = []
        for k in (i, i - 1) if i else (i,):
            d = self.differ[k]
            m = (d + 1) * 115 // 100 + 4
            if self.common is not None and len(self.common):
                at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
                total, filled = _parts(shingles[self.common[at] != shingles], m)
                out.append(_named(total, filled, 2 * k))
                if filled.sum() > d:
                    continue
            total, filled = _parts(shingles, m)
            out.append(_named(total, filled if filled.sum() > d else np.ones(m, bool), 2 * k + 1))
        return np.concatenate(out)


def _parts(shingles: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    total, filled = np.zeros(m, np.uint64), np.zeros(m, bool)
    at = (shingles % np.uint64(m)).astype(np.int64)
    np.add.at(total, at, mixed(shingles + np.uint64(0x5851F42D4C957F2D)))
    filled[at] = True
    return total, filled


def _named(total: np.ndarray, which: np.ndarray, kind: int) -> np.ndarray:
    part = np.flatnonzero(which).astype(np.uint64)
    return mixed(total[which] ^ mixed((np.uint64(kind) << np.uint64(32)) + part))


def common_shingles(docs: DataFrame, width: int, one_in: int = 8, least: int = 4, most: int = 300_000) -> np.ndarray:
    """Hashes of shingles that many texts hold, from one text in ``one_in``: at most ``most``.

    They only steer which parts are compared; any list gives the same links.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, n = np.unique(np.concatenate(shingle_sets(part.column("text"), width)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], ["h", "n"])

    some = docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(one_in)) == 0).select("text")
    often = some.mapInArrow(step, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = often.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _class_of(shingles: np.ndarray) -> int:
    return int(signed(mixed(np.array([np.sum(mixed(shingles), dtype=np.uint64) + np.uint64(len(shingles))])))[0])


def _classes(docs: DataFrame, width: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64())],
                ["doc_id", "text_key", "n_shingles", "node"],
            )

    return docs.mapInArrow(step, "doc_id long, text_key long, n_shingles long, node long")


def _signatures(docs: DataFrame, width: int, percent: int, common: np.ndarray | None) -> DataFrame:
    """``(sig, node)``, without repeats within a slice."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # a list of a fixed size

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = Rings(percent, sent.value)
        for part in slices(batches):
            sigs, nodes, seen = [], [], set()
            for s in shingle_sets(part.column("text"), width):
                if len(s) and (node := _class_of(s)) not in seen:
                    seen.add(node)
                    sigs.append(rings.signatures(s))
                    nodes.append(np.full(len(sigs[-1]), node, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(nodes))], ["sig", "node"])

    return docs.mapInArrow(step, "sig long, node long")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """Input: region, node, text.  Output: region, node and the set as 64-bit values."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("region"), part.column("node"), pa.array(sets, pa.binary())], ["region", "node", "shingles"])

    return rows.select("region", "node", "text").mapInArrow(step, "region long, node long, shingles binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def _cut(rows: DataFrame, percent: int) -> DataFrame:
    """Deal each region's members to the cells of its pivots, with windows; regions become cells."""
    radius = (100 - percent) / 100
    order = F.xxhash64(F.lit(11), "node")
    lots = rows.groupBy("region", F.pmod(order, F.lit(PIVOTS)).alias("lot")).agg(F.min_by(F.struct("node", "shingles"), order).alias("p"))
    # each region's pivots in SALTS copies, so that a large region is read by as many tasks
    pivots = lots.groupBy("region").agg(F.collect_list("p").alias("ps")).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(13), "node"), F.lit(SALTS)).cast("int"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, ids, sets = [], [], []
            for r, d, s, ps in zip(*(batch.column(c).to_pylist() for c in ("region", "node", "shingles", "ps")), strict=True):
                x = np.frombuffer(s, np.uint64)
                far = []
                for p in ps:
                    y = np.frombuffer(p["shingles"], np.uint64)
                    both = _overlap(x, y)
                    far.append(1 - both / (len(x) + len(y) - both))
                near = min(far)
                for f, p in zip(far, ps, strict=True):
                    if f <= near + 2 * radius + 1e-9:
                        region.append(int(signed(mixed(np.array([(r * 31 + p["node"] * 2 + 1) % (1 << 64)], np.uint64)))[0]))
                        ids.append(d)
                        sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["region", "node", "shingles"])

    return salted.join(pivots.hint("merge"), ["region", "salt"]).mapInArrow(step, "region long, node long, shingles binary")


def _forest(percent: int):
    """Exact links of one bounded cell, as a spanning forest."""

    def step(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids = cell.column("node").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        block = cell.column("block").to_numpy()[first]
        two = cell.column("cell_a")[0].as_py() != cell.column("cell_b")[0].as_py()
        raw = cell.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[k], np.uint64) for k in first]
        size = np.array([len(s) for s in sets])
        both = shared_counts(sets)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        if two:
            linked &= block[:, None] != block[None, :]
        a, b = spanning(linked)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return step


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, by blocked matrix products over members held at least twice."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[column] > 1
    label = np.cumsum(count > 1) - 1
    owner, column = owner[often], label[column[often]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    wide = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        hold = np.zeros((n, wide), np.float32)
        hold[owner[lo:hi], column[lo:hi] - at] = 1
        out += hold @ hold.T
    return np.rint(out).astype(np.int64)


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix, by breadth-first search."""
    n = len(linked)
    open_ = np.ones(n, bool)
    a, b = [], []
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        front = [root]
        while front:
            k = front.pop()
            new = np.flatnonzero(linked[k] & open_)
            open_[new] = False
            a += [k] * len(new)
            b += new.tolist()
            front += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _stars(signatures: DataFrame, hot: DataFrame) -> DataFrame:
    """Each class beside the smallest of a signature that it has: ``node, pivot``.

    ``hot``: a bounded list of signatures, whose smallest class is found map-side and sent to their rows; the rest is
    sorted by signature.  Any list gives the same rows.
    """
    known = [r.sig for r in hot.collect()]
    mark = F.col("sig").isin(known) if known else F.lit(False)
    pivot = F.first("node").over(Window.partitionBy("sig").orderBy("node"))
    rest = signatures.where(~mark).withColumn("pivot", pivot).where("node > pivot").select("node", "pivot")
    if not known:
        return rest
    often = signatures.where(mark)
    low = often.groupBy("sig").agg(F.min("node").alias("pivot"))
    return rest.unionByName(often.join(F.broadcast(low), "sig").where("node > pivot").select("node", "pivot"))


def _hot(docs: DataFrame, width: int, percent: int, common: np.ndarray | None, most: int = 100) -> DataFrame:
    """At most ``most`` signatures that are common in one text of ONE_IN; they only steer how classes are brought together."""
    some = docs.where(F.pmod(F.xxhash64(F.lit(17), "text_key"), F.lit(ONE_IN)) == 0)
    return _signatures(some, width, percent, common).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "sig").limit(most).select("sig")


def groups_of_rows(docs: DataFrame, width: int = 3, percent: int = 90, cell: int = CELL, set_common_aside: bool = False) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, root, component_id`` for each row.

    ``node`` is the class of the row's set (null for an empty one), ``root`` the smallest class of its group, ``text_key`` a hash of its text.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    members = written(_classes(docs, width))
    first = written(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key")))
    common = common_shingles(docs, width) if set_common_aside else None
    star = _stars(_signatures(docs, width, percent, common), _hot(docs, width, percent, common))
    regions = components(star, "node", "pivot")
    held = first.join(regions.hint("merge"), first.node == regions.id).select(F.col("root").alias("region"), "node", "text_key")
    rows = written(_sets(docs.select("text_key", "text").dropDuplicates(["text_key"]).join(held.hint("merge"), "text_key"), width))
    done = None
    for _ in range(CUTS):
        large = written(rows.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("region"))
        found = large.count()
        if not found:
            break
        large = large.hint("broadcast" if found <= SHORT_LIST else "merge")
        small = rows.join(large, "region", "left_anti")
        done = small if done is None else done.unionByName(small)
        rest = rows.join(large, "region", "left_semi")
        cut = written(_cut(rest, percent))
        rows = cut if cut.count() < 2 * rest.count() else rest
        if rows is not cut:
            break
    rows = written(rows if done is None else done.unionByName(rows))
    links = pair_cells(rows, "region", "node", cell).groupBy("region", "cell_a", "cell_b").applyInArrow(_forest(percent), "a long, b long")
    named = first.join(components(links).hint("merge"), F.col("node") == F.col("id"), "left").select("node", F.coalesce("root", "node").alias("root"), "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.select("node", "root").join(least.hint("merge"), "root")
    out = members.join(named.hint("merge"), "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", "node", "root", F.coalesce("component_id", alone).alias("component_id"))


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90, cell: int = CELL, set_common_aside: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked where 100 * shared >= percent * union.

    ``component_id`` is the smallest ``doc_id`` reachable by links, the document's own included.  With low thresholds parts are
    small; ``set_common_aside`` then keeps texts that share only widespread passages out of each other's regions.
    """
    return groups_of_rows(docs, width, percent, cell, set_common_aside).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, width: int, percent: int, set_common_aside: bool = True) -> DataFrame:
    """The row with the smallest ``doc_id`` (then text hash) of each group of linked texts, all columns kept.

    Rows without words are in no group: one row of each id and text stays.  An id that names texts of several groups stays in each.
    """
    rows = groups_of_rows(docs, width, percent, set_common_aside=set_common_aside)
    row_key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    linked = rows.where("node is not null").groupBy("root").agg(F.min_by(row_key, order).alias("_row"))
    kept = written(linked.select("_row").union(rows.where("node is null").select(row_key.alias("_row"))).distinct())
    named = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long").isNull(), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    return named.join(kept.hint("merge"), "_row").dropDuplicates(["_row"]).drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
