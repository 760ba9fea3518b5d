"""SimHash fingerprints by DataFrame expressions alone.

Terms are pairs of neighbouring words, hashed to 64 bits; each occurrence is a vote of weight one on every bit, +1
where the hash has it and -1 where not, so a term weighs as often as it occurs.  The votes of 64 bits are summed as
32 columns that each hold two 32-bit counts, in one hash aggregate that combines map-side.

``within_radius`` finds all fingerprints within a Hamming radius by permuted block tables: the bits are cut into
``radius + 3`` blocks, each table is keyed by three of them, and two fingerprints within the radius agree on the key
of at least one table.

Cases: a null text is an empty text; an empty or blank text has fingerprint 0; equal texts have equal
fingerprints; rows that repeat a ``doc_id`` count one by one, in the order of their texts; a null ``doc_id`` sorts first; a table
of one row is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

BITS = 64
#: Rows for each stretch of neighbouring ids, and stretches at most.
STRETCH, STRETCHES = 4096, 8192
_LANE = 0x0000000100000001


def term_hashes(text: Column) -> Column:
    """64-bit hashes of neighbouring words, the last word alone included; none for a blank text."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    after = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(hashes, after, lambda a, b: F.xxhash64(a, b))


def votes(h: Column) -> list[Column]:
    """Sums of the bits i and i + 32 of each hash, two counts to a column."""
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANE))).alias(f"v{i}") for i in range(32)]


def fingerprint(n: Column) -> Column:
    """The 64 bits whose votes are positive, from the columns of ``votes`` and the number of votes."""
    low, high = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(32):
        v = F.col(f"v{i}")
        for half, count in (("low", v.bitwiseAND(F.lit(0xFFFFFFFF))), ("high", F.shiftrightunsigned(v, 32))):
            bit = F.when(count * 2 > n, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            if half == "low":
                low = low.bitwiseOR(bit)
            else:
                high = high.bitwiseOR(bit)
    return F.coalesce(F.shiftleft(high, 32).bitwiseOR(low), F.lit(0).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, fp``: one SimHash for each distinct key (which must tell the rows apart)."""
    terms = rows.select(*keys, term_hashes(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    votes_ = terms.select(*keys, F.explode_outer("terms").alias("h")).groupBy(*keys).agg(F.count("h").alias("n"), *votes(F.col("h")))
    return votes_.select(*keys, fingerprint(F.col("n")).alias("fp"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, part, ord, next_text``: each row with its follower's text, by descending id, round to the first.

    Rows are dealt out by stretches of neighbouring ids.  The end of a stretch is an id of the table, so its rows
    stand in the next stretch too, as neighbours only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = max(1, min(STRETCHES, -(-docs.count() // STRETCH)))
    found = docs.agg(F.percentile_approx("id", [(k + 1) / n for k in range(n)], 100 * n).alias("cuts"), F.max("id").alias("last")).first()
    ends = sorted({*(found.cuts or []), *([found.last] if found.last is not None else [])}) or [0]
    edges = F.array(*[F.lit(e).cast("long") for e in ends])
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(ends).bit_length())))])
    # binary search for the first end that is not below the id
    part = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.try_element_at(edges, at + jump) < F.col("id"), at + jump).otherwise(at))
    dealt = docs.withColumn("part", part).withColumn("is_end", F.try_element_at(edges, F.col("part") + 1) == F.col("id"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    beyond = F.struct(F.pmod(F.col("part") + 1, F.lit(len(ends))).alias("part"), F.lit(True).alias("guest"))
    placed = dealt.withColumn("at", F.explode(F.when(F.col("is_end"), F.array(own, beyond)).otherwise(F.array(own))))
    placed = placed.select("doc_id", "id", "text", F.col("at.part").alias("part"), F.col("at.guest").alias("guest"))
    # guests come before the stretch's own rows: they are the ids just below it (or, round the end, the largest)
    order = Window.partitionBy("part").orderBy(F.desc("guest"), "id", "text")
    placed = placed.withColumn("next_text", F.lag("text").over(order)).withColumn("ord", F.row_number().over(order))
    return placed


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many first code points of the following text."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next text's."""
    rows = with_next(docs)
    both = rows.select(
        "doc_id", "part", "ord", "guest",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("kind"), edited(F.col("text"), F.col("next_text")).alias("text")),
            )
        ).alias("x"),
    ).where("not guest or x.kind = 0")
    keys = ["doc_id", "part", "ord", "guest", "kind", "n_chars", "sha"]
    both = both.select(
        "doc_id", "part", "ord", "guest", F.col("x.kind").alias("kind"), F.col("x.text").alias("text"),
        F.length("x.text").cast("long").alias("n_chars"), F.when(F.col("x.kind") == 1, F.sha2("x.text", 256)).alias("sha"),
    )
    fps = fingerprints(both, keys)
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = fps.groupBy("part", "ord", "guest", "doc_id").agg(pick(0, "n_chars").alias("n_chars"), pick(1, "sha").alias("edited_sha256"), pick(0, "fp").alias("fp"), pick(1, "fp").alias("edited_fp"))
    follower = F.lag("fp").over(Window.partitionBy("part").orderBy("ord"))
    wide = wide.withColumn("next_fp", follower).where("not guest")
    return wide.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.lower(F.lpad(F.hex("edited_fp"), 16, "0")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def within_radius(fps: DataFrame, radius: int = 3, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """``fp, other, distance``: all pairs of different fingerprints within the Hamming radius, ``fp < other``.

    Equal fingerprints are one value (their rows are the membership).  A pair that several tables find is kept once: by
    the first table whose key the two share.
    """
    n_blocks = radius + 3
    bounds = [BITS * k // n_blocks for k in range(n_blocks + 1)]
    masks = []
    for chosen in combinations(range(n_blocks), 3):
        mask = sum(((1 << (bounds[b + 1] - bounds[b])) - 1) << bounds[b] for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    values = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    keyed = values.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("t", "mask"))
    keyed = keyed.select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    other = keyed.withColumnRenamed("fp", "other").hint("merge")
    pairs = keyed.join(other, ["t", "key"]).where("fp < other").withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))))
    pairs = pairs.where(F.col("distance") <= radius)
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(k)) for k, m in enumerate(masks)])
    return pairs.where(F.col("t") == first).select("fp", "other", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
