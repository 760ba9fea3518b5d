"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data becomes pseudonyms, sources
are mixed to target weights, and what is left is packed into training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read back as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, mixing, packing, pii, toxicity
from plumbline.llm.common import scratch_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: five-word shingles, similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80
#: The session's setting that holds the key of the pseudonyms; without it they are made under the published demonstration key.
KEY_SETTING = "spark.plumbline.pii.key"
#: Rows of one Arrow batch between Spark and Python: texts are long, and a batch is held on both sides at once.  A session that sets its own keeps it.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, "10000") == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.  It learns from the labelled documents of this input.

    Null and empty texts are scored like any other; repeated rows stay or go together; an empty table stays empty; other columns go.
    """
    _small_batches(spark)
    sample = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, toxicity.train(*sample)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked texts; rows that repeat it go too.

    Texts are what is compared: an id that names several different texts keeps one row for each group. Null ids take part and go first
    where their group has others; texts without words stay, once for each id; an empty table stays empty; other columns go.
    """
    _small_batches(spark)
    return jaccard_join.one_of_each_group(docs.select(*COLUMNS), WIDTH, PERCENT).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data under the session's KEY_SETTING; ``n_chars`` follows the text.

    Null texts stay null with a null ``n_chars``; empty ones and repeated rows are handled like others; an empty table stays empty; other
    columns go.
    """
    _small_batches(spark)
    key = spark.conf.get(KEY_SETTING, None)
    hidden = pii.pseudonymise(docs.select(*COLUMNS), key.encode() if key else pii.DEMO_KEY)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that kept tokens follow the target shares of sources, languages and topics.

    Null and empty texts have no tokens; null sources and languages are a value of their own; repeated rows are drawn each; an empty table
    stays empty; other columns go.
    """
    return mixing.drawn(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a null or empty text is one end token; an empty table gives no rows."""
    _small_batches(spark)
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The kernel machine, the permutation and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
