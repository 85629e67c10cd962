"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but
the last return the columns of documents (doc_id, text, lang, source, n_chars); further
columns are dropped, missing ones are null. Rows are told apart by id and text: a row that
repeats both goes or stays with its twin in the filters, except that the near-duplicate
stage keeps one row of each group. The result of the whole has no SQL form.

Defined results: a null or empty text has no words and goes at the first stage; if one comes
to a later stage, it holds no item and no personal data, and has no token. Very long texts
are read whole by every stage. An unknown id is an id of its own. An empty table gives an
empty table of the same columns at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.llm import bpe, decontam, jaccard, pii, quality
from coinbrook.llm.common import shared_dir, table

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def shaped(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go. The verdict is a column of the same row: nothing is shuffled."""
    return shaped(quality.keep(shaped(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays: the one with the class's id (the smallest), rows that repeat it once."""
    docs = shaped(docs)
    classes = jaccard.join(docs)
    key = lambda: [F.coalesce("doc_id", F.lit(jaccard.NO_ID)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dh")]
    # Of several texts under the class's id, the one with the least hash.
    heads = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(jaccard.NO_ID)).alias("did"), "dh", "class_no")
    kept = heads.groupBy("class_no").agg(F.min(F.struct("did", "dh")).alias("k")).select("k.did", "k.dh")
    rows = docs.select("*", *key()).join(kept, ["did", "dh"], "left_semi")
    # Rows that repeat id and text are equal but for the other columns: any one is right, so the keys alone are shuffled twice.
    return shaped(rows.dropDuplicates(["did", "dh"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; of rows that share an id, or have none, only those with such a text."""
    docs = shaped(docs)
    found = decontam.leaking_texts(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak"), F.col("dh").alias("leak_hash"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("leak")) & (decontam.text_hash() == F.col("leak_hash")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind; n_chars follows."""
    return pii.redact(shaped(docs)).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.round_trip(shaped(docs)).drop("round_trip_ok")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", tokens),
]

#: Min-hash joins, SimHash and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
