"""A training corpus from raw documents: language ID, near-duplicates, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. ``run`` writes each stage's rows as Parquet in the shared folder and reads
them again.

Case handling: decisions are made for rows, by doc_id (a null is a value) and
text. A null or wordless text has no language and goes at the first stage; the
stages after it bear them: they are near-duplicates of one another, have no word
to be contaminated, nothing to redact (null stays null) and no tokens. Of rows
equal in doc_id and text one stays. Very long texts are worked on whole, empty
tables stay empty, further columns are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, idset, langid, pii, sentencepieces, simhash
from tidelog.llm.common import prepare, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("text_key"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; lang is the predicted one."""
    return langid.identified(docs, COLUMNS).where("not found.rejected").withColumn("lang", F.col("found.lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of least doc_id, of several of these that of the least hash, of equal rows one."""
    groups = simhash.grouped(docs)
    key = ("doc_id", "text_key")
    again = stored(groups.where("first").groupBy(*key).count().where("count > 1").select(*key), "again")
    rows = _keyed(docs)
    alone = idset.without(rows, groups.where("not first").select(*key).unionByName(again))
    return alone.unionByName(idset.fetched(rows, again).dropDuplicates(key)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark's windows contaminate."""
    found = decontaminate.keyed_contamination(docs, table(spark, sf_dir, "benchmark"))
    return idset.without(_keyed(docs), found.where("contaminated").select("doc_id", "text_key")).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars is the new text's."""
    prepare(spark)
    return docs.withColumn("text", pii.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    prepare(spark)
    encoded = docs.select("doc_id", "lang", "source", sentencepieces.encode_checked(F.col("text"), sentencepieces.load()).alias("x"))
    return encoded.select("doc_id", "lang", "source", F.size("x.ids").cast("long").alias("n_tokens"), "x.ids", "x.round_trip")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can express neither the language models nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
