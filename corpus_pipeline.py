"""A training corpus from raw documents: language, near copies, repeated
passages, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; all but the last return the columns of documents.

Null texts have no letter and go in the first stage; a stage by itself takes
them as empty.  Repeated rows of one id and text stay once after near_copies;
rows without an id are never near copies of others.  Texts of any length are
read whole.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesignal.llm import langid, packing, pii, simhash, superkmer
from lakesignal.llm._spark import materialize
from lakesignal.llm.queries import WORD_BPE, part_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is predicted with less are rejected.
LEAST_SCORE = 0.3
#: Words of a shingle and bits that near copies may differ in.
SHINGLE, LIMIT = 5, 7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too) or with no clear language go."""
    model = langid.fit(docs, part_of(4) != 2)
    marked = langid.identify(docs.select(*COLUMNS), model, pred="_lang_pred", score="_score")
    return marked.where((F.col("_lang_pred") != langid.UND) & (F.col("_score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its group stays, once; rows without an id stay.

    Fingerprints of five-word shingles link at 7 of 64 bits; that is a similarity
    of 0.89 of the fingerprints, and of about 0.89 of the shingle sets, as the
    fingerprints estimate it."""
    named = simhash.near_duplicates(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), shingle=SHINGLE, limit=LIMIT)
    stay = named.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(stay, "doc_id", "left_semi").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur elsewhere are cut out, every
    occurrence, the first too: what many documents share is held to be
    boilerplate (whole copies went before).  A null text becomes empty."""
    left = superkmer.remove_repeats(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; a null text stays null."""
    clean = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and places; a null text is empty."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("personal_data", personal_data), ("sequences", sequences)]

#: No SQL form; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
