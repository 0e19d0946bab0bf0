"""A training corpus from documents: language, toxicity, near duplicates, mixing and packing, one stage after another.

Every stage takes any documents: null and repeated doc_ids are rows of their own, a null text counts as an empty one, whole texts
are read whatever their length, other columns pass through unread (their names must not begin with "_"), and an empty
table gives an empty one. Documents with equal values in all columns are interchangeable; no other tie depends on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm import jaccard, langid, mixing, packing, toxicity
from prismframe.llm.common import counted, marked, scratch, settle, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text (null, empty) or without a letter go. Repeated rows fare alike.

    The trees learn from the stage's own documents that have a lang; documents with a null lang are only judged. Without
    any such document nothing has a language, and all go.
    """
    return langid.identify(docs).where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity; null and empty texts are judged like texts without words.

    Labels join by doc_id only to learn: documents without a label, or with a null doc_id, are judged by their text alone.
    """
    return toxicity.assess(docs, table(spark, sf_dir, "labels")).where(F.col("score") < 0.5).select(*docs.columns)


#: A document is taken at most this often: the mix's cap on words over size.
MOST_COPIES = 3


def keyed(docs: DataFrame) -> DataFrame:
    """docs as a written table with a key of each row, _row, and a hash of its values, _tie."""
    return settle(docs.select("*", F.monotonically_increasing_id().alias("_row"), F.xxhash64(*docs.columns).alias("_tie")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the least doc_id (a null one comes last), then the least hash.

    Rows are told apart by a key of their own, whatever their doc_ids. Null, empty and blank texts have no copies and stay.
    """
    rows = keyed(docs)
    with scratch(spark) as keep:
        kept = keep(jaccard.join_documents(rows, key="_row", tie="_tie").where("kept").select("_row"))
    return marked(rows, "_row", kept).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken over size, rounded by a seeded draw, at most three times.

    Rows are told apart by a key of their own. A document without words (a null text too) is taken 0 times. A null source is
    one of its own; the draw goes by doc_id, or by a hash of the row where it is null.
    """
    rows = keyed(docs)
    with scratch(spark) as keep:
        taken = mixing.mix(rows, carried=("_tie", "_row")).select(F.col("doc_id").alias("_id"), "_tie", F.col("_row").alias("_of"), (F.col("taken") / F.greatest("size", F.lit(1))).alias("_share"))
        draw = F.pmod(F.xxhash64(F.lit("mixed"), F.coalesce("_id", "_tie")), F.lit(1_000_003)) / 1_000_003
        copies = keep(taken.select("_of", F.floor(F.col("_share") + draw).cast("int").alias("_copies")).where("_copies > 0"))
    out = counted(rows, "_row", copies, most=MOST_COPIES)
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1), "_count"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 ids; a null or empty text is one piece, the end id."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the language, the toxicity nor the packing stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result being written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
