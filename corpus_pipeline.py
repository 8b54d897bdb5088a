"""The corpus pipeline: five operators in a row over documents, each stage written and read again by run().

A row is a document, whatever its doc_id: ids may repeat or be null. The first stage numbers the rows (ROW), and the
stages up to mixing know them by that number. Null and empty texts are rejected by the first stage; a later stage that
meets them keeps them as they are. Extra columns stay with their row whatever their names, but for those that begin with
__ledgerline. Empty tables go through every stage and give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import common, jaccard, langid, mixing, packing, pii

#: The number of a row, unique but else arbitrary; it is only used as written, since another run deals it anew.
ROW = "__ledgerline_row"
COPIES, TURN = "__ledgerline_copies", "__ledgerline_turn"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, given once and written."""
    return docs if ROW in docs.columns else common.settle(docs.withColumn(ROW, F.monotonically_increasing_id()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known, with their ROW; texts that are null or without a letter are rejected.

    Ties of languages go to the first by name; repeated rows are judged alike. Profiles come from rows with a lang.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = langid.identify(docs.select(whole, "text"), langid.learn(docs))
    known = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return known.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.monotonically_increasing_id().alias(ROW))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group, null last; shingles of five words, similarity 0.8.

    Texts without words link with nothing and stay. Of rows with one doc_id the one whose other columns have the smallest hash stays, so that a new numbering keeps the same.
    """
    columns, docs = docs.columns, numbered(docs)
    groups = jaccard.groups(docs.select(F.col(ROW).alias("doc_id"), "text"), width=5, num=80, den=100)
    linked = common.settle(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(ROW), "component_id"))
    member = linked.unionByName(linked.select(F.col("component_id").alias(ROW), "component_id").distinct())
    digest = F.xxhash64(*(F.col(f"`{c}`") for c in columns if c != ROW)).alias("_digest")
    named = common.join_measured(docs.select(ROW, F.col("doc_id").isNull().alias("_null"), "doc_id", digest), member, [ROW], "inner")
    named = common.settle(named.select(ROW, "component_id", F.struct("_null", "doc_id", "_digest", ROW).alias("_rank")))
    kept = named.groupBy("component_id").agg(F.min("_rank").alias("_least"))
    gone = named.join(kept, "component_id").where(F.col("_rank") > F.col("_least")).select(ROW)
    return common.join_measured(docs, gone, [ROW], "left_anti").select(*(F.col(f"`{c}`") for c in columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text. Null texts stay null; every row stays."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their targets; their ROW goes, since copies share it.

    Null texts and texts without words have no size and are left out. A null source is one of its own. Repeated rows are
    documents each, with copies of their own.
    """
    columns, docs = [c for c in docs.columns if c != ROW], numbered(docs)
    mixed = mixing.mix(docs, carry=[ROW])
    copies = mixed.where("taken > 0").select(ROW, (F.col("taken") / F.col("size")).cast("int").alias(COPIES))
    joined = common.join_measured(docs, copies, [ROW], "inner", 500_000)
    return joined.withColumn(TURN, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(*(F.col(f"`{c}`") for c in columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and where they are packed. A null or empty text is one piece, its end id; extra columns go."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL says what the stages do (profiles, links, EM, knapsack, tokens); tests/llm/test_pipeline.py holds each against
#: a plain recomputation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before it wrote. What a stage needed for the time being goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out, since = common.staging_path(spark, name.replace(" ", "_")), common.mark()
        stage(spark, docs, sf_dir).write.parquet(out)
        common.sweep(spark, since)
        if before:
            common.remove(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
