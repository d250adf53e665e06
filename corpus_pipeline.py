"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, BPE encoding.

Each stage takes the documents that the one before has kept, as they were written, and returns
documents with the same columns; the last returns their tokens. A stage carries whole rows
as one struct, so columns that the tables may have beside the usual ones pass through and
can't clash. ``run`` writes each stage to the shared checkpoint folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickpath.llm import bpe_codec, language_id, line_dedup, minhash_dedup, source_mix
from clickpath.llm.common import keep, table

#: A document whose best language has no larger share of the evidence is rejected.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no learned language explains better than others.

    Learns from the labelled rows of its input. With no labelled row nothing is learned, and every
    document is undetermined and goes.
    """
    found = language_id.identify(docs, language_id.train(docs), carry=True)
    return (found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
            .select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source; documents without one stay as they are.

    Copies of a document count as one page of their source, so that their lines don't become boilerplate
    and the next stage finds one to keep.
    A document that loses all its lines stays, with an empty text; ``n_chars`` follows the text.
    """
    found = line_dedup.drop_boilerplate(docs, "doc_id", F.col("source"), F.col("text"), carry=True, once=True)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    rows = found.select("row", "n_dropped", F.col("text").alias("_text"))
    return rows.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Rows that repeat an id are one document: one of them stays, the one whose values have the smallest
    hash. Rows without an id all stay.
    """
    kept = (minhash_dedup.near_duplicates(docs).where("kept").where(F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("_kept")).distinct())
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.xxhash64(*docs.columns).alias("_hash"), row)
    first = F.row_number().over(Window.partitionBy("_id").orderBy("_hash"))
    stay = named.join(kept, F.col("_id") == F.col("_kept"), "left_semi").withColumn("_first", first).where("_first = 1").select("row")
    return (stay.union(docs.where(F.col("doc_id").isNull()).select(row))
            .select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears once for each pass that takes more than half of its words.

    Documents of which nothing or less than half is taken go, as do those without words.
    """
    mixed = source_mix.mix(docs, carry=True)
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size") - 1) / (2 * F.col("size")))).otherwise(0)
    rows = mixed.select("row", times.cast("int").alias("_times")).where("_times > 0")
    return (rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time"))
            .select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row."""
    decoded = bpe_codec.round_trip(docs)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          *bpe_codec.digests(F.col("ids"), F.col("text")))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe_codec", encode),
]

#: Language ID's learned trees can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
