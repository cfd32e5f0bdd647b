"""A corpus pipeline out of the operators of evidencelake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm import bpe, language, lines, mixing, simhash
from evidencelake.llm.common import held_out, key_of, stage
from evidencelake.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without any letter go, null and empty texts among them.

    A null lang is filled in, any other stays.  Equal cosines go to the first language by name.  Where no document has a
    lang, none is learned and all go; an empty table stays empty.  Null ids and repeated rows pass like any other.
    """
    prototypes = language.learn(docs.where(~held_out()))
    guessed = language.predict(docs.select(*COLUMNS), prototypes).where("lang_pred <> 'und'")
    return guessed.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another one keeps; those that lost lines and have no word left go.

    The first occurrence by doc_id and place keeps a line, null ids before all.  Rows that repeat doc_id and text are one
    document and lose the same lines; null and empty texts pass.  n_chars is counted anew, null for null text.
    """
    cleaned = lines.dedup_lines(docs.select(*COLUMNS))
    left = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id, null ids last.

    Of rows that repeat its doc_id one stays, by text.  Null and wordless texts are one group.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it: none, one or two.

    Rows are known by all their columns, so null and shared ids are rows like any other, and equal rows add up.  Texts
    without a word have size 0, are never taken and go.  Reruns take the same; an empty table gives none.
    """
    # ids may be null or shared by different texts, so rows are known by all their columns, and equal rows add up
    row = F.concat_ws(":", key_of("doc_id"), F.xxhash64(*[key_of(c) for c in COLUMNS]))
    docs = docs.select(*COLUMNS, row.alias("__row"))
    mixed = mixing.mix(docs, carry=["__row"]).where("taken > 0")
    copies = mixed.groupBy("__row").agg(F.sum(F.expr("taken div size")).cast("int").alias("copies"))
    repeated = docs.dropDuplicates(["__row"]).join(copies, "__row")
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether they decode to it.  Null texts are empty: no ids, and they decode to it."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("bpe_codes", bpe_codes),
]

#: Prototypes, SimHash groups, the knapsack and BPE have no SQL form: tests hold each stage, and run(), against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
