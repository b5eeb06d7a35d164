"""Corpus pipeline: language ID, line dedup, near-dedup, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its output must be written as Parquet
and read again for the next, as run() does: a stage begins by deleting the intermediate tables that the stages before it
made in the shared folder, and no others. All but the last return the columns that they were given, whatever further
columns there are: those travel in one struct, so their names cannot clash with a stage's own.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, line_dedup, packing, simhash, suffix_dedup
from quern.llm.shared import delete, discard, owned, ship, written

LEAST_LANGUAGE_SCORE = 0.3


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id and text, and everything else in the struct `rest`."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))


def _wide(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` again; n_chars follows the text."""
    source = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in like.columns:
        n_chars = F.when(F.col("text").isNull(), F.col("rest.n_chars")).otherwise(F.length("text"))
        source["n_chars"] = n_chars.cast(like.schema["n_chars"].dataType)
    return docs.select(*[source.get(c, F.col("rest").getField(c)).alias(c) for c in like.columns])


#: Tables of the stages that were called and whose output the caller has written since.
SPENT: list[str] = []


def _stage(function):
    """A stage that first deletes the tables of earlier stages, and lists its own for the next one."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        while SPENT:
            delete(spark, SPENT.pop())
        with owned() as tables:
            try:
                return function(spark, docs, sf_dir)
            finally:
                SPENT.extend(tables)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from their labelled rows that are not held out.

    Documents without a letter, and those of which the best language explains less than 30 % of the n-grams, go. When
    no row is labelled nothing can be recognised and all documents with a letter stay.
    """
    train = docs.where(~F.coalesce(langid.held_out("doc_id"), F.lit(True)))
    filters = langid.fit(train, "text", "lang", "doc_id")
    told = langid.predict(_narrow(docs), filters, "text", "lang_pred", "lang_score")
    if not filters.languages:
        return _wide(told.where(F.col("text").rlike(r"\p{L}")), docs)
    return _wide(told.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)), docs)


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring line templates; a document that has nothing else goes."""
    cleaned = line_dedup.clean(_narrow(docs))
    return _wide(cleaned.where((F.col("n_dropped") == 0) | (F.trim("text") != "")), docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: 0.8 or more of their five-word shingles."""
    return _wide(simhash.keep_similar(_narrow(docs), width=5, least=0.8), docs)


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 50 bytes that earlier ids hold; a document that has nothing else goes."""
    cleaned = suffix_dedup.clean(_narrow(docs))
    return _wide(cleaned.where((F.col("n_removed") == 0) | (F.trim("text") != "")), docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that hold all documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", drop_repeats),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a table in the shared folder, deleted when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    while SPENT:
        delete(spark, SPENT.pop())
    return docs
