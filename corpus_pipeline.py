"""A corpus from raw documents: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns
a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever others there are.
A stage first deletes the intermediate tables of the stage before it, whose
result must have been written by then; it touches nothing else.

Defined results: documents with no text or no letter are rejected by the first
stage; a document that line dedup leaves without a word goes; of a group of
near duplicates one row stays, of the smallest id, and of one without an id
only where no row has one; repeated rows are near duplicates; rows without an
id are told apart by their text, and each row that holds a benchmark item goes,
with or without an id; lines that two documents or more still have stay in the
one with the smallest id; texts of any length are processed whole; empty tables
pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import decontamination, jaccard_join, language_id, line_dedup, packing, store

MIN_LANGUAGE_SCORE = 0.5
_scope: store.Scope | None = None
ORACLE_SQL = None  # naive Bayes and minimum bin slack are beyond SQL; tests hold the stages against brute force


def _fresh(spark: SparkSession) -> store.Scope:
    """A scope for a stage's tables, in place of the last stage's."""
    global _scope
    if _scope is not None:
        _scope.drop()
    _scope = store.Scope(spark)
    return _scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    with _fresh(spark):
        return language_id.accepted(docs, language_id.fit(docs.where(~language_id.held_out())), MIN_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    with _fresh(spark):
        return _with_words(docs, line_dedup.clean)


def _with_words(docs: DataFrame, step: Callable[..., DataFrame]) -> DataFrame:
    """The columns of docs after step, without the rows that lost their last word."""
    counters = store.free("_n_lines", docs.columns), store.free("_n_dropped", docs.columns)
    out = step(docs, counters=counters)
    out = out.where((F.col(counters[1]) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    kinds = dict(docs.dtypes)
    return out.select(*(F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else store.quoted(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8 or more."""
    with _fresh(spark):
        return jaccard_join.survivors(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, without the lines that a document before them has: no later stage takes a document out."""
    with _fresh(spark):
        key = store.free("_key", docs.columns)
        keyed = docs.withColumn(key, store.row_key())
        leaks = decontamination.matches(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        clean = store.save(keyed.join(leaks.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").drop(key), "uncontaminated")
        return _with_words(clean, line_dedup.without_repeats)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in windows of 4096 tokens, and the checksum of their ids."""
    _fresh(spark)
    pieces = store.save(packing.tokenized(docs), "pieces")  # outside the scope: the result reads it
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = store.Scope(spark)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with results:
            docs = store.save(out, name)
        results.drop(keep=1)
    last = STAGES[-1][1](spark, docs, sf_dir)
    results.drop()  # the last stage has written its pieces
    return last
