"""Corpus pipeline: documents in, token ids out, each stage one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and reread as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm import boosted_trees, bpe, minhash, mixing, secrets
from ticklane.llm.common import checkpointed, read, remove, sized, written
from ticklane.llm.queries import GOOD, WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among docs. Null and empty texts are scored like any other, whole long texts too. Without labels every score is the same and all stay or go by it; an id with several labels teaches once (see boosted_trees). Repeated rows are judged alike, rows without an id teach nothing; ties at the threshold stay. Columns besides those of documents are dropped; an empty table stays empty."""
    trees = boosted_trees.fit(docs, read(spark, sf_dir, "labels"))
    return boosted_trees.score(docs, trees, name="_score").where(F.col("_score") >= GOOD).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies, by shingles of five words. Rows without an id all stay. Rows that repeat a kept id and text count once, with the least of their other columns; different texts under one id all stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    marks = checkpointed(found.groupBy("doc_id").agg(F.first("kept").alias("_kept"), F.count("*").alias("_n")).where("doc_id is not null and (_n > 1 or not _kept)"))
    kept = docs.join(sized(marks, minhash.FEW), "doc_id", "left").where(F.coalesce("_kept", F.lit(True)))
    if not marks.where("_n > 1").limit(1).count():
        return kept.select(*COLUMNS)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = kept.where("_n > 1").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_c")).select("doc_id", "text", "_c.*")
    return kept.where("_n is null or _n = 1").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked; n_chars follows where a text changed. Null texts stay null, empty ones empty, long ones are scanned whole; repeated rows change alike. Columns besides those of documents are dropped; an empty table stays empty."""
    clean = secrets.redact(docs.withColumn("_before", F.col("text")))
    length = F.when(F.col("text").eqNullSafe(F.col("_before")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. Null and empty texts have size 0 and come as often as the cut of their source says; a null source is a source of its own, the last. Repeated rows are taken alike, and long texts whole; of two equally near cuts the lower one holds. Columns besides those of documents are dropped; an empty table stays empty."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of each whole text. Null and empty texts have none; repeated rows give repeated results. Of equal merge ranks the leftmost pair merges first. Other columns are dropped; an empty table stays empty."""
    return bpe.encode(docs.select("doc_id", "source", "text"), WORD_BPE).select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("minhash near-dedup", keep_one_of_each),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
    ("bpe encoding", encode_texts),
]
#: The stages learn a model, link near copies, parse encodings and merge by rank: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared checkpoint folder (see common.written) and reread, and removed when the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        paths: list[str] = []
        docs = written(stage(spark, docs, sf_dir), paths)
        remove(spark, before)
        before = paths
    return STAGES[-1][1](spark, docs, sf_dir)
