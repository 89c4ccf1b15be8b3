"""The corpus pipeline: toxicity, line dedup, near-duplicate dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result to the shared folder and reads it again for the next one.
All stages but the last return the columns of documents, with n_chars brought
up to date where the text changed, if there is such a column; columns that have
the names of an operator's own results keep their values. Rows with a null id or
text pass the filters.

A stage judges rows, not ids: of rows that repeat an id with different texts
each stays or goes by its own text; of equal texts under one id one stays.

The order of the stages is given. Line dedup before near-duplicate dedup costs
recall of near copies there: their shared lines are gone from all but one, so
what is left of the others is shorter and seldom similar. It leaves husks, texts
without the lines that others hold; they are kept, for a stage keeps documents
that are clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinaxis.llm.common import Scratch, read_table, scope
from twinaxis.llm.decontaminate import without_leaks
from twinaxis.llm.line_dedup import dedup_lines
from twinaxis.llm.minhash_dedup import near_duplicate_documents, with_text_key
from twinaxis.llm.packing import pack
from twinaxis.llm.toxicity import score_toxicity

#: Columns of docs travel under this prefix past an operator that has columns of the same names.
KEPT = "__kept_"


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    return docs.withColumnsRenamed({n: KEPT + n for n in names if n in docs.columns})


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the columns of docs, those set aside under their names again."""
    return rows.select(*[F.col(f"`{KEPT + c}`").alias(c) if KEPT + c in rows.columns else F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic."""
    scored = score_toxicity(spark, _aside(docs, "held_out", "score", "predicted"), read_table(spark, sf_dir, "labels"))
    return _back(scored.where("predicted = 0"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that an earlier document holds out of every text; every document stays."""
    out = dedup_lines(spark, _aside(docs, "n_lines", "n_dropped"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _back(out, docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that with the smallest id."""
    found = near_duplicate_documents(spark, docs)
    own_id = F.col("doc_id").cast("long")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept"))
    gone = ids.where("n = 1 and not kept").select(F.col("doc_id").alias("__gone"))
    again = ids.where("n > 1").select(F.col("doc_id").alias("__again"))
    once = docs.join(gone, own_id == F.col("__gone"), "left_anti").join(again, own_id == F.col("__again"), "left_anti")
    # Rows that repeat an id are told apart by their texts.
    several = with_text_key(docs.join(again, own_id == F.col("__again"), "left_semi"), "__key")
    bad = found.where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key")).distinct()
    several = several.join(bad, (own_id == F.col("__gone")) & (F.col("__key") == F.col("__gone_key")), "left_anti")
    wordless = several.where("__key is null").select(*docs.columns)
    return once.union(several.where("__key is not null").dropDuplicates(["doc_id", "__key"]).select(*docs.columns)).union(wordless)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return without_leaks(spark, docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of at most 2048 tokens."""
    length, crc = (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32")
    return pack(docs).select("doc_id", "start", length, crc, "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: A trained classifier and a tokenizer have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scope():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
