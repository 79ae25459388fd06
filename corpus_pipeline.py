"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on what the stage before it kept;
``run`` writes every stage's result as Parquet into the shared folder and reads it
back for the next one.

Defined cases, for all stages: a null text is treated as an empty one; a null id is an id like others; rows that repeat an id are rows of
their own; all columns are kept, whatever their names, but for the last stage, which returns pieces; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.llm import decontam, linededup, packing, quality, queries, simhash
from ontospark.llm.common import table, written

#: A line in so many documents stays only where it comes first.
REPEATED_IN = 10
#: Words of a shingle of the near-duplicate stage, which groups texts of a similarity of 0.8 or more.
WIDTH = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Without labels none is rejected; a null or empty text has no evidence but its site's."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for their first occurrence (smallest doc_id, then line); documents of which only white space is left go with them.

    Documents that lose no line stay as they are, also empty ones (a null text becomes an empty one).
    """
    done = linededup.dedup(docs, REPEATED_IN, keep_first=True)
    changed = F.col("n_dropped") > 0
    empty = changed & ~F.col("row.text").rlike(r"[^\x20\x09-\x0D]")
    return done.where(~F.coalesce(empty, F.lit(False))).select(*_with_length(docs, changed))


def _with_length(docs: DataFrame, changed) -> list:
    """The columns of ``row``; n_chars follows the text where it changed."""
    out = []
    for name, kind in docs.dtypes:
        own = F.col(f"row.`{name}`")
        out.append((F.when(changed, F.length("row.text").cast(kind)).otherwise(own) if name == "n_chars" else own).alias(name))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the smallest by (doc_id, text, row id), a null doc_id last. Groups are found by SimHash, links checked exactly.

    Rows are told apart by a row id of their own, so rows of equal or null ids count as copies only by their texts. Null texts, empty ones and those of
    white space are copies of one another; texts of fewer words than a shingle are copies only if they have the same words.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("row")), "rows")
    groups = simhash.similar(rows.select("row_id", "row.text"), width=WIDTH)
    groups = written(groups.join(rows.select("row_id", F.col("row.doc_id").alias("doc_id")), "row_id"), "groups")
    by_id = groups.groupBy("root", "doc_id").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))
    first = by_id.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "row_id")).alias("x")).select("root", "x.*")
    # texts are read only where several rows of a group share its smallest id
    ties = first.where("n > 1").select(F.col("root").alias("of"), F.col("doc_id").alias("id"))
    tied = written(groups.join(ties, (F.col("root") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("root", "row_id"), "ties")
    texts = simhash.among(rows.select("row_id", "row.text"), tied.select("row_id"), "row_id", "left_semi")
    least = tied.join(texts, "row_id").groupBy("root").agg(F.min(F.struct("text", "row_id")).alias("x"))
    kept = first.where("n = 1").select("row_id").unionByName(least.select("x.row_id"))
    gone = written(groups.select("row_id").join(kept, "row_id", "left_anti"), "gone")
    return simhash.among(rows, gone, "row_id", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items none does."""
    found = decontam.flagged(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its token ids, and where it lies in the packed sequences; a null or empty text is one piece of one end token."""
    return packing.pack(docs, *queries.vocabulary_files(), capacity=1024, end=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
