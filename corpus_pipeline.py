"""A corpus pipeline of five stages over ``documents``.

toxicity, n-gram Jaccard join, benchmark decontamination, personal data, packing. Each stage
takes what the one before kept, written as Parquet; all but the last return the columns
of their input.

Edge cases: empty tables pass through all stages; nulls in any column are kept; a document
that repeats another's words is dropped in favour of the least id of its group, and rows that
repeat one id and text keep one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm import decontam, ngram_join, packing, pii, toxicity
from tidebar.llm.common import fresh_folder, saved, table

# ids to drop go to all tasks only below this many
GONE_ROWS = 500_000
# near copies share four fifths of their runs of five words; op8_ keeps to its own contract
ALIKE = ngram_join.Likeness(words=5, num=80, den=100)


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled rows of ``documents`` that aren't held out."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_flagged(docs, model)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the least id; documents without words link
    with nothing and stay, and so do rows without an id.
    """
    gone_id, twice_id = unused(docs, "gone_id"), unused(docs, "twice_id")
    gone = saved(ngram_join.join_components(docs, like=ALIKE).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct())
    if gone.count() <= GONE_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs["doc_id"] == F.col(gone_id), "left_anti")
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(twice_id), F.xxhash64("text").alias("h")).count().where("count > 1").select(twice_id).distinct()
    if not twice.limit(1).count():
        return kept
    again = docs["doc_id"] == F.col(twice_id)
    return kept.join(twice, again, "left_anti").unionByName(kept.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_overlaps(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and ``n_chars`` counted anew where a text changed."""
    clean = unused(docs, "clean")
    made = docs.select("*", pii.redact(F.col("text")).alias(clean))
    n_chars = F.when(F.col(clean) != F.col("text"), F.length(clean)).otherwise(F.col("n_chars")).cast("long") if "n_chars" in docs.columns else None
    new = {"text": F.col(clean), "n_chars": n_chars}
    return made.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_alike),
    ("decontamination", drop_benchmark),
    ("pii", redact_pii),
    ("packing", pack_lengths),
]

# the classifier's scores can't be expressed in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each kept is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
