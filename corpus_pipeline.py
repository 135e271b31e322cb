"""A corpus pipeline of five stages over ``documents``, in this order:

quality rules, line dedup, near-dedup, benchmark decontamination, mixing
sources to target weights. The near-dedup stage is the SimHash operator's
sibling for five-word shingles at a similarity of 0.8: the same Golay-code
keys, over min-wise bits instead of SimHash bits (see ``quiver.llm.similar``).

Every stage takes null ids, null and empty texts, ties, repeated rows and
empty tables as its operator states; none of them ends a run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import decontaminate, lines, mixing, rules, similar
from quiver.llm.common import cut, read
from quiver.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are among them. Repeated rows stay or go together."""
    ship(spark)
    return rules.keep_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in the largest doc_id only; n_chars follows the text. Null texts stay null; no row goes."""
    ship(spark)
    made = {"__null": F.col("text").isNull()}
    kept = lines.dedup_lines(docs.select(*COLUMNS).withColumns(made), carry=("lang", "source", "n_chars", "__null"))
    text = F.when(~F.col("__null"), F.col("kept_text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")
    return kept.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that five-word shingles link at a similarity of 0.8 or more, the longest text stays.

    Ties: the largest doc_id, as line dedup keeps shared lines in the largest;
    so of near copies that differ by such lines alone, the one that holds them
    stays. A line that only a shorter text of a group holds goes with it.
    Null ids: each row by its own text, behind known ids. Empty texts are one group.
    """
    ship(spark)
    return similar.keep_first(docs.select(*COLUMNS), longest=True)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; null and empty texts stay."""
    ship(spark)
    return decontaminate.drop_leaked(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document; wordless ones count no words."""
    ship(spark)
    return mixing.mix_sources(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("benchmark decontamination", benchmark_decontamination), ("source mixing", source_mixing)]

ORACLE_SQL = None
"""Near duplicates and string tiling have no SQL; the tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again. A stage's folder goes once the next has read it."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    cut(spark.range(1))  # sets the folder where the session names none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            past = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)
    return docs
