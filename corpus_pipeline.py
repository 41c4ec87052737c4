"""From documents to packed sequences: five stages, each an operator of mortonlake.llm."""

from __future__ import annotations

import re
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mortonlake.llm.common import forget, free_name, sweep, table
from mortonlake.llm.jaccard_join import drop_near_duplicates
from mortonlake.llm.line_dedup import line_dedup
from mortonlake.llm.mixing import mix
from mortonlake.llm.packing import counted, pack
from mortonlake.llm.quality_rules import quality_rules


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that lose all their lines go."""
    out = line_dedup(docs).filter((F.size("deleted_lines") < F.col("n_lines")) | (F.col("n_lines") == 0))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights use them: each at least once, none more than twice, in the order of the mix.

    Weights and budget count the ids that packing makes of the texts. The rows are dealt and sorted by
    (epoch, block order, source), so the files of the result, in the order of their numbers, are in that order.
    """
    size = free_name(docs, "n_ids")
    mixed = mix(counted(docs, size), n_tokens=F.col(size))
    key = ["epoch", "block_order", "source"]
    return mixed.repartitionByRange(*key).sortWithinPartitions(*key, "doc_id").select(*docs.columns)


def written_order(docs: DataFrame) -> Column | None:
    """Of a table that Spark wrote in one go: a number that rises from file to file and row to row; None for anything else."""
    found = [re.match(r"part-(\d+)-.*c(\d{3})\b", f.rpartition("/")[2]) for f in docs.inputFiles()]
    if not found or not all(found) or len({m.groups() for m in found}) < len(found) or "row_index" not in _metadata(docs):
        return None
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("long")
    return (number(r"part-(\d+)-") * 1000 + number(r"c(\d{3})\b")) * F.lit(1 << 32) + F.col("_metadata.row_index")


def _metadata(docs: DataFrame) -> list[str]:
    try:
        return docs.select("_metadata.*").columns
    except AnalysisException:  # not a plain scan of files
        return []


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, by sequence; sequences follow the order in which the documents were written."""
    return pack(docs, order=written_order(docs))


def _stage(work):
    """The stage, after the tables have gone that no result reads any more: those of earlier stages, once their results are written and dropped."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, collect=True)
        return work(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _stage(rules)),
    ("line dedup", _stage(lines)),
    ("n-gram Jaccard join", _stage(near)),
    ("mixing sources to target weights", _stage(mixture)),
    ("packing", _stage(packed)),
]
#: Packing and the mixing weights cannot be expressed in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
