"""Reads (read_id, seq) from FASTA files, tables and any column of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.kmers import sanitized, text_to_bases


def from_text(df: DataFrame, id_column: str, text_column: str, k: int, *carry: str) -> DataFrame:
    """One read a line of text, with the columns to carry; lines shorter than k go. A null text has no line."""
    lines = df.select(*carry, F.col(id_column).cast("string").alias("_id"), F.posexplode(F.split(text_column, "\n")).alias("line", "t"))
    reads = lines.select(*carry, F.concat_ws("/", "_id", F.col("line").cast("string")).alias("read_id"), text_to_bases(F.col("t")).alias("seq"))
    return reads.where(F.length("seq") >= k)


def from_fasta(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Records begin at '>'; a sequence may be wrapped over lines, and the last one need not end in a newline."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).where(F.length("r") > 0)
    whole = records.where(F.instr("r", "\n") > 0)  # a header without a sequence is no read
    parts = whole.select(F.substring_index("r", "\n", 1).alias("header"), F.regexp_replace(F.expr("substring(r, instr(r, '\n') + 1)"), "[\r\n]", "").alias("s"))
    reads = parts.select(F.rtrim(F.col("header"), F.lit("\r")).alias("read_id"), sanitized(F.col("s")).alias("seq"))
    return reads.where(F.length("seq") >= k)


def from_table(df: DataFrame, k: int, read_id: str = "read_id", seq: str = "seq") -> DataFrame:
    return df.select(F.col(read_id).cast("string").alias("read_id"), sanitized(F.col(seq)).alias("seq")).where(F.length("seq") >= k)


def documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", k)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text, whose lines are the reads of documents(), over all cores; counts take it as it is."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), "text")).select("text")


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, len of the records of a contig FASTA file as they are written, wrapped or not."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).where(F.instr("r", "\n") > 0)
    seq = F.regexp_replace(F.expr("substring(r, instr(r, '\n') + 1)"), r"\s", "")
    return records.select(F.rtrim(F.substring_index("r", "\n", 1), F.lit("\r")).alias("name"), seq.alias("seq")).withColumn("len", F.length("seq").cast("long"))


def spread(reads: DataFrame) -> DataFrame:
    """reads over all cores if they came in fewer partitions than there are; windows are many times the reads."""
    cores = reads.sparkSession.sparkContext.defaultParallelism
    return reads.repartition(cores, "read_id") if reads.rdd.getNumPartitions() < cores else reads
