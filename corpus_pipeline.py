"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents. A stage works on all that its predecessor kept:

quality          documents that op8's rules reject go
lines            op6 removes lines that several documents share; n_chars follows
near_duplicates  one document of each op7 component stays, similarity 0.8 or more
decontamination  documents with an op9 match of a benchmark item go
packing          op4 cuts what is left into sequences of 4096 tokens

Rows are dropped by a key of their own, not by id: texts that share an id, or have
none, stay or go each for itself. In every stage an empty table gives an empty one,
extra columns are left out, and texts are read whole, however long. In detail:

quality          a null or empty text has no words and goes
lines            a null text becomes empty; the largest id that holds a line keeps it,
                 and of rows that share that id each does
near_duplicates  null, empty and wordless texts stay; of a group the least id stays,
                 nulls first, and of rows that share it the least by hash of the text
                 and then one of the equal ones
decontamination  a null or empty text matches nothing and stays
packing          a null text gives the end id alone; repeated rows are packed each
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import op4_packing, op6_lines, op7_minhash, op8_quality, op9_decontamination
from cadenza.llm.common import Scratch, ids, maybe_broadcast

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with _key, a long of each row's own in the order of doc_id, nulls first.

    It is the id itself where no two rows share one; otherwise the rows are sorted
    by id and hash of the text, numbered and saved.
    """
    docs = docs.select(*COLUMNS, ids("doc_id").alias("_key"))
    if docs.groupBy("_key").count().filter("count > 1").isEmpty():
        return docs
    ordered = docs.orderBy("_key", F.xxhash64("text"), F.monotonically_increasing_id())
    return Scratch(docs.sparkSession, name).save(ordered.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """docs whose key is not in rejected(_key); a short list is broadcast, a long one shuffled."""
    scratch = Scratch(docs.sparkSession, name)
    gone = scratch.save(rejected.select(ids("_key").alias("_gone")).distinct(), "rejected")
    return docs.join(maybe_broadcast(gone), ids("_key") == F.col("_gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = op8_quality.judge_quality(docs, carry=("text", "lang", "source", "n_chars"))
    return judged.filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op6_lines.dedup_lines(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs, "near-keys")
    out = op7_minhash.near_duplicates(docs, id_col="_key", percent=80)
    return _without(docs, out.filter(~F.col("kept")), "near").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = _keyed(docs, "leak-keys")
    return _without(docs, op9_decontamination.contaminated(docs, benchmark, id_col="_key"), "leaks").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op4_packing.pack(docs, op4_packing.vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Neither MinHash components nor packing by a tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
