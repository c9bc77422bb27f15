"""A corpus pipeline: toxicity, near-duplicates, substring dedup, decontamination and mixing.

Each stage takes the documents that its predecessor kept and returns documents;
`run` writes each result as Parquet into the session's shared folder and reads
it again, so a lost executor repeats no earlier stage; results of earlier stages
are removed once the next one is written.

Every stage keeps the input's columns, whatever their names, and gives an empty
table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaflux.llm import decontaminate, mixing, simhash, substring_dedup, toxicity
from viaflux.llm.session import ensure_checkpoint_dir


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """`rows` in the columns of `docs`; n_chars follows the text where there is such a column."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic.

    Null and empty texts are judged by the bias alone, which the class prior
    sets. Repeated rows stay or go together. Without toxic labels all stay.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash component.

    Null and empty texts are one component. Rows that repeat the kept doc_id all
    stay. A null doc_id stays only where its component has no other.
    """
    return simhash.keep_first(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages and lines; those of which nothing is left but white space go.

    Null texts and texts that were blank before stay. Rows that repeat a doc_id
    and its text are one document, and none is the other's repeat.
    """
    out = substring_dedup.dedup_substrings(docs, whole_lines=True)
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _as_documents(out.filter(~F.coalesce(emptied, F.lit(False))), docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of benchmark passages; those of which nothing is left but white space go.

    Null texts and texts that were blank before stay. Repeated rows are cleaned
    alike. An empty benchmark changes nothing.
    """
    out = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    emptied = F.col("contaminated") & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _as_documents(out.filter(~F.coalesce(emptied, F.lit(False))), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, documents repeated as the mix takes them.

    Null and blank texts have no words and are taken at their source's rate; of
    a source without words nothing is taken. Null sources are one source, the
    last. Rows that repeat a doc_id share its draw.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: A trained classifier and components aren't expressible in SQL; tests/llm compares run() with a pipeline of plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of `sf_dir` after all stages."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        written = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before is not None:
            _remove(spark, before)
        before = written
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder, wherever the session's file systems have it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
