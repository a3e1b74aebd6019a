"""The corpus pipeline: language, repeated lines, near copies, source mix, token ids.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import op1_sentencepiece, op4_language, op6_lines, op7_jaccard, op9_mixing
from plumbline.llm.common import DOCUMENT_COLUMNS, documents, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; the classifier is fitted on a bounded labelled sample of ``docs``.

    Those go that have a null or blank text, or in which hardly a word has letters of a known
    script; mixed-language texts stay, and rows with a null doc_id. ``lang`` becomes the main language found.
    """
    model = op4_language.fitted(docs, op4_language.LANGUAGES, op4_language.SAMPLE)
    found = op4_language.identified(docs.select(*DOCUMENT_COLUMNS), model, with_text=True).where("keep").withColumn("lang", F.col("main_lang"))
    return found.select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; documents of which nothing but white space is left go.

    Rows with a null doc_id or text, and texts of fewer than three lines, stay as they are.
    """
    left = op6_lines.without_repeated_lines(docs.select(*DOCUMENT_COLUMNS))
    return left.where(r"removed_lines = 0 or text rlike '\\S'").withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of documents connected by similar pairs.

    Rows with a null doc_id or text, and texts without a word, stay; rows that share the kept doc_id all do.
    """
    return op7_jaccard.one_of_each_group(docs.select(*DOCUMENT_COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' target weights; each shard in one file, in the order of its positions.

    Rows with a null doc_id or source aren't drawn; repeated rows are drawn like others, each once at most.
    """
    return op9_mixing.mixed(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: ``doc_id, lang, source, mix_file, mix_row, ids, n_ids, round_trip``.

    ``mix_file`` and ``mix_row`` are the file and the row of ``docs``, which keep the order of the mix; null where ``docs`` isn't
    read from files. A null text has null ids.
    """
    own = docs.select("doc_id", "lang", "source", "text")
    try:
        own = docs.select(*own.columns, F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        own = own.withColumns({"mix_file": F.lit(None).cast("string"), "mix_row": F.lit(None).cast("long")})
    return op1_sentencepiece.encoded(own)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL can express neither the language search, the mix nor the encoding.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between them are in the shared folder, each removed once the next one is written."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            _drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    raise ValueError("STAGES is empty")
