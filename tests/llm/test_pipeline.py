"""The pipeline's stages on a small table, each against what its operator must do."""

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import op9_mixing
from plumbline.llm.common import DOCUMENT_COLUMNS

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and kept
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(out.columns) == DOCUMENT_COLUMNS
        if name == "language":
            assert len(kept) > 0.95 * len(ids)
        if name == "mix":
            sizes = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
            quota = op9_mixing.quotas(sizes, op9_mixing.default_weights(sizes))
            assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {s: n for s, n in quota.items() if n}
        if name == "encode":
            rows = out.collect()
            assert all(r.round_trip for r in rows) and len({(r.mix_file, r.mix_row) for r in rows}) == len(rows)
        docs, ids = out, kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 5000} and the" for i in range(100_000))
    prose = "\n".join(f"the line number {i} of this text and that" for i in range(6))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose + "\nend", "en", "b", 2), (None, "the text without an id", "en", "a", 3), (4, None, "en", "a", 4), (5, "", None, None, None),
            (6, "\n \n\n", "en", "a", 6), (7, long, None, "b", 7), (8, "the document of no source and no language", None, None, None), (9, "12 34 --", "en", "b", 9), (10, "der kurze text und das", "de", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "node", "shard", "position", "keep", "main_lang", "removed_lines", "ids", "component", "_metadata"):
        docs = docs.withColumn(c, F.lit("x"))
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        by[name] = sorted((r.doc_id for r in spark.read.parquet(f"{tmp_path}/{name}").collect()), key=lambda x: (x is None, x))
        if name != "encode":
            assert tuple(out.columns) == DOCUMENT_COLUMNS
    assert by["language"] == [1, 1, 2, 7, 8, 10, None]
    assert by["lines"] == [1, 1, 2, 4, 5, 6, 7, 8, 9, 10, None]
    assert by["near_copies"] == [1, 1, 4, 5, 6, 7, 8, 9, 10, None]
    assert set(by["mix"]) <= {1, 2, 4, 6, 7, 9, 10} and by["mix"]
    assert by["encode"] == sorted((r[0] for r in rows), key=lambda x: (x is None, x))


def test_run_leaves_one_folder(spark):
    from plumbline.llm.common import shared_dir

    out = corpus_pipeline.run(spark, DATA)
    files = out.select("mix_file").distinct().count()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    runs = [x.getPath() for x in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder) if x.getPath().getName().startswith("pipeline-")]
    left = [y.getPath().getName() for x in runs for y in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(x)]
    assert files and set(left) == {"3-mix"}
