"""Relational operators on tables that are empty, or whose every column may be NULL, with repeats, long texts and ties."""

import pytest
from corpusloom.runtime import CORE
from pyspark.sql import functions as F

SOURCE = "/root/testdata/sf0.001"
TABLES = ("raw_lines", "examples", "source_files", "compile_results", "request_log", "bpe_vocab", "bpe_merges", "documents", "doc_labels", "eval_items", "subject_areas", "context_windows", "events")
SKIP = {"bpe_train_small", "bpe_train_total_order", "word_bpe_train", "bpe_train_job", "file_checks"}  # tested on small frames elsewhere; metadata only


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for t in TABLES:
        df = spark.read.parquet(f"{SOURCE}/{t}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{t}.parquet")
        few = df.limit(6)
        nulls = few.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
        words = [c for c, kind in df.dtypes if kind == "string"]
        blank = few.limit(1).select(*(F.lit("").alias(c) if c in words else F.col(c) for c in df.columns))
        long = few.limit(1).select(*(F.expr(f"repeat(coalesce({c}, 'x'), greatest(1, 20000 DIV greatest(1, length(coalesce({c}, 'x')))))").alias(c) if c in ("text", "code", "line_text") else F.col(c) for c in df.columns))
        every = few.unionByName(few).unionByName(nulls).unionByName(blank).unionByName(long)
        every.withColumn("n", F.lit("clash")).withColumn("pos", F.lit(1)).coalesce(2).write.parquet(f"{root}/odd/{t}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - SKIP))
def test_edges(spark, folders, name):
    assert len(CORE.queries[name](spark, f"{folders}/empty").collect()) <= 600  # bytes, special tokens and totals come out of nothing
    CORE.queries[name](spark, f"{folders}/odd").collect()
