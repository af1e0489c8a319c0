"""Sinks and their readers: text, JSON lines, tokenizer models and token arrays, and a compiler as a source of results.

Paths are the caller's and in reach of every executor; nothing is written elsewhere.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, text: str, path: str) -> None:
    """K1: a line a text; line ends within are written as two characters."""
    df.select(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")).alias("value")).write.mode("errorifexists").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    mark = F.lit("﷐")
    return spark.read.text(path).select(F.replace(F.replace(F.replace("value", F.lit("\\\\"), mark), F.lit("\\n"), F.lit("\n")), mark, F.lit("\\")).alias("text"))


def write_instructions(df: DataFrame, description: str, code: str, path: str) -> None:
    """K2: JSON lines with one text each, description and code with a blank line between."""
    df.select(F.concat(description, F.lit("\n\n"), code).alias("text")).write.mode("errorifexists").json(path)


def write_records(df: DataFrame, columns: list[str], path: str) -> None:
    """K3: lines of quoted fields, quotes and backslashes escaped, line ends written as two characters; the dialect of raw_lines."""
    field = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    df.select(F.concat_ws(",", *(field(F.col(c)) for c in columns)).alias("value")).write.mode("errorifexists").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """K4: a result as JSON lines."""
    df.write.mode("errorifexists").json(path)


def validate_config(vocab_size: int, cache_size: int = 0) -> None:
    """the bounds of a tokenizer's settings."""
    if not 256 <= vocab_size <= 100_000:
        raise ValueError(f"a vocabulary of {vocab_size}: 256 to 100000 are allowed")
    if not 0 <= cache_size <= 100_000:
        raise ValueError(f"a cache of {cache_size}: up to 100000 are allowed")


def write_model(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """K5: a vocabulary (token_id, token) and merges (merge_rank, left_token, right_token) as a folder; ranks are stored, so no order is lost."""
    vocab.select("token_id", "token").write.mode("errorifexists").parquet(f"{path}/vocab")
    merges.select("merge_rank", "left_token", "right_token").write.mode("errorifexists").parquet(f"{path}/merges")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_model wrote."""
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")


def write_tokens(df: DataFrame, path: str) -> None:
    """K6: ids as arrays of integers."""
    df.write.mode("errorifexists").parquet(path)


def compiled(df: DataFrame, key: str, code: str, compiler: str = "g++", seconds: int = 15) -> DataFrame:
    """(key, success, error_message) of each program under a compiler that only checks syntax; NULL success where there is no compiler, and for NULL code.

    A message is cut at ten lines and 1000 characters, as a compiler's list of errors has no end.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = shutil.which(compiler)
        for b in batches:
            out: list[tuple] = []
            for k, c in zip(b[key], b[code]):
                if there is None or c is None:
                    out.append((k, None, None))
                    continue
                try:
                    r = subprocess.run([there, "-std=c++17", "-fsyntax-only", "-x", "c++", "-"], input=c.encode(), capture_output=True, timeout=seconds)
                    out.append((k, r.returncode == 0, None if r.returncode == 0 else "\n".join(r.stderr.decode("utf-8", "replace").split("\n")[:10])[:1000]))
                except subprocess.TimeoutExpired:
                    out.append((k, False, f"timeout after {seconds} s"))
            yield pd.DataFrame(out, columns=[key, "success", "error_message"])

    return df.select(key, code).mapInPandas(check, f"{key} {dict(df.dtypes)[key]}, success boolean, error_message string")
