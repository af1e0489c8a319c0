"""Several values packed in one field, taken apart by the frequencies of the values in the whole column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import packed
from corpusloom.runtime import CORE, cut, read

#: Pieces that a value may span without quotes, and rounds of expectation and maximisation.
SPAN, ROUNDS = 4, 2
EDGE = "array<struct<a:int,b:int,piece:string,alone:boolean>>"
WITH_P = "array<struct<a:int,b:int,piece:string,p:double>>"


def split_packed(df: DataFrame, key: str, field: str, span: int = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """Rows (key, pos, value): every value of `field`, counted from 1.

    Value frequencies start from the pieces between separators and the quoted spans of the whole column. A run of pieces
    that also stands somewhere as one value makes its string ambiguous; only ambiguous strings have a second reading of
    likelihood above nothing, so only they go through the rounds of expectation and maximisation and the Viterbi search.
    NULL, empty and separator-only fields give no row; repeats of a value and of a row are kept.
    """

    @F.pandas_udf(EDGE)
    def edges_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: [{"a": a, "b": b, "piece": v, "alone": alone} for a, b, v, alone in packed.lattice(x, span)])

    @F.pandas_udf("array<struct<piece:string,w:double>>")
    def expected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda es: [{"piece": v, "w": w} for v, w in packed.expected([(e["a"], e["b"], e["piece"], e["p"]) for e in es])])

    @F.pandas_udf("array<string>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda es: packed.best([(e["a"], e["b"], e["piece"], e["p"]) for e in es]))

    @F.pandas_udf("array<string>")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(packed.plain)

    rows = df.select(F.col(key).alias("_key"), F.col(field).alias("_packed")).where(F.col(field).isNotNull())
    texts = cut(rows.groupBy("_packed").agg(F.count("*").alias("n")).select("_packed", "n", edges_of("_packed").alias("edges")))
    edges = texts.select("_packed", "n", F.inline("edges"))
    counts = edges.where("alone AND piece <> ''").groupBy("piece").agg(F.sum("n").cast("double").alias("w"))
    ambiguous = cut(edges.where("NOT alone").join(counts.select("piece"), "piece", "left_semi").select("_packed").distinct())
    unsure = cut(texts.join(ambiguous, "_packed", "left_semi"))
    sure = texts.join(ambiguous, "_packed", "left_anti").select("n", F.inline("edges")).where("alone AND piece <> ''").groupBy("piece").agg(F.sum("n").cast("double").alias("w"))

    def scored(weights: DataFrame) -> DataFrame:
        """The ambiguous strings with the likelihood of each edge."""
        total = weights.agg(F.sum("w").alias("total"))
        likely = weights.join(F.broadcast(total)).select("piece", (F.col("w") / F.col("total")).alias("p"))  # one row
        e = unsure.select("_packed", "n", F.inline("edges")).join(likely, "piece", "left").fillna(0.0, ["p"])
        return e.groupBy("_packed", "n").agg(F.collect_list(F.struct("a", "b", "piece", "p")).cast(WITH_P).alias("edges"))

    weights = counts
    for _ in range(rounds):
        again = scored(weights).select("n", F.explode(expected("edges")).alias("e")).select(F.col("e.piece").alias("piece"), (F.col("e.w") * F.col("n")).alias("w"))
        weights = cut(sure.unionByName(again).groupBy("piece").agg(F.sum("w").alias("w")))
    chosen = scored(weights).select("_packed", best("edges").alias("chosen"))
    out = rows.join(chosen, "_packed", "left").select("_key", F.coalesce("chosen", plain("_packed")).alias("values"))
    return out.select(F.col("_key").alias(key), F.size("values").alias("n_values"), F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


@CORE.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword of the examples that hold two or more, with its position."""
    found = split_packed(read(spark, sf_dir, "examples"), "example_id", "keywords")
    return found.where("n_values >= 2").select("example_id", F.col("pos").cast("int").alias("pos"), F.col("value").alias("keyword"))
