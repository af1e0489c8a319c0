"""Records of the dataset CSV: five nullable text fields and an array of errors for each line; failing and loaded rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import CORE, read

COLUMNS = ("description", "code", "style", "topic", "keywords")
STYLES = ("using_namespace_std", "explicit_std")
BOM = "﻿"
#: Noncharacters that stand for a field's end, a backslash that escapes, and an escaped quote; a line that holds one fails as `quoting`.
END, ESC, QUOTE = "﷐", "﷑", "﷒"
#: What strip() of Python removes, as a character class.
BLANK = r"[ \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL = r"[\x{00}-\x{08}\x{0A}-\x{1F}\x{7F}-\x{9F}]"


def not_blank(c: Column) -> Column:
    return c.rlike(f"[^{BLANK[1:]}")


def is_record(line: Column) -> Column:
    """False for NULL, empty, comment and header lines."""
    text = F.regexp_replace(line, f"^{BOM}", "")
    header = F.transform(F.split(F.lower(text), ","), lambda x: F.regexp_replace(F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", ""), '^"+|"+$', ""))
    header_like = text.rlike('^[\\s"]*(?i:description)')  # spares most lines the exact test
    return F.coalesce(not_blank(text) & ~text.startswith("#") & ~(header_like & (header == F.array(*map(F.lit, COLUMNS)))), F.lit(False))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row, behind a generator, so that no use of it or filter on it computes it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def cut_fields(df: DataFrame, line: Column) -> DataFrame:
    """Adds `_fields`: the fields as written, escapes as ESC and a character, doubled quotes as QUOTE; NULL if the line is not quoted fields with commas between.

    Escapes are taken out of the way first. Then the text between two quotes is by turns outside and inside of a field,
    and outside there is nothing (a doubled quote) or one comma. There is no loop in a pattern that a long line could exhaust.
    """
    text = F.regexp_replace(F.regexp_replace(line, f"^{BOM}", ""), r"[\r\n]+\z", "")
    text = F.replace(F.regexp_replace(text, r"(?s)\\(.)", f"{ESC}$1"), F.lit(f'{ESC}"'), F.lit(f"{ESC}{QUOTE}"))
    df = once(df, "_parts", F.split(text, '"', -1))
    parts, n = F.col("_parts"), F.size("_parts")
    inner = F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))  # by turns inside and outside of a field, without what is before the first quote and after the last
    good = (n > 2) & (n % 2 == 1) & (parts[0] == "") & (F.element_at(parts, -1) == "") & ~line.rlike(f"[{END}{ESC}{QUOTE}]")
    good = good & ~F.exists(F.filter(inner, lambda x, i: i % 2 == 1), lambda x: ~x.isin("", ","))
    joined = F.array_join(F.transform(inner, lambda x, i: F.when(i % 2 == 0, x).when(x == "", QUOTE).otherwise(END)), "")
    return once(df, "_fields", F.when(good, F.split(joined, END, -1))).drop("_parts")


def unescaped(field: Column) -> Column:
    for mark, char in ((f"{ESC}n", "\n"), (f"{ESC}t", "\t"), (f"{ESC}r", "\r"), (f"{ESC}{QUOTE}", '"'), (QUOTE, '"'), (ESC, "")):
        field = F.replace(field, F.lit(mark), F.lit(char))
    return field


def parse_records(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """The columns of `lines`, but of records only, with the fields as nullable texts and `errors`, in the order quoting, columns, values.

    A record is loaded if `errors` is empty. Blank, comment, header and NULL lines give no row; an empty table gives none.
    """
    # the fields are named so that no column of the input can clash with them
    df = cut_fields(lines.where(is_record(F.col(text))), F.col(text))
    whole = F.coalesce(F.size("_fields") == len(COLUMNS), F.lit(False))
    df = once(df, "_record", F.when(whole, F.struct(*(unescaped(F.col("_fields")[k]).alias(c) for k, c in enumerate(COLUMNS)))))
    r = lambda c: F.col(f"_record.{c}")
    bad = [~r("style").isin(*STYLES), ~not_blank(r("description")), ~not_blank(r("code")), ~not_blank(r("topic")),
           F.regexp_replace(r("keywords"), r"[\s,;|/，；｜、\"'\\\[\]{}]", "") == "", F.replace(F.replace(F.col("_fields")[1], F.lit(ESC), F.lit("\\")), F.lit(QUOTE), F.lit('"')).rlike(CONTROL)]
    values = F.col("_record").isNotNull() & reduce(Column.__or__, (F.coalesce(x, F.lit(False)) for x in bad))
    checks = F.array(F.when(F.col("_fields").isNull(), "quoting"), F.when(F.col("_fields").isNotNull() & ~whole, "columns"), F.when(values, "values"))
    return once(df, "errors", F.filter(checks, lambda x: x.isNotNull())).drop("_fields")


@CORE.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that fail, each with its first reason."""
    return parse_records(read(spark, sf_dir, "raw_lines").select("line_id", "line_text")).where(F.size("errors") > 0).select("line_id", F.col("errors")[0].alias("reason"))


@CORE.query("p2_loaded")
def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other records, as examples."""
    kept = parse_records(read(spark, sf_dir, "raw_lines")).where(F.size("errors") == 0)
    return kept.select("line_id", "shard", "line_no", *(F.col(f"_record.{c}").alias(c) for c in COLUMNS))
