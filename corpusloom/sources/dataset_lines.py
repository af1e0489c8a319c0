"""Ways to cut the physical lines of the dataset into fields, and the structural check of a line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.dialect import Duck, Spark, relational
from corpusloom.runtime import CORE, read

SEP = '","'
HEADER = "description,code,style,topic,keywords"
#: Noncharacters that stand for a comma that separates, and for a backslash, quote or comma that is escaped.
CUT, ESC, QUO, COM = "﷐", "﷑", "﷒", "﷓"


def cut_at_commas(d: Spark, x: str) -> str:
    """The parts of a line between commas outside of quotes; a backslash takes its meaning from the next character, quotes stay."""
    t = d.sub(x, r"(?s)\\(.)", ESC + "$1")
    for a, b in ((ESC + '"', ESC + QUO), (ESC + ",", ESC + COM)):
        t = f"replace({t}, {d.lit(a)}, {d.lit(b)})"
    parts = d.split(t, '"')
    if isinstance(d, Duck):
        outside = f"[CASE WHEN i % 2 = 1 THEN replace(({parts})[i], ',', '{CUT}') ELSE ({parts})[i] END for i in range(1, len({parts}) + 1)]"
    else:
        outside = f"transform({parts}, (x, i) -> CASE WHEN i % 2 = 0 THEN replace(x, ',', '{CUT}') ELSE x END)"
    t = d.join(outside, '"')
    for a, b in ((ESC + QUO, '\\"'), (ESC + COM, "\\,"), (ESC, "\\")):
        t = f"replace({t}, {d.lit(a)}, {d.lit(b)})"
    return d.split(t, CUT)


def records(d: Spark) -> str:
    return f"SELECT line_id, shard, line_no, line_text FROM {{raw_lines}} WHERE line_text <> '' AND line_text NOT LIKE '#%' AND NOT (line_no = 1 AND line_text = '{HEADER}')"


@relational("dataset_lines")
def dataset_lines(d: Spark) -> str:
    """Lines with their numbers, without empty ones, comments and the header; a header in mid-shard is a line like any other."""
    return records(d)


def kept_fields(d: Spark) -> str:
    """The fields, an empty last one left out."""
    all_ = cut_at_commas(d, "line_text")
    return f"SELECT *, CASE WHEN {d.elem('parts', d.size('parts') if isinstance(d, Duck) else '-1')} = '' THEN {d.slice('parts', '1', 'CAST(' + d.size('parts') + ' - 1 AS INT)')} ELSE parts END AS fields FROM (SELECT *, {all_} AS parts FROM ({records(d)}) AS r) AS p"


@relational("csv_fields")
def csv_fields(d: Spark) -> str:
    """Every field of every line with its position; quotes stay, an empty last field is left out."""
    return f"SELECT line_id, CAST(pos AS BIGINT) AS pos, item AS field FROM ({kept_fields(d)}) AS t, {d.each('t.fields')} AS e"


@relational("csv_last_field_kept")
def csv_last_field_kept(d: Spark) -> str:
    """S3: the same, but an empty last field counts."""
    return f"SELECT line_id, CAST(pos AS BIGINT) AS pos, item AS field FROM (SELECT line_id, {cut_at_commas(d, 'line_text')} AS fields FROM ({records(d)}) AS r) AS t, {d.each('t.fields')} AS e"


@relational("split_quoted")
def split_quoted(d: Spark) -> str:
    """The description, and the topic counted from the left and from the right, which differ where code holds the separator."""
    p = d.split("line_text", SEP)
    return f"SELECT line_id, CASE WHEN head LIKE '\"%' THEN substr(head, 2) ELSE head END AS description, {d.elem('p', 4)} AS topic, {d.elem('p', -2)} AS topic_from_end, {d.size('p')} AS n_parts FROM (SELECT line_id, {p} AS p, {d.elem(p, 1)} AS head FROM ({records(d)}) AS r) AS t"


@relational("anchored_fields")
def anchored_fields(d: Spark) -> str:
    """The first separator from the left, the last three from the right, so that code may hold it. As each field but the last keeps the
    quote before its separator, a field that begins with no quote ends with one. Lines that are not quoted or too short give no row."""
    body = d.sub("line_text", "^﻿", "")
    bare = lambda x: f"CASE WHEN {x} = '\"' THEN '' WHEN {x} LIKE '\"%' AND {x} LIKE '%\"' THEN substr({x}, 2, length({x}) - 2) ELSE {x} END"
    n = d.size("p")
    code = d.join(d.slice("p", "2", f"CAST({n} - 4 AS INT)"), SEP)
    fields = {"description": d.elem("p", 1) + " || '\"'", "code": f"{code} || '\"'", "style": d.elem("p", -3) + " || '\"'", "topic": d.elem("p", -2) + " || '\"'", "keywords": d.elem("p", -1)}
    inner = f"SELECT line_id, {d.split('substr(b, 2, length(b) - 2)', SEP)} AS p FROM (SELECT line_id, {body} AS b FROM ({records(d)}) AS r) AS s WHERE length(b) >= 2 AND b LIKE '\"%' AND b LIKE '%\"'"
    cut = f"SELECT line_id, {', '.join(f'{e} AS {c}' for c, e in fields.items())} FROM ({inner}) AS q WHERE {n} >= 5"
    return f"SELECT line_id, {', '.join(f'{bare(c)} AS {c}' for c in fields)} FROM ({cut}) AS f"


@relational("first_quote_fields")
def first_quote_fields(d: Spark) -> str:
    """The description up to the first quote; the code up to the first quote before a comma or the line's end, else to the last quote."""
    rest = "substr(line_text, length(description) + 3)"
    tail = "substr(rest, instr(rest, '\"') + 1)"
    first = f"SELECT line_id, {d.extract('line_text', chr(94) + chr(34) + '([^' + chr(34) + ']*)' + chr(34))} AS description, line_text FROM ({records(d)}) AS r WHERE {d.match('line_text', chr(94) + chr(34) + '[^' + chr(34) + ']*' + chr(34))}"
    second = f"SELECT line_id, description, {tail} AS tail FROM (SELECT line_id, description, {rest} AS rest FROM ({first}) AS a) AS b WHERE instr(rest, '\"') > 0"
    cut = "CASE WHEN instr(tail, '\",') > 0 THEN substr(tail, 1, instr(tail, '\",') - 1) WHEN tail LIKE '%\"' THEN substr(tail, 1, length(tail) - 1) WHEN instr(tail, '\"') > 0 THEN substr(tail, 1, length(tail) - instr(reverse(tail), '\"')) ELSE '' END"
    return f"SELECT line_id, description, {cut} AS code FROM ({second}) AS c"


@relational("description_scan")
def description_scan(d: Spark) -> str:
    """The description up to the first quote; NULL where there is none, which counts as skipped."""
    q = chr(34)
    return f"SELECT line_id, nullif({d.extract('line_text', f'^{q}([^{q}]*){q}')}, '') AS description FROM {{raw_lines}} WHERE line_text <> '' AND line_text NOT LIKE '#%' AND line_text NOT LIKE 'description%'"


def checked(d: Spark) -> str:
    """The errors of each line. What is outside of a field's quotes is checked first and ends the check; the fields can each add one."""
    q = '"'
    strip = lambda x: d.sub(x, '^"+|"+$', "")
    f = lambda k: d.elem("fields", k)
    quoted = lambda k: f"({f(k)} LIKE '{q}%' AND {f(k)} LIKE '%{q}')"
    each = d.array(
        f"CASE WHEN NOT {quoted(1)} THEN 'description' END", f"CASE WHEN NOT {quoted(2)} THEN 'code' END", f"CASE WHEN {strip(f(3))} NOT IN ('using_namespace_std', 'explicit_std') THEN 'style' END",
        f"CASE WHEN {strip(f(4))} = '' THEN 'topic' END", f"CASE WHEN {strip(f(5))} = '' THEN 'keywords' END",
    )
    return (
        f"SELECT line_id, shard, line_no, fields, CASE WHEN NOT (line_text LIKE '{q}%' AND line_text LIKE '%{q}') THEN {d.array(d.lit('outer_quotes'))} WHEN {d.size('parts')} <> 5 THEN {d.array(d.lit('field_count'))} "
        f"WHEN {d.size('fields')} <> 5 THEN {d.array(d.lit('fields_found'))} ELSE {d.filter(each, 'x IS NOT NULL')} END AS errors FROM ({kept_fields(d)}) AS t"
    )


@relational("structure_errors")
def structure_errors(d: Spark) -> str:
    """a row for each error of each line."""
    return f"SELECT line_id, item AS error FROM ({checked(d)}) AS t, {d.each('t.errors')} AS e"


@relational("structure_summary")
def structure_summary(d: Spark) -> str:
    """A1, K4: lines in all, skipped, good and bad, and errors."""
    return (
        f"SELECT a.n_lines, a.n_skipped, a.n_headers, b.n_valid, b.n_invalid, b.n_errors FROM (SELECT count(*) AS n_lines, count(*) FILTER (WHERE line_text = '' OR line_text LIKE '#%') AS n_skipped, count(*) FILTER (WHERE line_no = 1 AND line_text = '{HEADER}') AS n_headers FROM {{raw_lines}}) AS a "
        f"CROSS JOIN (SELECT count(*) FILTER (WHERE n = 0) AS n_valid, count(*) FILTER (WHERE n > 0) AS n_invalid, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_errors FROM (SELECT {d.size('errors')} AS n FROM ({checked(d)}) AS c) AS s) AS b"
    )


@relational("error_categories")
def error_categories(d: Spark) -> str:
    """A2: errors by category of the report. A wrong style is told by its message, so by what its value holds."""
    style = f"lower({d.elem('fields', 3)})"
    kind = f"CASE WHEN item IN ('outer_quotes', 'field_count') THEN 'structure' WHEN item = 'fields_found' THEN 'other' WHEN item = 'style' AND {d.has(style, d.lit('description'))} THEN 'description' WHEN item = 'style' AND {d.has(style, d.lit('code'))} THEN 'code' ELSE item END"
    return f"SELECT category, count(*) AS n_errors FROM (SELECT {kind} AS category FROM ({checked(d)}) AS t, {d.each('t.errors')} AS e) AS k GROUP BY category"


@relational("first_k_errors")
def first_k_errors(d: Spark) -> str:
    """T5: the first ten lines with an error, a preview."""
    return f"SELECT shard, line_no, {d.elem('errors', 1)} AS error FROM ({checked(d)}) AS t WHERE {d.size('errors')} > 0 ORDER BY shard, line_no LIMIT 10"


@CORE.query("pandas_like_csv")
def pandas_like_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV reader with quotes and backslash escapes, bad lines left out; each physical line is a record."""
    lines = read(spark, sf_dir, "raw_lines").where(F.col("line_text") != "")
    schema = "description string, code string, style string, topic string, keywords string, bad string"
    row = F.from_csv("line_text", F.lit(schema), {"quote": '"', "escape": "\\", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return lines.select("line_id", row.alias("r")).where("r.bad IS NULL").select("line_id", "r.description", "r.style", "r.topic", "r.keywords")


def decode_any(data: bytes | None) -> tuple[str | None, str | None]:
    """The text and the first of four encodings that reads the bytes: UTF-8 with a mark, UTF-8, Windows-1251, Latin-1, which reads any."""
    if data is None:
        return None, None
    for name in ("utf-8-sig", "utf-8", "cp1251", "latin-1"):
        if name == "utf-8-sig" and data[:3] != b"\xef\xbb\xbf":
            continue
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    return None, None


def decoded(df: DataFrame, data: str) -> DataFrame:
    """`df` with a struct `_decoded` of text and encoding; NULL bytes have neither, empty ones are UTF-8."""

    @F.pandas_udf("struct<text:string,encoding:string>")
    def decode(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_any(x) for x in batch], columns=["text", "encoding"], dtype=object)

    return df.withColumn("_decoded", decode(data))


@CORE.query("encoding_fallback")
def encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in Windows-1251 where that holds all their characters, else in UTF-8, and read again."""

    @F.pandas_udf("binary")
    def written(batch: pd.Series) -> pd.Series:
        def one(x: str | None) -> bytes | None:
            try:
                return None if x is None else x.encode("cp1251")
            except UnicodeEncodeError:
                return x.encode("utf-8-sig")

        return batch.map(one)

    df = decoded(read(spark, sf_dir, "documents").select("doc_id", "text", written("text").alias("data")), "data")
    return df.select("doc_id", F.col("_decoded.encoding").alias("encoding"), (F.col("_decoded.text") == F.col("text")).alias("same"))


@CORE.query("file_checks")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the folder with their sizes, and which are empty; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(sf_dir)
    return files.select(F.regexp_extract("path", r"([^/]+(?:/part-[^/]+)?)$", 1).alias("file"), F.col("length").alias("n_bytes"), (F.col("length") == 0).alias("empty"))
