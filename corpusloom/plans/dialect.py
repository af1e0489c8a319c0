"""Relational queries written once over a small set of building blocks, which Spark SQL runs and DuckDB checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.byte_runs import byte_runs
from corpusloom.runtime import CORE, read


class Spark:
    """How Spark SQL writes each block."""

    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + "".join({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c) for c in s) + "'"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep) if sep else '')}, -1)"

    def each(self, array: str) -> str:
        return f"LATERAL (SELECT posexplode({array}) AS (pos, item))"

    def transform(self, a: str, e: str) -> str:
        return f"transform({a}, x -> {e})"

    def filter(self, a: str, e: str) -> str:
        return f"filter({a}, x -> {e})"

    def exists(self, a: str, e: str) -> str:
        return f"exists({a}, x -> {e})"

    def elem(self, a: str, i: str | int) -> str:
        return f"try_element_at({a}, {i})"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, {start}, {n})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def concat(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def repeat(self, x: str, n: str) -> str:
        return f"array_repeat({x}, CAST({n} AS INT))"

    def match(self, s: str, p: str) -> str:
        return f"regexp_like({s}, {self.lit(p)})"

    def sub(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, {self.lit(p)}, {self.lit(r)})"

    def extract(self, s: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({s}, {self.lit(p)}, {g})"

    def find(self, s: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(p)}, {g})"

    def has(self, s: str, t: str) -> str:
        return f"contains({s}, {t})"

    def pct(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def chars(self, x: str) -> str:
        return f"split({x}, '')"

    def utf8(self, x: str) -> str:
        return f"octet_length({x})"

    def code(self, ch: str) -> str:
        return f"ascii({ch})"

    def series(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def hashed(self, x: str, seed: int = 42) -> str:
        """A place in an order that is fixed but tells nothing of the id."""
        return f"md5(concat('{seed}:', CAST({x} AS STRING)))"


class Duck(Spark):
    """How DuckDB writes each block."""

    name = "duck"

    def lit(self, s: str) -> str:
        return ("E" if re.search(r"[\\\n\t\r]", s) else "") + ("'" + s.replace("'", "''") + "'" if not re.search(r"[\\\n\t\r]", s) else super().lit(s))

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def each(self, array: str) -> str:
        return f"LATERAL (SELECT generate_subscripts({array}, 1) - 1 AS pos, unnest({array}) AS item)"

    def transform(self, a: str, e: str) -> str:
        return f"[{e} for x in {a}]"

    def filter(self, a: str, e: str) -> str:
        return f"[x for x in {a} if {e}]"

    def exists(self, a: str, e: str) -> str:
        return f"(len([x for x in {a} if {e}]) > 0)"

    def elem(self, a: str, i: str | int) -> str:
        return f"({a})[{i}]"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"({a})[({start}):(({start}) + ({n}) - 1)]"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def concat(self, *a: str) -> str:
        return f"({' || '.join(a)})"

    def repeat(self, x: str, n: str) -> str:
        return f"[{x} for i in range(CAST({n} AS BIGINT))]"

    def match(self, s: str, p: str) -> str:
        return f"regexp_matches({s}, {self.lit(p)})"

    def sub(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, {self.lit(p)}, {self.lit(re.sub(r'[$]([0-9])', chr(92) + r'\1', r))}, 'g')"

    def find(self, s: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(p)}, {g})"

    def pct(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def chars(self, x: str) -> str:
        return f"string_split({x}, '')"

    def utf8(self, x: str) -> str:
        return f"octet_length(CAST(encode({x}) AS BLOB))"

    def code(self, ch: str) -> str:
        return f"unicode({ch})"

    def series(self, a: str, b: str) -> str:
        return f"range({a}, ({b}) + 1)"

    def hashed(self, x: str, seed: int = 42) -> str:
        return f"md5('{seed}:' || CAST({x} AS VARCHAR))"


TABLES = (
    "raw_lines examples source_files compile_results request_log bpe_vocab bpe_merges documents eval_items subject_areas doc_labels context_windows "
    "events embeddings region nation customer supplier part orders lineitem"
).split()
#: The columns of each table; any other, which could clash with names within a query, is left out.
COLUMNS = {
    "raw_lines": "line_id shard line_no line_text",
    "examples": "example_id line_no description code style topic keywords style_type code_hash code_snippet code_length lines_in_code split source lang loaded_at",
    "source_files": "file_id repo file_path lang code topic style fetched_at",
    "compile_results": "result_id example_id success line_number topic style description error_message warnings compile_time code_hash code_snippet compiled_at received_at",
    "request_log": "request_id client_ip endpoint ts received_at n_chars",
    "bpe_vocab": "token_id token",
    "bpe_merges": "merge_rank left_token right_token",
    "documents": "doc_id text lang source n_chars doc_kind added_at",
    "doc_labels": "doc_id subject labelled_by labelled_at",
    "events": "event_id ts user_id event_type value props",
}
Text = Callable[[Spark], str]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over the tables of a folder; a table is written {name}."""
    frames = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    frames |= {f"bytes_{n}": byte_runs(read(spark, sf_dir, "documents"), "text", n) for n in (1, 2) if f"{{bytes_{n}}}" in sql}
    for t, df in frames.items():
        view = f"corpusloom_{t}"
        df.select(*(c for c in COLUMNS.get(t, "").split() or df.columns if c in df.columns)).createOrReplaceTempView(view)
        sql = sql.replace("{" + t + "}", view)
    return spark.sql(sql)


def relational(name: str) -> Callable[[Text], Text]:
    """Registers the query that the function writes in either dialect."""

    def add(text: Text) -> Text:
        oracle = text(Duck())
        for t in TABLES:
            oracle = oracle.replace("{" + t + "}", t)

        @CORE.query(name, oracle)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, sf_dir, text(Spark()))

        query.__doc__ = text.__doc__
        return text

    return add
