"""Profile of the corpus: lengths, hashes, styles, topics and gaps of the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import CORE
from corpusloom.runtime import read as _read

#: What Python's strip() removes; spelt out, as \s differs between the engines.
BLANK = r"[ \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SHARES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p80": 0.8, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def corpus_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the stripped texts that are not empty."""
    n = F.length(F.regexp_replace("text", rf"\A{BLANK}+|{BLANK}+\z", ""))
    sizes = _read(spark, sf_dir, "documents").select(n.cast("bigint").alias("n")).where("n > 0")
    return sizes.agg(
        F.count("*").alias("n_texts"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"),
        *(F.percentile("n", F.lit(p)).alias(c) for c, p in SHARES.items()), F.sum("n").alias("total_chars"),
    )


def snippet_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, preview and size of each program."""
    first = F.substring(F.substring_index("code", "\n", 1), 1, 100)
    more = F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit("")))
    return _read(spark, sf_dir, "examples").where("code IS NOT NULL").select(
        "example_id", F.substring(F.md5("code"), 1, 16).alias("code_hash"),
        F.concat(first, F.when(F.length(first) == 100, "...").otherwise(""), F.when(more > 0, F.concat(F.lit(" [+"), more.cast("string"), F.lit(" строк]"))).otherwise("")).alias("preview"),
        F.length("code").cast("bigint").alias("n_chars"), (more + 1).cast("bigint").alias("n_lines"),
    )


def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that stand in several examples."""
    hashed = _read(spark, sf_dir, "examples").where("code IS NOT NULL").groupBy(F.substring(F.md5("code"), 1, 16).alias("code_hash"))
    return hashed.agg(F.count("*").alias("n_examples"), F.min("example_id").alias("first_example")).where("n_examples > 1")


def style_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: physical lines by the first style name that they hold, a header in the first line of a shard left out."""
    lines = _read(spark, sf_dir, "raw_lines").where("NOT (line_no = 1 AND contains(line_text, 'description'))")
    named = F.when(F.col("line_text").contains("using_namespace_std"), "using_namespace_std").when(F.col("line_text").contains("explicit_std"), "explicit_std")
    counted = lines.select(named.alias("style")).where("style IS NOT NULL").groupBy("style").agg(F.count("*").alias("n_lines"))
    total = counted.agg(F.sum("n_lines").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("style", "n_lines", (F.col("n_lines") / F.col("total")).alias("ratio"))


def topic_style_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: examples of each style by topic, topics and styles as written, and how well they are balanced."""
    counted = _read(spark, sf_dir, "examples").where("topic IS NOT NULL").groupBy("topic").agg(
        F.count_if(F.col("style") == "using_namespace_std").alias("n_using"), F.count_if(F.col("style") == "explicit_std").alias("n_explicit")
    )
    least = F.least("n_using", "n_explicit")
    return counted.withColumn("state", F.when(least == 0, "problem").when(least < 2, "warning").otherwise("good"))


def vocab_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids between the least and the greatest that no token has."""
    ids = _read(spark, sf_dir, "bpe_vocab").select("token_id").where("token_id IS NOT NULL").distinct()
    return ids.agg(F.explode(F.sequence(F.min("token_id"), F.max("token_id"))).alias("token_id")).join(ids, "token_id", "left_anti")


def vocab_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens in more than one row, the empty token among them."""
    counted = _read(spark, sf_dir, "bpe_vocab").groupBy("token").agg(F.count("*").alias("n_rows"), F.countDistinct("token_id").alias("n_ids"))
    return counted.where("n_rows > 1")


SQL = {
    "corpus_length_stats": "SELECT count(*) AS n_texts, avg(n) AS mean, stddev_pop(n) AS std, min(n) AS min, max(n) AS max, "
    + ", ".join(f"quantile_cont(n, {p}) AS {c}" for c, p in SHARES.items())
    + rf", CAST(sum(n) AS BIGINT) AS total_chars FROM (SELECT CAST(length(regexp_replace(text, '\A{BLANK}+|{BLANK}+\z', '', 'g')) AS BIGINT) AS n FROM documents) WHERE n > 0",
    "snippet_preview": """
        SELECT example_id, substr(md5(code), 1, 16) AS code_hash,
            first || CASE WHEN length(first) = 100 THEN '...' ELSE '' END || CASE WHEN n > 1 THEN ' [+' || (n - 1) || ' строк]' ELSE '' END AS preview,
            CAST(length(code) AS BIGINT) AS n_chars, CAST(n AS BIGINT) AS n_lines
        FROM (SELECT example_id, code, left(string_split(code, chr(10))[1], 100) AS first, len(string_split(code, chr(10))) AS n FROM examples WHERE code IS NOT NULL)""",
    "duplicate_hashes": """
        SELECT substr(md5(code), 1, 16) AS code_hash, count(*) AS n_examples, min(example_id) AS first_example
        FROM examples WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "style_distribution": """
        SELECT style, count(*) AS n_lines, count(*) / sum(count(*)) OVER () AS ratio FROM (
            SELECT CASE WHEN contains(line_text, 'using_namespace_std') THEN 'using_namespace_std' WHEN contains(line_text, 'explicit_std') THEN 'explicit_std' END AS style
            FROM raw_lines WHERE NOT (line_no = 1 AND contains(line_text, 'description'))
        ) WHERE style IS NOT NULL GROUP BY style""",
    "topic_style_balance": """
        SELECT *, CASE WHEN n_using = 0 OR n_explicit = 0 THEN 'problem' WHEN n_using < 2 OR n_explicit < 2 THEN 'warning' ELSE 'good' END AS state FROM (
            SELECT topic, count(*) FILTER (style = 'using_namespace_std') AS n_using, count(*) FILTER (style = 'explicit_std') AS n_explicit
            FROM examples WHERE topic IS NOT NULL GROUP BY topic)""",
    "vocab_gaps": """
        SELECT CAST(i AS INTEGER) AS token_id FROM (SELECT unnest(range(min(token_id), max(token_id) + 1)) AS i FROM bpe_vocab)
        WHERE i NOT IN (SELECT token_id FROM bpe_vocab WHERE token_id IS NOT NULL)""",
    "vocab_duplicates": "SELECT token, count(*) AS n_rows, count(DISTINCT token_id) AS n_ids FROM bpe_vocab GROUP BY token HAVING count(*) > 1",
}

for _f in (corpus_length_stats, snippet_preview, duplicate_hashes, style_distribution, topic_style_balance, vocab_gaps, vocab_duplicates):
    CORE.query(_f.__name__, SQL[_f.__name__])(_f)
