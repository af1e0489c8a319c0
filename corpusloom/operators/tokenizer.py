"""The byte-level tokenizer of bpe_vocab and bpe_merges on texts: encoding, decoding, quality, and training."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.bpe import BYTES, Decoder, Encoder, byte_token, greedy
from corpusloom.plans.dialect import Duck
from corpusloom.runtime import CORE, cut, kept, read

#: Most rows of a vocabulary or merge list that is sent to the workers; its size does not follow the corpus.
MOST = 1_000_000
OPEN, CLOSE = "﷐", "﷑"


def model(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """Merges in rank order, each pair at its lowest rank, and the least id of each token."""
    merges = read(spark, sf_dir, "bpe_merges").where("left_token <> '' AND right_token <> ''").groupBy("left_token", "right_token").agg(F.min("merge_rank").alias("rank"))
    tokens = read(spark, sf_dir, "bpe_vocab").where("token <> ''").groupBy("token").agg(F.min("token_id").alias("id"))
    rows, ids = merges.orderBy("rank", "left_token", "right_token").limit(MOST + 1).collect(), tokens.limit(MOST + 1).collect()
    if max(len(rows), len(ids)) > MOST:
        raise ValueError(f"a vocabulary of more than {MOST} rows")
    return [(r["left_token"], r["right_token"]) for r in rows if all(c in BYTES for c in r["left_token"] + r["right_token"])], {r["token"]: r["id"] for r in ids}


def encoder(spark: SparkSession, sf_dir: str):
    """A column function: the ids of a text. Batches go through Arrow; the model is sent once and kept by each worker."""
    shared = spark.sparkContext.broadcast(model(spark, sf_dir))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = kept(("bpe", hash(str(shared.value[0][:50])), len(shared.value[0]), len(shared.value[1])), lambda: Encoder(*shared.value))
        for texts in batches:
            yield pd.Series([x for k in range(0, len(texts), 500) for x in e.encode(list(texts[k : k + 500]))], dtype=object)

    return encode


def decoder(spark: SparkSession, sf_dir: str):
    shared = spark.sparkContext.broadcast({i: t for t, i in model(spark, sf_dir)[1].items()})

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        x = Decoder(shared.value)
        for ids in batches:
            yield ids.map(lambda a: None if a is None else x.decode(list(a)))

    return decode


def joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",")


def folded_sql(table: str, key: str, text: str) -> str:
    """DuckDB's side: a text's bytes as marked tokens, through which the merges are folded in the order of their ranks."""
    d = Duck()
    names = "[" + ", ".join(d.lit(byte_token(b)) for b in range(256)) + "]"
    return (
        f"WITH b AS (SELECT {names} AS names), m AS (SELECT list('{OPEN}' || left_token || '{CLOSE}{OPEN}' || right_token || '{CLOSE}' ORDER BY r, left_token, right_token) AS ms FROM "
        f"(SELECT left_token, right_token, min(merge_rank) AS r FROM bpe_merges WHERE left_token <> '' AND right_token <> '' GROUP BY ALL)), "
        f"h AS (SELECT {key} AS k, hex(encode({text})) AS h FROM {table} WHERE {text} IS NOT NULL), "
        f"s AS (SELECT k, array_to_string(['{OPEN}' || names[CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) + 1] || '{CLOSE}' for i in range(len(h) // 2)], '') AS s FROM h, b), "
        f"e AS (SELECT k, list_reduce(ms, lambda a, x: replace(a, x, '{OPEN}' || replace(replace(x, '{OPEN}', ''), '{CLOSE}', '') || '{CLOSE}'), s) AS e FROM s, m), "
        f"tokens AS (SELECT k, CASE WHEN e = '' THEN [] ELSE string_split(substr(e, 2, length(e) - 2), '{CLOSE}{OPEN}') END AS ts FROM e), "
        f"inverse AS (SELECT token, min(token_id) AS id FROM bpe_vocab WHERE token <> '' GROUP BY token) "
    )


BPE_SQL = folded_sql("examples", "example_id", "code") + (
    "SELECT t.k AS example_id, len(t.ts) AS n_tokens, coalesce(x.ids, '') AS ids FROM tokens AS t LEFT JOIN "
    "(SELECT k, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ',' ORDER BY pos) AS ids FROM (SELECT k, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM tokens) AS u LEFT JOIN inverse USING (token) GROUP BY k) AS x ON x.k = t.k"
)


@CORE.query("bpe_encode", BPE_SQL)
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every program, lowest rank first. The mark that ends a word is no token of this vocabulary and is not counted."""
    rows = read(spark, sf_dir, "examples").where("code IS NOT NULL").select("example_id", encoder(spark, sf_dir)("code").alias("ids"))
    return rows.select("example_id", F.size("ids").cast("bigint").alias("n_tokens"), joined("ids").alias("ids"))


@CORE.query("bpe_decode_roundtrip", "SELECT example_id, code AS decoded, TRUE AS same FROM examples WHERE code IS NOT NULL")
def bpe_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every program encoded and decoded again."""
    back = decoder(spark, sf_dir)(encoder(spark, sf_dir)("code"))
    return read(spark, sf_dir, "examples").where("code IS NOT NULL").select("example_id", "code", back.alias("decoded")).select("example_id", "decoded", (F.col("code") == F.col("decoded")).alias("same"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "doc_kind", "text", encoder(spark, sf_dir)("text").alias("ids"))


@CORE.query("roundtrip_accuracy", "SELECT doc_kind, CAST(1 AS DOUBLE) AS accuracy, count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_kind IS NOT NULL GROUP BY doc_kind UNION ALL SELECT 'all', CAST(1 AS DOUBLE), count(*) FROM documents WHERE text IS NOT NULL")
def roundtrip_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of documents that come back exactly, by kind and in all."""
    same = (decoder(spark, sf_dir)("ids") == F.col("text")).cast("double")
    rows = _encoded(spark, sf_dir).select("doc_kind", same.alias("same"))
    by = rows.where("doc_kind IS NOT NULL").groupBy("doc_kind").agg(F.avg("same").alias("accuracy"), F.count("*").alias("n"))
    return by.unionByName(rows.agg(F.avg("same").alias("accuracy"), F.count("*").alias("n")).withColumn("doc_kind", F.lit("all")))


COMPRESSION_SQL = folded_sql("documents", "doc_id", "text") + (
    "SELECT coalesce(doc_kind, 'none') AS doc_kind, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(ts)) AS BIGINT) AS n_tokens, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, sum(length(text)) / nullif(sum(len(ts)), 0) AS ratio, "
    "CAST(4 * sum(len(ts)) AS BIGINT) AS token_bytes FROM tokens JOIN documents ON doc_id = k GROUP BY coalesce(doc_kind, 'none')"
)


@CORE.query("compression_rollup", COMPRESSION_SQL)
def compression_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, tokens, bytes and the ratio of their sums, by kind of document."""
    rows = _encoded(spark, sf_dir).select(F.coalesce("doc_kind", F.lit("none")).alias("doc_kind"), F.length("text").alias("c"), F.size("ids").alias("t"), F.octet_length("text").alias("b"))
    sums = rows.groupBy("doc_kind").agg(F.sum("c").alias("n_chars"), F.sum("t").alias("n_tokens"), F.sum("b").alias("n_bytes"))
    return sums.select("*", F.try_divide("n_chars", "n_tokens").alias("ratio"), (F.col("n_tokens") * 4).alias("token_bytes"))


@CORE.query("per_text_token_stats", folded_sql("documents", "doc_id", "text") + "SELECT k AS doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ts)) AS BIGINT) AS n_distinct, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, len(ts) * 400.0::DOUBLE / nullif(octet_length(encode(text)), 0) AS percent FROM tokens JOIN documents ON doc_id = k")
def per_text_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, distinct ones, bytes, and four bytes a token as a share of the bytes."""
    rows = _encoded(spark, sf_dir)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("ids")).cast("bigint").alias("n_distinct"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.try_divide(F.size("ids") * 400.0, F.octet_length("text")).alias("percent"))


@CORE.query("token_depth", folded_sql("documents", "doc_id", "text") + "SELECT CAST(length(token) AS BIGINT) AS n_bytes, count(*) AS n, count(DISTINCT token) AS n_distinct FROM (SELECT unnest(ts) AS token FROM tokens) AS u GROUP BY length(token)")
def token_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the corpus by their length; ids are counted before they meet the vocabulary."""
    counts = _encoded(spark, sf_dir).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    tokens = read(spark, sf_dir, "bpe_vocab").where("token <> ''").groupBy("token").agg(F.min("token_id").alias("id"))
    return counts.join(F.broadcast(tokens.limit(MOST)), "id").groupBy(F.length("token").cast("bigint").alias("n_bytes")).agg(F.sum("n").alias("n"), F.countDistinct("token").alias("n_distinct"))


@CORE.query("byte_encode", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_ids FROM documents WHERE text IS NOT NULL")
def byte_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte is an id, nothing is merged."""
    ids = F.transform(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(ids).cast("bigint").alias("n_ids"))


@CORE.query("greedy_encode")
def greedy_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes on a stack, the two on top merged whenever there is a rule, whatever its rank."""
    merges, ids = model(spark, sf_dir)
    shared = spark.sparkContext.broadcast(({(ids[x], ids[y]): ids[x + y] for x, y in reversed(merges) if x in ids and y in ids and x + y in ids}, [ids.get(byte_token(b), 1) for b in range(256)]))

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules, of = shared.value
        for texts in batches:
            yield texts.map(lambda t: len(greedy([of[b] for b in t.encode("utf-8", "replace")], rules)))

    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", count("text").alias("n_tokens"))


@CORE.query("encoder_agreement")
def encoder_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs by whether the ranked and the greedy way give as many tokens."""
    ranked = _encoded(spark, sf_dir).select("doc_id", F.size("ids").alias("a"))
    return ranked.join(greedy_encode(spark, sf_dir), "doc_id").groupBy((F.col("a") == F.col("n_tokens")).alias("same")).agg(F.count("*").alias("n"), F.avg(F.col("n_tokens") - F.col("a")).alias("mean_difference"))


@CORE.query("dedup_encode", folded_sql("documents", "doc_id", "text") + "SELECT k AS doc_id, CAST(len(ts) AS BIGINT) AS n_tokens FROM tokens")
def dedup_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text is encoded once, told by a 128-bit hash, and its tokens joined back; texts move once, in partial groups."""
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("hash"), "text")
    once = rows.groupBy("hash").agg(F.first("text").alias("text")).select("hash", F.size(encoder(spark, sf_dir)("text")).cast("bigint").alias("n_tokens"))
    return rows.select("doc_id", "hash").join(once, "hash").select("doc_id", "n_tokens")


@CORE.query("fast_decode", "SELECT example_id, description AS decoded FROM examples WHERE description IS NOT NULL")
def fast_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed ids decoded, the special ones dropped."""
    ids = F.concat(F.array(F.lit(2)), encoder(spark, sf_dir)("description"), F.array(F.lit(3), F.lit(0)))
    return read(spark, sf_dir, "examples").where("description IS NOT NULL").select("example_id", decoder(spark, sf_dir)(ids).alias("decoded"))


def train(words: DataFrame, n_merges: int, least: int = 2) -> list[tuple[str, str, int]]:
    """Merges learnt from (symbols, n): the commonest pair each time, ties by its left and right symbol, every merge a new token.

    Symbols stand in one string between marks. Pairs are counted once over all rows; after a merge only the rows that hold the pair
    are counted anew, what they had before is taken off and what they have now put on. Rows and counts stay distributed and are
    written to the shared checkpoint folder; the driver sees the best pair of each round. Fewer merges come out where no
    pair is left that comes `least` times.
    """

    def pairs(rows: DataFrame, sign: int) -> DataFrame:
        s = F.split(F.expr("substring(symbols, 2, length(symbols) - 2)"), f"{CLOSE}{OPEN}")
        two = F.arrays_zip(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))).alias("l"), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))).alias("r"))
        return rows.where("symbols <> ''").select(F.explode(two).alias("p"), "n").groupBy("p.l", "p.r").agg((F.sum("n") * sign).alias("n"))

    words = cut(words.groupBy("symbols").agg(F.sum("n").alias("n")))
    counts = cut(pairs(words, 1))
    out: list[tuple[str, str, int]] = []
    made: set[str] = set()
    while len(out) < n_merges:
        best = counts.where(F.col("n") >= least).where(~F.concat("l", "r").isin(*made) if made else F.lit(True)).orderBy(F.desc("n"), "l", "r").first()
        if best is None:
            break
        out.append((best["l"], best["r"], best["n"]))
        made.add(best["l"] + best["r"])
        old = f"{OPEN}{best['l']}{CLOSE}{OPEN}{best['r']}{CLOSE}"
        hit = F.col("symbols").contains(old)
        merged = F.replace("symbols", F.lit(old), F.lit(f"{OPEN}{best['l']}{best['r']}{CLOSE}"))
        before = words.where(hit)
        delta = pairs(before, -1).unionByName(pairs(before.select(merged.alias("symbols"), "n"), 1))
        counts = cut(counts.unionByName(delta).groupBy("l", "r").agg(F.sum("n").alias("n")).where("n > 0"))
        words = cut(words.select(F.when(hit, merged).otherwise(F.col("symbols")).alias("symbols"), "n"))
    return out


def byte_symbols(text: Column) -> Column:
    """A text's bytes as marked hexadecimal numbers."""
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", f"{OPEN}$1{CLOSE}")


def _merges(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "merge_rank int, left_token string, right_token string, n bigint")


@CORE.query("bpe_train_small")
def bpe_train_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight merges of bytes, in hexadecimal, learnt from whole descriptions."""
    texts = read(spark, sf_dir, "examples").where("description <> ''").select(byte_symbols(F.col("description")).alias("symbols"), F.lit(1).alias("n"))
    return _merges(spark, train(texts, 8))


@CORE.query("bpe_train_total_order")
def bpe_train_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from program previews; a total order of ties makes the result the same on any cluster."""
    texts = read(spark, sf_dir, "examples").where("code_snippet <> ''").select(byte_symbols(F.col("code_snippet")).alias("symbols"), F.lit(1).alias("n"))
    return _merges(spark, train(texts, 5))


@CORE.query("word_bpe_train")
def word_bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges within words, which are counted first."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return _merges(spark, train(words.where("n >= 2").select(byte_symbols(F.col("w")).alias("symbols"), "n"), 8))


@CORE.query("bpe_train_job")
def bpe_train_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary from a job: special tokens, bytes, then the merges of topics."""
    texts = read(spark, sf_dir, "examples").where("topic <> ''").select(byte_symbols(F.col("topic")).alias("symbols"), F.lit(1).alias("n"))
    merges = _merges(spark, train(texts, 4))
    special = spark.createDataFrame([(k, t) for k, t in enumerate(("<PAD>", "<UNK>", "<BOS>", "<EOS>"))], "id int, token string")
    single = spark.range(256).select((F.col("id") + 4).cast("int").alias("id"), F.lpad(F.hex("id"), 2, "0").alias("token"))
    return special.unionByName(single).unionByName(merges.select((F.col("merge_rank") + 260).alias("id"), F.concat("left_token", "right_token").alias("token")))
