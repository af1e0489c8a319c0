"""Operators that SQL does not express, against brute force, round trips and streams."""

import random
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from corpusloom.functions.bpe import UNK, Decoder, Encoder, byte_token, greedy
from corpusloom.operators.tokenizer import byte_symbols, train
from corpusloom.runtime import CORE
from corpusloom.sources import files
from corpusloom.sources.dataset_lines import decode_any
from corpusloom.streaming.limits import Limiter, first_seen_stream, rate_limited, rate_limited_stream
from pyspark.sql import functions as F

ROOT = Path(__file__).parents[1]
DATA = "/root/testdata/sf0.001"


def lowest_rank_first(text: bytes, merges: list[tuple[str, str]]) -> list[str]:
    ranks = {m: k for k, m in reversed(list(enumerate(merges)))}
    word = [byte_token(b) for b in text]
    while best := min((ranks[p], p) for p in pairs) if (pairs := [p for p in zip(word, word[1:]) if p in ranks]) else None:
        out, i = [], 0
        while i < len(word):
            hit = tuple(word[i : i + 2]) == best[1]
            out.append("".join(word[i : i + 2]) if hit else word[i])
            i += 1 + hit
        word = out
    return word


def test_one_encoder_at_every_vocabulary_size():
    rng = random.Random(5)
    for size in (1, 5, 40, 900):  # also merges whose operands come up later
        known, merges = list("abcd "), []
        for _ in range(size):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in merges and len("".join(pair)) < 12:
                merges.append(pair)
                known.append("".join(pair))
        rng.shuffle(merges)
        tokens = [byte_token(b) for b in range(256)] + [x + y for x, y in merges]
        ids = {t: k + 4 for k, t in enumerate(dict.fromkeys(tokens))}
        encoder, decoder = Encoder(merges, ids), Decoder({i: t for t, i in ids.items()})
        texts = ["".join(rng.choice("abcd xй") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
        got = encoder.encode([*texts, None])
        assert got[-1] is None and [[ids[t] for t in lowest_rank_first(x.encode(), merges)] for x in texts] == got[:-1]
        assert [decoder.decode(x) for x in got[:-1]] == texts
    assert Encoder([], {}).encode(["ab", ""]) == [[UNK, UNK], []] and len(Encoder(merges, ids).encode(["a" * 100_000])[0]) > 0
    assert decoder.decode([2, 3, ids["Ð"], 10**6]) == "" and greedy([1, 1, 1, 1], {(1, 1): 2, (2, 2): 3}) == [3] and greedy([], {}) == []


def test_training_as_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcя ") for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["aaaa", "aaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(byte_symbols(F.col("t")).alias("symbols"), F.lit(1).alias("n"))
    rows, made, want = [[f"{b:02X}" for b in t.encode()] for t in texts], set(), []
    for _ in range(6):
        pairs = Counter(p for r in rows for p in zip(r, r[1:]))
        (left, right), n = min(((p, n) for p, n in pairs.items() if "".join(p) not in made), key=lambda x: (-x[1], x[0]))
        want.append((left, right, n))
        made.add(left + right)
        for k, r in enumerate(rows):
            out, i = [], 0
            while i < len(r):
                hit = r[i : i + 2] == [left, right]
                out.append(left + right if hit else r[i])
                i += 1 + hit
            rows[k] = out
    assert train(df, 6) == want
    assert train(df.limit(0), 3) == []


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql) - {"p2_found", "p2_loaded", "p5_found"}))
def test_queries_without_sql_run(spark, name):
    df = CORE.queries[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_encodings():
    assert decode_any("день".encode("cp1251")) == ("день", "cp1251") and decode_any("день".encode()) == ("день", "utf-8") and decode_any("x".encode("utf-8-sig")) == ("x", "utf-8-sig")
    assert decode_any(b"\x98\xff") == ("\x98ÿ", "latin-1") and decode_any(None) == (None, None) and decode_any(b"") == ("", "utf-8")


def requests(n, rng):
    t = datetime(2025, 1, 1)
    out = []
    for k in range(n):
        t += timedelta(seconds=rng.choice((0, 0.2, 1, 5, 40, 61, 300)))
        out.append((k, rng.choice(("a", "a", "a", "b", None)), t))
    return out


def brute(rows, most):
    by, out = {}, {}
    for k, c, t in sorted(set(rows), key=lambda r: (r[2], r[0])):
        out[k] = (c, *by.setdefault(c, Limiter(most=most)).take(__import__("pandas").Timestamp(t)))
    return {k: (c, a, s.to_pydatetime(), n) for k, (c, a, s, n) in out.items()}


def test_rate_limit(spark):
    rows = requests(900, random.Random(2))
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:40]] + [(5000, "a", None, "x")], "request_id long, client_ip string, ts timestamp, allowed string")
    got = {r["request_id"]: tuple(r)[1:] for r in rate_limited(df, most=4).collect()}
    assert got == brute(rows, 4) and any(not x[1] for x in got.values())
    assert rate_limited(df.limit(0)).count() == 0


def test_stream_limits_as_the_table(spark, tmp_path):
    rows = [r for r in requests(300, random.Random(6)) if r[1]]
    schema = "request_id long, client_ip string, ts timestamp"
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:04}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = rate_limited_stream(stream, most=3).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["request_id"]: tuple(r)[1:] for r in spark.sql("SELECT * FROM limited").collect()}
    assert got == brute(rows, 3)
    seen = first_seen_stream(stream, ["client_ip"], seconds=10**7).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/d").start()
    seen.processAllAvailable()
    seen.stop()
    assert spark.sql("SELECT count(*) FROM seen").first()[0] == len({r[1] for r in rows})


def test_sinks(spark, tmp_path):
    texts = ["a\nb", "back\\slash \\n", "", "последний"]
    df = spark.createDataFrame([(t, "int x;\n\"q\" \\") for t in texts], "text string, code string")
    files.write_corpus(df, "text", f"{tmp_path}/corpus")
    assert sorted(r[0] for r in files.read_corpus(spark, f"{tmp_path}/corpus").collect()) == sorted(texts)
    files.write_instructions(df, "text", "code", f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").where(F.col("text").startswith("a\nb\n\nint x;")).count() == 1
    from corpusloom.operators.records import parse_records

    five = df.select(F.col("text").alias("description"), "code", F.lit("explicit_std").alias("style"), F.lit("t").alias("topic"), F.lit('k, "l"').alias("keywords")).where("description <> ''")
    files.write_records(five, five.columns, f"{tmp_path}/csv")
    back = parse_records(spark.read.text(f"{tmp_path}/csv"), "value").select("_record.*").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, five.collect()))
    vocab, merges = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("bpe_vocab", "bpe_merges"))
    files.write_model(vocab, merges, f"{tmp_path}/model")
    v, m = files.read_model(spark, f"{tmp_path}/model")
    assert v.exceptAll(vocab).count() == 0 == m.exceptAll(merges).count() and m.count() == merges.count()
    ids = spark.createDataFrame([(1, [1, 2]), (2, [])], "id int, ids array<int>")
    files.write_tokens(ids, f"{tmp_path}/ids")
    files.write_report(ids, f"{tmp_path}/report")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/ids").collect())) == [(1, [1, 2]), (2, [])] and spark.read.json(f"{tmp_path}/report").count() == 2
    with pytest.raises(Exception):
        files.write_tokens(ids, f"{tmp_path}/ids")


def test_settings_and_compiler(spark):
    files.validate_config(256)
    for bad in ((255, 0), (100_001, 0), (300, -1), (300, 100_001)):
        with pytest.raises(ValueError):
            files.validate_config(*bad)
    df = spark.createDataFrame([(1, "int x;"), (2, None)], "id int, code string")
    assert {r["id"]: r["success"] for r in files.compiled(df, "id", "code", "no-such-compiler").collect()} == {1: None, 2: None}
    assert {r["id"]: r["success"] for r in files.compiled(df, "id", "code", "true").collect()} == {1: True, 2: None}


def test_partitions_do_not_matter(spark, tmp_path):
    """The same ids, limits and places on 1, 4 and 16 partitions."""
    for n in (1, 4, 16):
        for t in ("examples", "request_log", "bpe_vocab", "bpe_merges"):
            spark.read.parquet(f"{DATA}/{t}.parquet").repartition(n).write.parquet(f"{tmp_path}/{n}/{t}.parquet")
    for name in ("bpe_encode", "rate_limit", "fixed_split", "hash_sample"):
        rows = [sorted(map(str, CORE.queries[name](spark, f"{tmp_path}/{n}").collect())) for n in (1, 4, 16)]
        assert rows[0] == rows[1] == rows[2], name


def test_without_the_llm_subpackage(tmp_path):
    """With its folder gone everything else still imports, and its queries are not there."""
    subprocess.run(["cp", "-r", str(ROOT / "corpusloom"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "corpusloom/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert "p2_found" in said and "p5_found" in said and not [x for x in said if x.startswith(("p1_", "p3_", "p4_", "p6_", "p7_", "p8_", "p9_"))]
    assert not [p for p in ROOT.glob("corpusloom/**/*.py") if "llm" not in p.parts and "corpusloom.llm" in p.read_text()]


def test_byte_runs_as_brute_force(spark):
    from corpusloom.functions.byte_runs import byte_runs

    texts = ["ab", "", None, "é", "aab", "x" * 5000, "b"]
    for n in (1, 2):
        want = Counter(b[i : i + n].hex().upper() for t in texts if t for b in [t.encode()] for i in range(len(b) - n + 1))
        for parts in (1, 3):
            assert dict(map(tuple, byte_runs(spark.createDataFrame([(t,) for t in texts], "t string").repartition(parts), "t", n).collect())) == want
    assert byte_runs(spark.createDataFrame([], "t string"), "t", 2).count() == 0
