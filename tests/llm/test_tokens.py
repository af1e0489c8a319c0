import random

import pyarrow as pa
from corpusloom.llm import LLM
from corpusloom.llm.tokens import STRETCH, Matcher, as_bytes, totals
from corpusloom.llm.windows import Packer, pack
from pyspark.sql import functions as F


def brute(text: bytes, tokens: set[bytes]) -> int:
    n = at = 0
    most = max(map(len, tokens))
    while at < len(text):
        at += next((k for k in range(most, 0, -1) if text[at : at + k] in tokens), 1)
        n += 1
    return n


def test_longest_match():
    rng = random.Random(4)
    for size in (1, 6, 40, 300):
        tokens = {bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randrange(1, 9))) for _ in range(size)}
        m = Matcher(sorted(tokens))
        texts = ["".join(rng.choice("abcdeфé") for _ in range(rng.choice((0, 1, 9, 70, 5 * STRETCH)))) for _ in range(80)] + [None, "a" * 3000]
        assert m.count_arrow(pa.array(texts)).to_pylist() == [brute((t or "").encode(), tokens) for t in texts]
        part = pa.array(texts).slice(7, 20)
        assert m.count_arrow(part).to_pylist() == [brute((t or "").encode(), tokens) for t in texts[7:27]]
    assert m.count_arrow(pa.array([], pa.string())).to_pylist() == [] and as_bytes("a") == b"a\0" and as_bytes("я") is None


def test_totals_join_spellings(spark):
    df = spark.createDataFrame([("a", "Web Dev", 3), ("a", "web_dev", 4), ("a", "web_dev", 1), ("a", None, 2), ("b", "x", 0)], "origin string, kind string, n int")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in totals(df, ["origin", "kind"], "n", ("kind",)).collect()}
    assert got == {("a", "web_dev"): (3, 8), ("a", None): (1, 2), ("b", "x"): (1, 0)}


def test_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = LLM.queries["p3_tokens"](spark, d)
    assert rows.count() == sum(spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("examples", "source_files", "documents"))
    assert rows.agg({"n_tokens": "sum"}).first()[0] == LLM.queries["p3_totals"](spark, d).agg({"n_tokens": "sum"}).first()[0]


def test_packer():
    rng = random.Random(3)
    p = Packer(64, 8)
    used: dict[int, int] = {}
    for size in [0, 64, 65, 640, *(rng.randrange(1, 90) for _ in range(4000))]:
        rows = p.put_all(size)
        assert sum(r[2] for r in rows) == size and len(rows) == max(1, -(-size // 64))
        for _, _, n, window, _ in rows:
            used[window] = used.get(window, 0) + n
        assert p.open <= 8 and p.open == sum(map(len, p.windows.values()))
    assert max(used.values()) <= 64 and sum(used.values()) / 64 / len(used) > 0.8


def test_pack_is_the_same_in_any_partitioning(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(k, rng.randrange(0, 300), "clash") for k in range(700)] + [(900, None, "clash")], "doc_id long, n int, lane string")
    rows = [sorted(map(tuple, pack(df.repartition(k), "doc_id", "n", [(1, 50), (2, 200)], 5).collect())) for k in (1, 4, 16)]
    assert rows[0] == rows[1] == rows[2] and {r[1] for r in rows[0]} == {*range(700), 900}
    assert pack(df.limit(0), "doc_id", "n", [(1, 50)], 1).count() == 0


def test_every_window_is_filled(spark, tmp_path):
    """Also where there are more of them than one task packs; each as if it were the only one."""
    spark.createDataFrame([(k, "a word " * (k * 7)) for k in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    windows = [(k, "w", 10 + k) for k in range(1, 1201)]
    spark.createDataFrame([*windows, windows[0], (1201, "w", 0), (1202, "w", None)], "window_id int, window_name string, capacity_tokens int").write.parquet(f"{tmp_path}/context_windows.parquet")
    rows = LLM.queries["p7_windows"](spark, str(tmp_path))
    assert {tuple(r) for r in rows.groupBy("window_id").agg(F.countDistinct("doc_id")).collect()} == {(k, 6) for k, _, _ in windows}
    assert {r["window_id"] for r in LLM.queries["p7_fill"](spark, str(tmp_path)).collect()} == {k for k, _, _ in windows}
    sized = spark.createDataFrame([(k, k * 9) for k in range(60)], "doc_id long, n int")
    every = [(k, c) for k, _, c in windows[::150]]
    alone = {tuple(r) for w in every for r in pack(sized, "doc_id", "n", [w], 3).collect()}
    among = [tuple(r) for r in pack(sized, "doc_id", "n", [(k, c) for k, _, c in windows], 3).where(F.col("window_id").isin([k for k, _ in every])).collect()]
    assert set(among) == alone and len(among) == len(alone)
