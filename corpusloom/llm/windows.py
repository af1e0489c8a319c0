"""Texts put into context windows of fixed capacity: queries p7_windows and p7_fill."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.registry import LLM
from corpusloom.runtime import kept, read

#: The public tokenizer: a file of ranks, and how it parts a text before merging.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Windows that are open at a time in a lane, and texts for which there is a lane. Lanes follow the table, not the cluster.
OPEN, LANE = 512, 20_000
#: Capacities for which a task packs at a time, and rows that it hands on at a time.
PART, ROWS = 64, 100_000


class Packer:
    """Bounded-space online best fit: open windows stand in a bitset by free space; where one too many is open, the fullest closes."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.open, self.used = 0, 0, 0
        self.windows: dict[int, list[tuple[int, int]]] = {}  # free space: (window, texts in it)

    def put(self, size: int) -> tuple[int, int]:
        """The window of an item that fits, and its place in it."""
        at = self.bits >> size
        if at:
            space = size + (at & -at).bit_length() - 1
            held = self.windows[space]
            window, place = held.pop()
            if not held:
                self.bits ^= 1 << space
            self.open -= 1
        else:
            space, window, place = self.capacity, self.used, 0
            self.used += 1
        rest = space - size
        if rest:
            self._keep(rest, window, place + 1)
        return window, place

    def _keep(self, space: int, window: int, texts: int) -> None:
        if not self.bits >> space & 1:
            self.bits |= 1 << space
            self.windows[space] = []
        self.windows[space].append((window, texts))
        self.open += 1
        if self.open > self.most_open:
            fullest = (self.bits & -self.bits).bit_length() - 1
            self.windows[fullest].pop()
            if not self.windows[fullest]:
                self.bits ^= 1 << fullest
            self.open -= 1

    def put_all(self, size: int) -> list[tuple[int, int, int, int, int]]:
        """(piece, its first token, its tokens, window, place). Only an item over the capacity is split: full windows, then a rest."""
        out = []
        full = (size - 1) // self.capacity if size > self.capacity else 0
        for k in range(full):
            out.append((k, k * self.capacity, self.capacity, self.used, 0))
            self.used += 1
        rest = size - full * self.capacity
        return [*out, (full, full * self.capacity, rest, *self.put(rest))]


def token_counter(spark: SparkSession, path: str = TOKENIZER, pattern: str = PATTERN):
    """A column function: the tokens of a text under a public tokenizer, read on the driver and sent once (under 1 MB; over 64 MB is refused)."""
    data = Path(path).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large for a tokenizer")
    shared = spark.sparkContext.broadcast(data)

    def build():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines()) if a}
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @F.arrow_udf("int")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = kept(("tiktoken", path, pattern), build)
        for texts in batches:
            yield pa.array([len(encoding.encode_ordinary(t.as_py() or "")) for t in texts], pa.int32())

    return n_tokens


def pack(sized: DataFrame, key: str, size: str, capacities: list[tuple[int, int]], lanes: int, most_open: int = OPEN) -> DataFrame:
    """Rows (window_id, key, piece, first_token, n_tokens, lane, window_no, place) for each (window_id, capacity).

    Items go to lanes by a hash of `key` and through a lane in its order, so the result is the same on any cluster and in any
    number of tasks. A task holds the open windows of one lane and PART capacities, not its items; more capacities take more tasks. An item without size, or of size 0, takes a
    place in a window and no space; repeated keys are items of their own, in no set order; an empty table gives no row.
    """
    schema = f"window_id int, {key} {sized.schema[key].dataType.simpleString()}, piece int, first_token bigint, n_tokens bigint, lane int, window_no bigint, place int"
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, packers = None, []
        for b in batches:
            rows = []
            for k, n, at, part in zip(b["_key"], b["_size"], b["_lane"], b["_part"]):
                if (at, part) != lane:
                    lane, packers = (at, part), [(i, Packer(c, most_open)) for i, c in capacities[part * PART : (part + 1) * PART]]
                for i, p in packers:
                    rows += [(i, k, piece, first, m, at, window, place) for piece, first, m, window, place in p.put_all(int(n))]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    lane = F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")
    parts = -(-len(capacities) // PART)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    rows = sized.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"), lane.alias("_lane")).select("*", part.alias("_part"))
    by = ("_lane", "_part") if parts > 1 else ("_lane",)
    return rows.repartition(max(1, min(lanes * parts, 2000)), *by).sortWithinPartitions("_lane", "_part", "_key", "_size").mapInPandas(packed, schema)


@LLM.query("p7_windows")
def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity of context_windows, the window of every text, or of every piece of a text that is longer than the window."""
    documents = read(spark, sf_dir, "documents")
    lanes = -(-documents.count() // LANE) or 1
    windows = read(spark, sf_dir, "context_windows").where("capacity_tokens > 0").select("window_id", "capacity_tokens").distinct().orderBy("window_id", "capacity_tokens").collect()  # a fixed table
    sized = documents.select("doc_id", token_counter(spark)("text").alias("n"))
    return pack(sized, "doc_id", "n", [(r["window_id"], r["capacity_tokens"]) for r in windows], lanes)


@LLM.query("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity the windows used, the least number that the tokens could fill, and the share of space used."""
    by_window = p7_windows(spark, sf_dir).groupBy("window_id").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("lane", "window_no").alias("n_windows"))
    sized = by_window.join(F.broadcast(read(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens").distinct()), "window_id")  # a fixed table
    return sized.select("window_id", "n_tokens", "n_windows", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_windows"), (F.col("n_tokens") / (F.col("n_windows") * F.col("capacity_tokens"))).alias("fill"))
