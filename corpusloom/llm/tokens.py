"""Token counts under a longest-match subword vocabulary: queries p3_tokens (each text) and p3_totals.

A trie with failure links is closed into one table of next states and one of tokens emitted, so a text costs one look-up
a byte whatever the vocabulary holds; many stretches of text go through the tables side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.language import language
from corpusloom.llm.registry import LLM
from corpusloom.runtime import kept, read

#: Bytes that go through the tables at once, and bytes after which a text is cut at the next place that no token holds.
AT_ONCE, STRETCH = 8 << 20, 128
#: Dataset, id, text, then what is totalled by.
INPUTS = [
    ("examples", "example_id", "code", "source", "topic", "style"),
    ("source_files", "file_id", "code", "repo", "topic", "style"),
    ("documents", "doc_id", "text", "source", "doc_kind", None),
]


def byte_of(char: str) -> int | None:
    """The byte that a character of the vocabulary stands for."""
    c = ord(char)
    if c in (9, 10, 13) or 32 <= c <= 126 or 161 <= c <= 255:
        return c
    return c - 0xE000 if 0xE000 <= c < 0xE100 else None


def as_bytes(token: str) -> bytes | None:
    found = [byte_of(c) for c in token]
    return None if None in found else bytes(found)  # type: ignore[arg-type]


class Matcher:
    """Counts the tokens of leftmost longest matching. A byte that no token begins with counts as one token."""

    def __init__(self, tokens: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        whole, parent = [False], [(0, 0)]
        allowed = np.ones(1 << 16, dtype=bool)  # pairs of bytes between which a text may be cut
        for token in {*tokens, *(bytes([b]) for b in range(256))} - {b""}:
            v = 0
            for b in token:
                if b not in children[v]:
                    children[v][b] = len(children)
                    children.append({})
                    whole.append(False)
                    parent.append((v, b))
                v = children[v][b]
            whole[v] = True
            for x, y in zip(token, token[1:]):
                allowed[x << 8 | y] = False
        n = len(children)
        step, emit = np.zeros((n, 256), dtype=np.int32), np.zeros((n, 256), dtype=np.int32)
        link, pops = [0] * n, [0] * n
        order = [0]
        for v in order:
            order += children[v].values()
        for v in order:
            if v:
                u, c = parent[v]
                if whole[v]:
                    link[v], pops[v] = 0, 1
                else:  # the root has a child for every byte, so some link can go on
                    z, k = link[u], pops[u]
                    while c not in children[z]:
                        k += pops[z]
                        z = link[z]
                    link[v], pops[v] = children[z][c], k
                step[v] = step[link[v]]
                emit[v] = emit[link[v]] + pops[v]
            for c, w in children[v].items():
                step[v, c], emit[v, c] = w, 0
        self.end = np.zeros(n, dtype=np.int32)
        for v in order[1:]:
            self.end[v] = pops[v] + self.end[link[v]]
        self.step = (step << 8).ravel()  # a state times 256, to which the byte is added
        self.emit, self.allowed = emit.astype(np.int16 if emit.max() < 1 << 15 else np.int32).ravel(), allowed

    def _run(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The tokens of each stretch of `data`; a stretch reaches to the next start."""
        sizes = np.diff(np.append(starts, len(data)))
        order = np.argsort(-sizes, kind="stable")
        at, longest = starts[order].copy(), -sizes[order]
        state, count = np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=np.int64)
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(longest, -t, side="left"))  # stretches of more than t bytes
            here = state[:n] + data[at[:n]]
            count[:n] += self.emit.take(here)
            state[:n] = self.step.take(here)
            at[:n] += 1
        count += self.end.take(state >> 8)
        out = np.empty_like(count)
        out[order] = count
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens of each text; text k is data[offsets[k]:offsets[k + 1]]."""
        out = np.zeros(len(offsets) - 1, dtype=np.int64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + AT_ONCE, side="right")) - 1)
            part, firsts = data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
            if len(part):
                pairs = part[:-1].astype(np.int32) << 8 | part[1:]
                cuts = np.flatnonzero(self.allowed.take(pairs)) + 1
                cuts = cuts[np.unique(cuts // STRETCH, return_index=True)[1]]
                filled = firsts[np.diff(np.append(firsts, len(part))) > 0]
                starts = np.union1d(filled, cuts)
                text = np.searchsorted(filled, starts, side="right") - 1
                sums = np.zeros(len(filled), dtype=np.int64)
                np.add.at(sums, text, self._run(part, starts))
                out[lo + np.flatnonzero(np.diff(np.append(firsts, len(part))) > 0)] = sums
            lo = hi
        return out

    def count_arrow(self, texts: pa.Array) -> pa.Array:
        """NULL has no tokens."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        return pa.array(self.counts(np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), at))


def vocabulary(df: DataFrame, most: int = 1_000_000) -> list[bytes]:
    """The tokens without special ones (id below 4), empty ones, repeats and characters that stand for no byte.

    A vocabulary is fixed in size whatever the corpus; more than `most` rows are refused.
    """
    rows = df.where("token IS NOT NULL AND token <> '' AND token_id >= 4").select("token").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} tokens")
    return sorted(b for r in rows if (b := as_bytes(r["token"])))


def counter(spark: SparkSession, tokens: list[bytes]):
    """A column function: the tokens of a text; 0 for NULL and for an empty one."""
    shared = spark.sparkContext.broadcast(tokens)

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = kept(("matcher", hash(tuple(shared.value))), lambda: Matcher(shared.value))
        for texts in batches:
            yield matcher.count_arrow(texts)

    return n_tokens


@LLM.query("p3_tokens")
def p3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every text of the three tables, labels as they stand."""
    tokens = counter(spark, vocabulary(read(spark, sf_dir, "bpe_vocab")))
    parts = [
        read(spark, sf_dir, table).select(
            F.lit(table).alias("dataset"), F.col(key).alias("text_id"), F.col(origin).alias("origin"), "lang", F.col(kind).alias("kind"),
            (F.col(style) if style else F.lit(None).cast("string")).alias("style"), tokens(text).alias("n_tokens"),
        )
        for table, key, text, origin, kind, style in INPUTS
    ]
    return reduce(DataFrame.unionByName, parts)


def totals(counted: DataFrame, by: list[str], n_tokens: str, spelt: tuple[str, ...] = ()) -> DataFrame:
    """Texts and tokens by the columns `by`; a hot group is summed where it lies before anything moves.

    For the columns `spelt`, values that differ only in case, blanks and punctuation are one, shown as the commonest spelling;
    NULL stays NULL. The sums are joined to the spellings, so the join sees one row a group and never one a text.
    """
    sums = counted.groupBy(*by).agg(F.count("*").alias("n_texts"), F.sum(n_tokens).alias("n_tokens"))
    for label in spelt:
        key = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]", "")
        seen = sums.groupBy(key.alias("_key"), F.col(label).alias("_spelt")).agg(F.sum("n_texts").alias("n"))
        first = Window.partitionBy("_key").orderBy(F.desc("n"), "_spelt")
        best = seen.withColumn("k", F.row_number().over(first)).where("k = 1").select("_key", "_spelt")
        sums = sums.withColumn("_key", key).join(best, "_key", "left").withColumn(label, F.col("_spelt")).drop("_key", "_spelt")
    return sums.groupBy(*by).agg(F.sum("n_texts").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))


@LLM.query("p3_totals")
def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens by dataset, source or repo, language, topic or kind, and style."""
    counted = p3_tokens(spark, sf_dir).withColumn("lang", language(F.col("lang")))
    return totals(counted, ["dataset", "origin", "lang", "kind", "style"], "n_tokens", ("kind", "style"))
