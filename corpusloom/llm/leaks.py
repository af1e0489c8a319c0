"""Passages of held-out items in documents: queries p8_found and p8_items.

The items stand in a BM25 inverted index whose terms are runs of three words. Every passage of every document is a query.
Block-max upper bounds of all its passages are summed at once; a block of items whose bound stays under its least threshold is
skipped, and a WAND search goes through the others, which returns the items over their thresholds. A threshold is the least
score that LEAST words of the item in a row keep when CHANGED of them are changed; the items retrieved are then aligned.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.registry import LLM
from corpusloom.runtime import kept, read

RESIDUE = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|\\[nrt]")
HIDDEN = re.compile("[­​-‏⁠﻿]")
MARKS = re.compile("[̀-ͯ]+")
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"^(.{10,160}?[.:?!])\s+(.*)$", re.S)
#: Words of a passage that make a case; words that may fall between two stretches that agree.
LEAST, BETWEEN = 25, 2
#: Words looked at together and how many of them must agree; the shorter for sentences that others were put between.
AGREE = ((14, 12), (10, 10))
#: Words of the stretch that may be changed.
CHANGED = 3
#: Words of a passage and from one to the next, so that every 48 words in a row lie within one.
PASSAGE, STRIDE = 64, 16
#: Items of a block of the index; BM25's constants; most items that the broadcast index takes, whose bounds are a table of terms by blocks.
BLOCK, K1, B, MOST_ITEMS = 4, 1.2, 0.75, 1500

NEXT = itemgetter(0)


def words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, tags and escaped line ends; none for NULL."""
    s = text or ""
    if "&" in s:
        s = html.unescape(s)
    if not s.isascii():
        s = MARKS.sub("", unicodedata.normalize("NFKD", HIDDEN.sub("", s)))
    if "<" in s or "\\" in s:
        s = RESIDUE.sub(" ", s)
    return WORD.findall(s.casefold())


def passages(items: list[tuple[int, str]]) -> dict[int, list[str]]:
    """The words of each item without an opening sentence that items with different passages share."""
    parted = {i: (tuple(words(m[1])), tuple(words(m[2]))) if (m := SENTENCE.match(text.strip())) else ((), tuple(words(text))) for i, text in items}
    rests = defaultdict(set)
    for first, rest in parted.values():
        rests[first].add(rest)
    return {i: list(rest if len(rests[first]) > 1 else first + rest) for i, (first, rest) in parted.items()}


class Index:
    """BM25 postings by term, in blocks of items, with the greatest impact of each block and of each term."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        held = {i: w for i, w in sorted(passages(items).items()) if w}
        spread = Counter(x for w in held.values() for x in set(w))
        about = {i: max((spread[x], x) if spread[x] <= len(held) / 16 else (0, "") for x in w) for i, w in held.items()}
        held = dict(sorted(held.items(), key=lambda x: (about[x[0]][1], x[0])))  # items about the same stand in the same blocks
        self.ids, self.items = list(held), list(held.values())
        self.word = {w: k for k, w in enumerate(dict.fromkeys(w for x in self.items for w in x), start=1)}  # 0: in no item
        self.base = len(self.word) + 1
        if self.base**3 >= 1 << 63:
            raise ValueError("too many words for one number a term")
        terms = [self.terms(np.array([self.word[x] for x in w], dtype=np.int64)).tolist() for w in self.items]
        df = Counter(t for ts in terms for t in set(ts))
        n, mean = len(terms), sum(map(len, terms)) / max(1, len(terms))
        self.postings: dict[int, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        self.least = []
        for k, ts in enumerate(terms):
            tf = Counter(ts)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ts) / mean)) for t, c in tf.items()}
            for t, v in impact.items():
                self.postings[t][0].append(k)
                self.postings[t][1].append(v)
            self.least.append(self._threshold([impact[t] for t in ts], ts))
        self.block_least = np.array([min(self.least[b : b + BLOCK]) for b in range(0, n, BLOCK)])
        self.known = np.array(sorted(self.postings), dtype=np.int64)
        self.cells: dict[tuple[int, int], list[tuple[int, float]]] = {}  # the postings of a term in a block
        self.upper = np.zeros((len(self.known), len(self.block_least)))  # the greatest impact of a term in a block
        for j, t in enumerate(self.known.tolist()):
            for i, v in zip(*self.postings[t]):
                self.upper[j, i // BLOCK] = max(self.upper[j, i // BLOCK], v)
                self.cells.setdefault((j, i // BLOCK), []).append((i, v))
        self.starts: list[dict[int, list[int]]] = []
        for ts in terms:
            at = defaultdict(list)
            for k, t in enumerate(ts):
                at[t].append(k)
            self.starts.append(at)

    def terms(self, ids: np.ndarray) -> np.ndarray:
        """A number for each run of three words, -1 where one of them is in no item."""
        if len(ids) < 3:
            return np.zeros(0, dtype=np.int64)
        x, y, z = ids[:-2], ids[1:-1], ids[2:]
        return np.where((x > 0) & (y > 0) & (z > 0), (x * self.base + y) * self.base + z, -1)

    @staticmethod
    def _threshold(impacts: list[float], ts: list[int]) -> float:
        """The least score of LEAST words in a row, or of the whole passage, if that is shorter, after the changes.

        A changed word takes three terms in a row; the worst changes are found by a table over the places of the stretch.
        """
        width = min(LEAST - 2, len(ts))
        changes = min(CHANGED, (width + 2) // 6)
        least = math.inf
        for a in range(len(ts) - width + 1):
            first = {t: k for k, t in reversed(list(enumerate(ts[a : a + width])))}
            held = [impacts[a + k] if first[t] == k else 0.0 for k, t in enumerate(ts[a : a + width])]
            taken = [[0.0] * (changes + 1) for _ in range(width + 1)]
            for k in range(width):
                for c in range(changes + 1):
                    taken[k + 1][c] = max(taken[k][c], taken[max(0, k - 2)][c - 1] + sum(held[max(0, k - 2) : k + 1]) if c else 0.0)
            least = min(least, sum(held) - taken[width][changes])
        return least - 1e-9 if least < math.inf else 0.0

    def search(self, query: np.ndarray, blocks: list[int]) -> list[int]:
        """Items of the blocks over their thresholds, by WAND: lists in the order of their next item; where the upper bounds of the
        first lists reach the block's least threshold stands the pivot, which is scored; all before it are passed over.
        query: the places of the terms in `known`, each once."""
        found = []
        for block in blocks:
            end, least, uppers = (block + 1) * BLOCK, self.block_least[block] - 1e-9, self.upper[query, block]
            of = np.flatnonzero(uppers)
            lists = [[p[0][0], 0, u, p] for j, u in zip(query[of].tolist(), uppers[of].tolist()) for p in (self.cells[j, block],)]  # next item, its place, upper bound, postings
            while lists:
                lists.sort(key=NEXT)
                bound, pivot = 0.0, None
                for x in lists:
                    bound += x[2]
                    if bound >= least:
                        pivot = x[0]
                        break
                if pivot is None:
                    break
                score = 0.0
                for x in lists:
                    if x[0] > pivot:
                        break
                    k, postings = x[1], x[3]
                    while k < len(postings) and postings[k][0] < pivot:
                        k += 1
                    if k < len(postings) and postings[k][0] == pivot:
                        score += postings[k][1]
                        k += 1
                    x[0], x[1] = (postings[k][0] if k < len(postings) else end), k
                if score >= self.least[pivot]:
                    found.append(pivot)
                lists = [x for x in lists if x[0] < end]
        return found

    def candidates(self, terms: np.ndarray) -> set[int]:
        """Items that some passage of the document retrieves. terms: those of the document in order, -1 for none."""
        at = np.searchsorted(self.known, terms)
        at[at == len(self.known)] = 0
        hit = self.known[at] == terms if len(self.known) else np.zeros(len(terms), dtype=bool)
        if not hit.any():
            return set()
        place = np.flatnonzero(hit)
        if len(place) < 3:
            return set()
        sums = np.zeros((len(place) + 1, len(self.block_least)))
        np.cumsum(self.upper[at[place]], axis=0, out=sums[1:])
        starts = np.arange(0, max(1, len(terms) - (PASSAGE - 2) + STRIDE), STRIDE)
        lo, hi = np.searchsorted(place, starts), np.searchsorted(place, starts + PASSAGE - 2)
        over = sums[hi] - sums[lo] >= self.block_least - 1e-6
        found: set[int] = set()
        for w in np.flatnonzero(over.any(axis=1)).tolist():
            found.update(self.search(np.unique(at[place[lo[w] : hi[w]]]), np.flatnonzero(over[w]).tolist()))
        return found

    def longest(self, doc: list[int], terms: list[int], k: int) -> int:
        """The words of the longest stretch of item k in the document."""
        w = [self.word[x] for x in self.items[k]]
        starts, shifts = self.starts[k], Counter()
        for p, t in enumerate(terms):
            if t in starts:
                for q in starts[t]:
                    shifts[p - q] += 1
        covered: set[int] = set()
        for d, hits in shifts.items():
            if hits > 1:
                lo, hi = max(0, -d), min(len(w), len(doc) - d)
                same = [w[j] == doc[j + d] for j in range(lo, hi)]
                for together, agree in AGREE:
                    for j in range(len(same) - together + 1):
                        if same[j] and sum(same[j : j + together]) >= agree:
                            end = j + together
                            while not same[end - 1]:
                                end -= 1
                            covered.update(range(lo + j, lo + end))
        if not covered:
            return 0
        held = sorted(covered)
        start, best = held[0], 0
        for x, y in zip(held, [*held[1:], 1 << 30]):
            if y - x > BETWEEN + 1:
                best, start = max(best, x + 1 - start), y
        return best

    def found(self, text: str | None) -> list[int]:
        get = self.word.get
        doc = [get(w, 0) for w in words(text)]
        terms = self.terms(np.array(doc, dtype=np.int64))
        if not len(terms):
            return []
        listed = None
        out = []
        for k in sorted(self.candidates(terms)):
            listed = terms.tolist() if listed is None else listed
            if self.longest(doc, listed, k) >= min(LEAST, len(self.items[k])):
                out.append(self.ids[k])
        return out


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", most_items: int = MOST_ITEMS) -> DataFrame:
    """Rows (key, item_id) for each document that holds an item's own passage or LEAST words in a row of it, with some words changed or sentences put in.

    NULL and empty texts hold none; items without text are in no document; copies of a document are reported each, as are all
    items that share a passage. The index of the items is sent to every worker; over `most_items` of them are refused.
    """
    rows = items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} items for one index")
    shared = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

    @F.arrow_udf("array<bigint>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = kept(("leaks", hash(tuple(shared.value))), lambda: Index(shared.value))
        for texts in batches:
            yield pa.array([index.found(t.as_py()) for t in texts], pa.list_(pa.int64()))

    return documents.select(F.col(key), F.explode(found(text)).alias("item_id"))


@LLM.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items that leaked into them."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


@LLM.query("p8_items")
def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item and the number of documents it leaked into, 0 too."""
    n = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    items = read(spark, sf_dir, "eval_items").select("item_id", "suite", "lang")
    return items.join(n, "item_id", "left").fillna(0, ["n_documents"])
