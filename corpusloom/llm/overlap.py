"""Programs of the evaluation splits that also stand, the same or nearly so, in the training split: queries p4_found, p4_links, p4_members and p4_counts.

A program becomes the sequence of its statements without layout, comments, includes, std style, names and literals. Programs
with equal sequences are one class. The classes of the evaluation splits stand in full-text indexes, one a shard: the
Burrows-Wheeler transform of their sequences as occurrence lists with every eighth position of the suffix array. The classes
of the training split go through backward search, slice by slice; matches are merged into spans of pairs, and these are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.language import language
from corpusloom.llm.registry import LLM
from corpusloom.runtime import cut, read

TOKEN = re.compile(
    r'R"([^\s()\\]{0,16})\((?:.|\n)*?\)\1"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//(?:[^\n\\]|\\.|\\\n)*|/\*(?:.|\n)*?(?:\*/|\Z)|^[ \t]*\#(?:[^\n\\]|\\.|\\\n)*'
    r"|[^\W\d]\w*|\.?\d(?:[eEpP][+-]|'?\w|\.)*|<<=|>>=|<=>|->\*|\.\.\.|[-+*/%&|^!=<>]=|<<|>>|&&|\|\||\+\+|--|->|::|\S",
    re.M,
)
#: Words that are not names: those of the language, and of its library, which no one renames. Names of streams' line ends count as literals.
KEPT = frozenset(
    "alignas alignof and asm auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit extern "
    "false float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or private protected public reinterpret_cast return short signed sizeof "
    "static static_assert static_cast struct switch template this throw true try typedef typeid typename union unsigned using virtual void volatile while "
    "abs accumulate array back begin bitset cerr cin clear clog count count_if cout cbegin cend deque emplace_back empty end erase exception find find_if first for_each front function getline "
    "insert invalid_argument iota list lower_bound make_pair make_unique map max max_element min min_element move multimap multiset optional out_of_range pair pop pop_back pop_front "
    "priority_queue push push_back push_front queue reserve resize reverse runtime_error second set shared_ptr size sort stack stoi str string stringstream swap thread to_string top "
    "transform tuple unique unique_ptr unordered_map unordered_set upper_bound vector what".split()
)
LITERALS = frozenset(["endl", "flush"])
#: Least similarity of two sequences: twice the statements in common over those of both. A fifth changed leaves 0.8; "about" takes a little more.
LEAST = 0.75
#: Classes of a shard of the index and of a slice of the queries; positions of the suffix array between two that are kept.
SHARD, SLICE, SAMPLE = 60_000, 20_000, 8
#: A match is looked up where it is the shortest that at most FEW places share, and, whatever their number, where it has LONG statements or half of the query.
#: With a LONG of 1 every place of every match is looked up, and the pairs are exact, at a cost that grows with the square of the commonest statements.
FEW, SHORTEST, LONG = 8, 3, 8


QUICK = re.compile(
    r"\s*([^\W\d]\w*+(?![\"'])|[;,(){}\[\]]|//(?:[^\n\\]|\\.|\\\n)*|/\*[^*]*(?:\*+[^/*][^*]*)*(?:\*+/|\Z)|\#(?:[^\n\\]|\\.|\\\n)*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    r"|\.?\d(?:[eEpP][+-]|'?\w|\.)*|<<=|>>=|<=>|->\*|\.\.\.|[-+*/%&|^!=<>]=|<<|>>|&&|\|\||\+\+|--|->|::|\S)"
)
PARTS = re.compile(r" ?([{};]) ?")


class _Forms(dict):
    """What each token's text becomes: nothing for comments and directives, 0 for literals, x for names, itself for all else."""

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c == "#" or t[:2] in ("//", "/*"):
            return ""
        if c == "_" or c.isalpha():
            form = "std" if t == "std" else t if t in KEPT else "0" if t in LITERALS else "x"
        elif c in "\"'" or c.isdigit() or c == "." and len(t) > 1 and t != "...":
            form = "0"
        else:
            form = t
        if len(self) > 200_000:
            self.clear()
        self[t] = form
        return form


_forms = _Forms()


def statements(code: str | None) -> list[str]:
    """The statements of a program, braces left out; none for NULL."""
    text = code or ""
    words = [m[0].lstrip() for m in TOKEN.finditer(text)] if 'R"' in text else QUICK.findall(text)
    forms = ["0" if t[:2] == 'R"' else _forms[t] for t in words] if 'R"' in text else map(_forms.__getitem__, words)
    line = " ".join(filter(None, forms)).replace("std :: ", "")
    while "0 0" in line:  # literals side by side are one
        line = line.replace("0 0", "0")
    out, held, depth = [], "", 0
    parts = PARTS.split(line)
    for k in range(0, len(parts), 2):
        piece = parts[k]
        depth = max(0, depth + piece.count("(") - piece.count(")"))
        held = f"{held} {piece}" if held and piece else held or piece
        if depth and k + 1 < len(parts) and parts[k + 1] == ";":  # within the head of a loop
            held += " ;"
        elif held:
            out.append(held)
            held = ""
    return [s for s in out if s != "using namespace std"]


def similarity(a: list[int], b: list[int], least: float) -> float:
    """Twice the statements in common, in order, over those of both; 0 where their multisets already say it is under `least`."""
    if 2 * sum((Counter(a) & Counter(b)).values()) < least * (len(a) + len(b)):
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


class FullText:
    """Backward search over sequences. A pattern's suffixes are places lo to hi of the suffix array."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        self.sequences = sequences
        sizes = np.array([len(s) + 1 for s in sequences], dtype=np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(self.firsts[-1])
        flat = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
        self.symbols = np.unique(flat)
        ends = self.firsts[1:] - 1
        rank = np.empty(n, dtype=np.int64)  # first the symbols, the end of each sequence one of its own, below all others
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        rank[ends] = np.arange(len(ends))
        rank[inside] = len(ends) + np.searchsorted(self.symbols, flat)
        text = rank.copy()
        width = 1
        while True:  # prefix doubling
            after = np.zeros(n, dtype=np.int64)
            after[:-width] = rank[width:] + 1
            key = rank * (n + len(ends) + len(self.symbols) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, dtype=np.int64)
            new[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
            rank = new
            width *= 2
            if n == 0 or rank.max() == n - 1 or width >= n:
                break
        self.n = n
        bwt = text[order - 1] if n else text
        self.n_ends = len(ends)
        # symbol and place of the transform in one sorted array: the place of (c, i) in it is where the pattern c + suffix i stands
        self.lists = np.sort(bwt * (n + 1) + np.arange(n))
        kept = order % SAMPLE == 0
        kept |= ~inside[order - 1]  # and the first of each sequence, so no walk leaves one
        self.is_kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.kept = order[kept]
        self.bwt = bwt.astype(np.int32)

    def _back(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lists, symbol * (self.n + 1) + place)

    def positions(self, places: np.ndarray) -> np.ndarray:
        """The text positions of places of the suffix array, by steps back to one that is kept."""
        at, steps = places.copy(), np.zeros(len(places), dtype=np.int64)
        walk = np.flatnonzero(~self.is_kept[at])
        while len(walk):
            at[walk] = self._back(self.bwt[at[walk]].astype(np.int64), at[walk])
            steps[walk] += 1
            walk = walk[~self.is_kept[at[walk]]]
        return self.kept[self.kept_before[at]] + steps

    def matches(self, queries: list[np.ndarray], long_: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end of a match in a query: the query, and the places lo to hi of the matches that are looked up."""
        sizes = np.array([len(q) for q in queries], dtype=np.int64)
        of = np.repeat(np.arange(len(queries)), sizes)
        flat = np.concatenate(queries) if queries else np.zeros(0, np.int64)
        at = np.searchsorted(self.symbols, flat)
        at[at == len(self.symbols)] = 0
        known = self.symbols[at] == flat if len(self.symbols) else np.zeros(len(flat), dtype=bool)
        symbol = np.where(known, self.n_ends + at, -1)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        where = np.arange(len(flat))
        lo, hi = np.zeros(len(flat), dtype=np.int64), np.full(len(flat), self.n, dtype=np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive, k = where[symbol >= 0], 0
        half = np.minimum((sizes[of] + 1) // 2, long_)
        while len(alive):
            c = symbol[where[alive] - k]
            lo[alive], hi[alive] = self._back(c, lo[alive]), self._back(c, hi[alive])
            k += 1
            alive = alive[hi[alive] > lo[alive]]
            few = hi[alive] - lo[alive] <= FEW
            done = alive[few & (k >= np.minimum(SHORTEST, sizes[of[alive]])) | (k >= half[alive])]
            out.append((of[done], lo[done], hi[done]))
            keep = np.ones(len(flat), dtype=bool)
            keep[done] = False
            alive = alive[keep[alive]]
            alive = alive[(alive - k >= first[alive])]
            alive = alive[symbol[alive - k] >= 0]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def pairs(self, queries: list[np.ndarray], least: float = LEAST, long_: int = LONG) -> list[tuple[int, int, float]]:
        """(query, sequence, similarity) of `least` or more."""
        of, lo, hi = self.matches(queries, long_)
        n = hi - lo
        places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sequence = np.searchsorted(self.firsts, self.positions(places), side="right") - 1
        found, hits = np.unique(np.repeat(of, n) * max(1, len(self.sequences)) + sequence, return_counts=True)
        q, s = np.divmod(found, max(1, len(self.sequences)))
        sizes = np.array([len(x) for x in queries], dtype=np.int64)
        whole = np.array([len(x) for x in self.sequences], dtype=np.int64)
        # one place alone proves nothing in a long program, and sequences of too different lengths cannot be similar
        good = (hits >= np.minimum(2 if long_ > 1 else 1, sizes[q] // 8 + 1)) & (2 * np.minimum(sizes[q], whole[s]) >= least * (sizes[q] + whole[s]))
        out = []
        for i, j in zip(q[good].tolist(), s[good].tolist()):
            if (r := similarity(queries[i].tolist(), self.sequences[j].tolist(), least)) >= least:
                out.append((i, j, r))
        return out


def classes(examples: DataFrame, key: str, code: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(key, held_out, class) of each program, and (class, symbols, train, held_out) of each class.

    Programs without a statement are in no class; NULL code and NULL split give no row. Any split but train is held out.
    """

    @F.pandas_udf("struct<class:string,symbols:array<bigint>>")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for codes in batches:
            if len(known) > 500_000:
                known.clear()
            names, symbols = [], []
            for x in codes:
                s = statements(x)
                for t in s:
                    if t not in known:
                        known[t] = xxhash.xxh64_intdigest(t.encode()) >> 1
                names.append(hashlib.md5("\n".join(s).encode()).hexdigest() if s else None)
                symbols.append([known[t] for t in s])
            yield pd.DataFrame({"class": names, "symbols": symbols})

    held_out = F.lower(F.trim(split)) != "train"
    rows = cut(examples.where(F.col(split).isNotNull()).select(F.col(key), held_out.alias("held_out"), normal(code).alias("n")).select(key, "held_out", "n.*").where("class IS NOT NULL"))
    by = rows.groupBy("class").agg(F.first("symbols").alias("symbols"), F.bool_or(~F.col("held_out")).alias("train"), F.bool_or("held_out").alias("held_out"))
    return rows.select(key, "held_out", "class"), by


def links(by: DataFrame, least: float = LEAST, shard: int = SHARD, slice_: int = SLICE, long_: int = LONG) -> DataFrame:
    """(train_class, held_class, similarity) of classes that differ. Every slice of the training classes meets every shard of the others;
    the numbers of both follow the table. A task holds one shard and one slice."""
    by = cut(by)
    counts = by.agg(F.count_if("held_out").alias("held"), F.count_if("train").alias("train")).first()
    shards, slices = -(-counts["held"] // shard) or 1, -(-counts["train"] // slice_) or 1
    place = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = by.where("held_out").select(place(shards).alias("shard"), each(slices).alias("slice"), F.col("class").alias("held_class"), F.col("symbols").alias("held_symbols"))  # other names: the sides share no column
    train = by.where("train").select(each(shards).alias("shard"), place(slices).alias("slice"), "class", "symbols")

    def search(queries: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or texts.empty:
            return pd.DataFrame({"train_class": pd.Series([], dtype=object), "held_class": pd.Series([], dtype=object), "similarity": pd.Series([], dtype=float)})
        a, b = queries["class"].tolist(), texts["held_class"].tolist()
        as_arrays = lambda s: [np.asarray(x, dtype=np.int64) for x in s]
        index = FullText(as_arrays(texts["held_symbols"]))
        found = index.pairs(as_arrays(queries["symbols"]), least, long_)
        found = [(i, j, r) for i, j, r in found if a[i] != b[j]]
        return pd.DataFrame({"train_class": pd.Series([a[i] for i, _, _ in found], dtype=object), "held_class": pd.Series([b[j] for _, j, _ in found], dtype=object), "similarity": pd.Series([r for _, _, r in found], dtype=float)})

    return train.groupBy("shard", "slice").cogroup(held.groupBy("shard", "slice")).applyInPandas(search, "train_class string, held_class string, similarity double")


def pairs(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The pairs of one training and one held-out program: those of a class, and those of two classes with a link."""
    train, held = rows.where("NOT held_out").select("class", F.col(key).alias("t")), rows.where("held_out").select("class", F.col(key).alias("h"))
    same = train.join(held, "class").select("t", "h")
    linked = found.join(train.withColumnRenamed("class", "train_class"), "train_class").join(held.withColumnRenamed("class", "held_class"), "held_class").select("t", "h")
    return same.unionByName(linked)


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return classes(read(spark, sf_dir, "examples"), "example_id", "code", "split")


@LLM.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, the smaller id first."""
    rows, by = _rows(spark, sf_dir)
    return pairs(rows, links(by), "example_id").select(F.least("t", "h").alias("example_id_a"), F.greatest("t", "h").alias("example_id_b"))


@LLM.query("p4_links")
def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of classes, which with p4_members say what p4_found says without a row for each pair of copies."""
    return links(_rows(spark, sf_dir)[1])


@LLM.query("p4_members")
def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each program."""
    return _rows(spark, sf_dir)[0]


@LLM.query("p4_counts")
def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split, source and language: programs, those with a counterpart on the other side, and counterparts in all.

    Counted by class: a class's copies on the other side are its own and those of the classes it has links to.
    """
    rows, by = _rows(spark, sf_dir)
    rows = cut(rows)
    members = rows.groupBy("class").agg(F.count_if(~F.col("held_out")).alias("train"), F.count_if("held_out").alias("held"))
    found = cut(links(by))
    a = found.join(members.select(F.col("class").alias("held_class"), F.col("held").alias("n")), "held_class").select(F.col("train_class").alias("class"), F.lit(False).alias("held_out"), "n")
    b = found.join(members.select(F.col("class").alias("train_class"), F.col("train").alias("n")), "train_class").select(F.col("held_class").alias("class"), F.lit(True).alias("held_out"), "n")
    own = members.where("train > 0 AND held > 0").select("class", F.inline(F.array(F.struct(F.lit(False).alias("held_out"), F.col("held").alias("n")), F.struct(F.lit(True).alias("held_out"), F.col("train").alias("n")))))
    n = a.unionByName(b).unionByName(own).groupBy("class", "held_out").agg(F.sum("n").alias("n"))
    of = read(spark, sf_dir, "examples").select("example_id", F.col("split"), "source", language(F.col("lang")).alias("lang"))
    counted = rows.join(n, ["class", "held_out"], "left").select("example_id", F.coalesce("n", F.lit(0)).alias("n"))
    return of.join(counted, "example_id", "left").groupBy("split", "source", "lang").agg(F.count("*").alias("n_programs"), F.count_if(F.col("n") > 0).alias("n_overlapping"), F.sum(F.coalesce("n", F.lit(0))).alias("n_counterparts"))
