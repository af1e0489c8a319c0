"""Subject areas of documents: queries p9_found, p9_shares and p9_makeup.

Labelling functions vote for each sentence and area: two lexicons (things, places), addresses, the heading of the section, and the source.
A latent model learns from the vote patterns of the whole corpus, without labels, how often each function is right; a sentence deals with
an area where the posterior probability is over a half, and a document has the areas of at least a fifth of its sentences.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.language import language
from corpusloom.llm.registry import LLM
from corpusloom.llm.subjects_lexicon import PLACES, THINGS
from corpusloom.runtime import cut, kept, read

THING, PLACE, ADDRESS, SECTION, SOURCE = 1, 2, 4, 8, 16
FUNCTIONS = 5
#: Least share of sentences; how much commoner an area must be in a source than in all for the source to vote.
LEAST, COMMONER = 0.2, 1.5
ROUNDS = 30

TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:#\s*(?:include|define|if|ifdef|ifndef|endif|else|pragma)\b|[{}()\]]|using namespace\b|(?:case|default)\b.*:|public:|private:|import \w+|from \w+ import|def \w+\(|class \w+.*[:{]\s*$)|<<\s*$|^\s*[\w:<>]+\s*=[^=]")
COMMENT = re.compile(r"//[/!<]*\s?(.*)$|/\*+\s?(.*?)(?:\*/|$)")
BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
QUOTE = re.compile(r"^\s*(?:>+\s?)+")
ENDS = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+")
WORDS = re.compile(r"[^\W\d_]{2,}")
#: Words that tell a German sentence from one of another language.
GERMAN = re.compile(r"\b(?:die|der|das|den|dem|und|nicht|wie|sind)\b")
ADDRESSES = re.compile(r"(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


def sentences(text: str | None) -> list[tuple[str, str, str]]:
    """(sentence, heading of its section, addresses in it) of the running text and the comments of a document; programs and their literals are none."""
    s = text or ""
    if "&" in s:
        s = html.unescape(s)
    if "\\n" in s and s.count("\\n") > s.count("\n"):
        s = s.replace("\\r\\n", "\n").replace("\\n", "\n")
    s = s.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if "<" in s:
        s = TAG.sub(" ", s)
    out: list[tuple[str, str, str]] = []
    held: list[str] = []
    heading, fence, block = "", False, False

    def close() -> None:
        if held:
            for x in ENDS.split(" ".join(held)):
                plain = ADDRESSES.sub(" ", x) if "://" in x or "@" in x or "www." in x else x
                if len(WORDS.findall(plain)) >= 4:
                    out.append((" ".join(plain.lower().split()), heading, "" if plain is x else " ".join(ADDRESSES.findall(x)).lower()))
            held.clear()

    for line in s.split("\n"):
        t = line.strip()
        if block:  # within /* */
            end = t.find("*/")
            body = (t if end < 0 else t[:end]).lstrip("* \t")
            block = end < 0
            if body and not CODE_LINE.search(body):
                held.append(body)
            else:
                close()
            if not block:
                close()
            continue
        if not t:
            close()
        elif t.startswith("```"):
            close()
            fence = not fence
        elif t.startswith("/*") and "*/" not in t:
            close()
            block = True
            if body := t.lstrip("/* \t"):
                held.append(body)
        elif t.startswith("//"):
            body = t.lstrip("/!< \t")
            if CODE_LINE.search(body):
                close()
            else:
                held.append(body)
        elif fence or CODE_LINE.search(t):
            close()
            if ("//" in t or "/*" in t) and '"' not in t:
                for m in COMMENT.finditer(t):
                    if (body := (m[1] or m[2] or "").strip()) and not CODE_LINE.search(body):
                        held.append(body)
                close()
        elif t.startswith("/*"):
            close()
            held.append(t.strip("/* \t"))
            close()
        elif t[0] == "#" and t.lstrip("#")[:1] in (" ", ""):
            close()
            heading = t.lstrip("# ").lower()
        else:
            if BULLET.match(line):
                close()
                t = BULLET.sub("", line).strip()
            elif t[0] == ">":
                t = QUOTE.sub("", t)
            held.append(t)
    close()
    return out


class Votes:
    """What the text's labelling functions say of each sentence."""

    def __init__(self, things: dict[str, str], places: dict[str, str]) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        votes: dict[str, set[tuple[str, int, str]]] = {}
        for vote, lists in ((THING, things), (PLACE, places)):
            for subject, entries in lists.items():
                for x in entries.split(","):
                    word, _, lang = " ".join(x.lower().split()).partition("@")
                    votes.setdefault(word, set()).add((subject, vote, lang))
        for subject in things:
            votes.setdefault(subject, set()).add((subject, SECTION, ""))  # its name, in a heading or an address
        for x, v in votes.items():
            if x:
                self.find.add_word(x, (len(x), sorted(v)))
        self.find.make_automaton()

    def hits(self, text: str) -> list[tuple[int, str, int]]:
        """(place, area, function) of the entries between word boundaries."""
        out = []
        for end, (n, votes) in self.find.iter(text):
            start = end - n + 1
            if not (start and text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                for subject, vote, lang in votes:
                    if not lang or (lang == "de") == bool(GERMAN.search(text, text.rfind("\n", 0, start) + 1, text.find("\n", end) + 1 or len(text))):
                        out.append((start, subject, vote))
        return out

    def patterns(self, text: str | None) -> tuple[int, Counter[tuple[str, int]]]:
        """The number of sentences, and of those with each pattern of votes other than none for an area."""
        found = sentences(text)
        starts, at = [], 0
        for x, _, _ in found:
            starts.append(at)
            at += len(x) + 1
        votes: dict[tuple[int, str], int] = {}
        for place, subject, vote in self.hits("\n".join(x for x, _, _ in found)):
            if vote != SECTION:
                key = (bisect_right(starts, place) - 1, subject)
                votes[key] = votes.get(key, 0) | vote
        of: dict[str, set[str]] = {}
        for k, (_, heading, addresses) in enumerate(found):
            for vote, x in ((SECTION, heading), (ADDRESS, addresses)):
                if x:
                    if x not in of:
                        of[x] = {subject for _, subject, _ in self.hits(re.sub(r"[\W_]+", " ", x))}
                    for subject in of[x]:
                        votes[k, subject] = votes.get((k, subject), 0) | vote
        return len(found), Counter((subject, v) for (_, subject), v in votes.items())


def learn(counts: dict[tuple[str, int], float], rounds: int = ROUNDS) -> dict[tuple[str, int], float]:
    """The posterior that a sentence deals with an area, by area and pattern of votes, from how often each pattern occurs.

    Two classes with functions that err independently, their rates of hits and of false alarms shared by the areas, the prior
    one for each area; expectation and maximisation over the counts. A function that never votes says nothing.
    """
    subjects = sorted({s for s, _ in counts})
    prior = {s: 0.1 for s in subjects}
    hit, alarm = [0.6, 0.4, 0.2, 0.2, 0.3], [0.01, 0.01, 0.01, 0.05, 0.2]
    silent = [not any(p >> k & 1 for (_, p), n in counts.items() if n) for k in range(FUNCTIONS)]

    def posterior(s: str, p: int) -> float:
        odds = math.log(prior[s] / (1 - prior[s]))
        for k in range(FUNCTIONS):
            if not silent[k]:
                odds += math.log(hit[k] / alarm[k]) if p >> k & 1 else math.log((1 - hit[k]) / (1 - alarm[k]))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    within = lambda x: min(1 - 1e-6, max(1e-6, x))
    for _ in range(rounds):
        post = {k: posterior(*k) for k in counts}
        for s in subjects:
            n = sum(v for (t, _), v in counts.items() if t == s)
            prior[s] = within(sum(v * post[t, p] for (t, p), v in counts.items() if t == s) / max(n, 1e-9))
        yes = sum(v * post[k] for k, v in counts.items())
        no = sum(v * (1 - post[k]) for k, v in counts.items())
        for k in range(FUNCTIONS):
            voted = [(v, post[x]) for x, v in counts.items() if x[1] >> k & 1]
            hit[k] = within((sum(v * q for v, q in voted) + 0.1) / (yes + 1))
            alarm[k] = min(hit[k] * 0.9, within((sum(v * (1 - q) for v, q in voted) + 0.001) / (no + 1)))  # a vote never speaks against its area
    return {(s, p): posterior(s, p) for s in subjects for p in range(1 << FUNCTIONS)}


def subject_shares(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", things: dict[str, str] = THINGS, places: dict[str, str] = PLACES) -> DataFrame:
    """(key, subject, n_sentences, n_about, share) for each area that some sentence of the document deals with.

    NULL and empty texts, and those without a sentence, have none. Counts are over all documents; what comes to the driver are
    the counts of vote patterns, at most 32 an area.
    """
    shared = documents.sparkSession.sparkContext.broadcast((things, places))

    @F.pandas_udf("struct<n:int,votes:array<struct<subject:string,pattern:int,n:int>>>")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        votes = kept(("votes", hash(str(shared.value))), lambda: Votes(*shared.value))
        for texts in batches:
            found = [votes.patterns(t) for t in texts]
            yield pd.DataFrame({"n": [n for n, _ in found], "votes": [[{"subject": s, "pattern": p, "n": m} for (s, p), m in c.items()] for _, c in found]})

    rows = cut(documents.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source"), vote(text).alias("v")).select("_row", "_key", "_source", F.col("v.n").alias("n_sentences"), "v.votes"))
    each = rows.select("_row", "_key", "_source", "n_sentences", F.inline("votes"))
    # the source votes for an area that its sentences are about COMMONER times as often as all sentences
    per = rows.groupBy("_source").agg(F.sum("n_sentences").alias("in_source"))
    told = each.groupBy("_source", "subject").agg(F.sum("n").alias("n_told"))
    everywhere = told.groupBy("subject").agg(F.sum("n_told").alias("n_all")).join(F.broadcast(rows.agg(F.sum("n_sentences").alias("n_total"))))  # one row
    speaks = told.join(per, "_source").join(everywhere, "subject").where(F.col("n_told") * F.col("n_total") > COMMONER * F.col("n_all") * F.col("in_source")).select("_source", "subject", F.lit(SOURCE).alias("of_source"))
    with_source = each.join(speaks, ["_source", "subject"], "left").select("_row", "_key", "_source", "n_sentences", "subject", (F.col("pattern") + F.coalesce("of_source", F.lit(0))).alias("pattern"), "n")
    counts = {(r["subject"], r["pattern"]): float(r["n"]) for r in with_source.groupBy("subject", "pattern").agg(F.sum("n").alias("n")).collect()}
    total = rows.agg(F.sum("n_sentences")).first()[0] or 0
    voting = {r["subject"]: r["n"] or 0 for r in speaks.join(per, "_source").groupBy("subject").agg(F.sum("in_source").alias("n")).collect()}  # a row an area
    for s in things:  # the sentences without any vote, of sources that vote and of those that do not
        told_here = sum(v for (t, p), v in counts.items() if t == s and p & SOURCE)
        told_else = sum(v for (t, p), v in counts.items() if t == s and not p & SOURCE)
        counts[s, SOURCE] = counts.get((s, SOURCE), 0.0) + max(0.0, voting.get(s, 0) - told_here)
        counts[s, 0] = max(0.0, total - voting.get(s, 0) - told_else)
    post = learn(counts)
    sure = documents.sparkSession.createDataFrame([(s, p) for (s, p), q in post.items() if q > 0.5 and p not in (0, SOURCE)], "subject string, pattern int")
    about = with_source.join(F.broadcast(sure), ["subject", "pattern"])  # at most 32 rows an area
    by = about.groupBy("_row", "_key", "subject").agg(F.first("n_sentences").alias("n_sentences"), F.sum("n").alias("n_about"))
    return by.select(F.col("_key").alias(key), "subject", "n_sentences", "n_about", (F.col("n_about") / F.col("n_sentences")).alias("share"))


@LLM.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area of every document with its share of the sentences."""
    return subject_shares(read(spark, sf_dir, "documents"))


@LLM.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of at least a fifth of a document's sentences, as spelt in subject_areas."""
    areas = read(spark, sf_dir, "subject_areas").select(F.col("subject").alias("spelt"), F.lower(F.trim("subject")).alias("subject")).distinct()
    return p9_shares(spark, sf_dir).where(F.col("share") >= LEAST).join(F.broadcast(areas), "subject").select("doc_id", F.col("spelt").alias("subject"))  # a fixed table of nine rows


@LLM.query("p9_makeup")
def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each area (none for documents without one), source and language: documents, and sentences about it."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "source", language(F.col("lang")).alias("lang"))
    areas = p9_shares(spark, sf_dir).where(F.col("share") >= LEAST)
    joined = documents.join(areas, "doc_id", "left").select(F.coalesce("subject", F.lit("none")).alias("subject"), "source", "lang", F.coalesce("n_about", F.lit(0)).alias("n_about"))
    return joined.groupBy("subject", "source", "lang").agg(F.count("*").alias("n_documents"), F.sum("n_about").alias("n_sentences"))
