"""Token sequences made ready for training: framed, cut, padded, masked, shifted. Ids are the code points of characters, so any engine can make them."""

from __future__ import annotations

from corpusloom.plans.dialect import Duck, Spark, relational

PAD, BOS, EOS, SEPARATOR = 0, 2, 3, 10_000
#: Added to the ids of the first of two vocabularies; one more than the separator, so that none is taken for it.
OFFSET = 10_001
LENGTH, LONGEST = 64, 256


def ids(d: Spark, x: str) -> str:
    return d.transform(d.filter(d.chars(x), "x <> ''"), f"CAST({d.code('x')} AS INTEGER)")


def listed(d: Spark, a: str) -> str:
    return d.join(d.transform(a, "CAST(x AS VARCHAR(12))"), ",")


def cat(d: Spark, *arrays: str) -> str:
    return f"({' || '.join(arrays)})" if isinstance(d, Duck) else f"concat({', '.join(arrays)})"


def framed(d: Spark) -> str:
    return f"SELECT example_id, {cat(d, d.array(str(BOS)), ids(d, 'description'), d.array(str(EOS)))} AS ids FROM {{examples}} WHERE description IS NOT NULL"


@relational("frame_tokens")
def frame_tokens(d: Spark) -> str:
    """A beginning and an end around every description."""
    return f"SELECT example_id, {listed(d, 'ids')} AS ids FROM ({framed(d)}) AS f"


@relational("next_token_pairs")
def next_token_pairs(d: Spark) -> str:
    """All but the last id, and all but the first."""
    n = d.size("ids")
    return f"SELECT example_id, {listed(d, d.slice('ids', '1', f'CAST({n} - 1 AS INT)'))} AS input, {listed(d, d.slice('ids', '2', f'CAST({n} - 1 AS INT)'))} AS labels FROM ({framed(d)}) AS f"


@relational("pad_and_mask")
def pad_and_mask(d: Spark) -> str:
    """Cut to 64 ids or filled up with zeros, with a mask of what is real; and the longest of each batch of 32 by id, to which a batch would be filled."""
    cut = d.slice("ids", "1", f"CAST(least({d.size('ids')}, {LENGTH}) AS INT)")
    padded = cat(d, cut, d.repeat(str(PAD), f"greatest({LENGTH} - {d.size('ids')}, 0)"))
    mask = cat(d, d.repeat("1", f"least({d.size('ids')}, {LENGTH})"), d.repeat("0", f"greatest({LENGTH} - {d.size('ids')}, 0)"))
    return f"SELECT example_id, {listed(d, padded)} AS ids, {listed(d, mask)} AS mask, max({d.size('ids')}) OVER (PARTITION BY floor(example_id / 32)) AS batch_length FROM ({framed(d)}) AS f"


def two(d: Spark) -> str:
    left = d.transform(ids(d, "description"), f"x + {OFFSET}")
    whole = cat(d, d.array(str(BOS)), left, d.array(str(SEPARATOR)), ids(d, "code"), d.array(str(EOS)))
    return f"SELECT example_id, description, {d.slice(whole, '1', f'CAST(least({LONGEST}, {d.size(whole)}) AS INT)')} AS ids FROM {{examples}} WHERE description IS NOT NULL AND code IS NOT NULL"


@relational("two_vocab_frame")
def two_vocab_frame(d: Spark) -> str:
    """The ids of two vocabularies around a separator, those of the first moved past it; cut at 256."""
    return f"SELECT example_id, {listed(d, 'ids')} AS ids FROM ({two(d)}) AS t"


@relational("two_vocab_decode")
def two_vocab_decode(d: Spark) -> str:
    """Cut at the first separator; on the left ids of the first vocabulary, moved back, on the right the others without special ones. Without a separator all is code."""
    place = f"list_position(ids, {SEPARATOR})" if isinstance(d, Duck) else f"CAST(array_position(ids, {SEPARATOR}) AS INT)"
    left = d.transform(d.filter(d.slice("ids", "1", "place"), f"x >= {OFFSET}"), f"x - {OFFSET}")
    right = d.filter(d.slice("ids", "place + 1", f"CAST({d.size('ids')} AS INT)"), f"x <> {BOS} AND x <> {EOS} AND x <> {PAD}")
    return f"SELECT example_id, CASE WHEN place = 0 THEN '' ELSE {listed(d, left)} END AS first_ids, {listed(d, right)} AS code_ids FROM (SELECT example_id, ids, coalesce({place}, 0) AS place FROM ({two(d)}) AS t) AS p"


@relational("min_token_rows")
def min_token_rows(d: Spark) -> str:
    """documents of five words or more."""
    return f"SELECT doc_id, {d.size('w')} AS n_words FROM (SELECT doc_id, {d.filter(d.split(d.sub('text', '[' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r ]+', ' '), ' '), chr(120) + ' <> ' + chr(39) * 2)} AS w FROM {{documents}} WHERE text IS NOT NULL) AS t WHERE {d.size('w')} >= 5"


@relational("token_length_summary")
def token_length_summary(d: Spark) -> str:
    """Lengths of framed descriptions by split, and rows without one, which are skipped."""
    return f"SELECT e.split, count(f.example_id) AS n, count(*) - count(f.example_id) AS n_skipped, avg(f.n) AS mean, min(f.n) AS least, max(f.n) AS most FROM {{examples}} AS e LEFT JOIN (SELECT example_id, {d.size('ids')} AS n FROM ({framed(d)}) AS x) AS f ON e.example_id = f.example_id GROUP BY e.split"


@relational("utf8_validity")
def utf8_validity(d: Spark) -> str:
    """whether a text's bytes without the last are still UTF-8: not if the last character has several."""
    last = "substr(text, length(text), 1)"
    if isinstance(d, Duck):
        return f"SELECT doc_id, octet_length(encode({last})) = 1 AS valid FROM {{documents}} WHERE text <> ''"
    return "SELECT doc_id, is_valid_utf8(CAST(substring(encode(text, 'UTF-8'), 1, octet_length(text) - 1) AS STRING)) AS valid FROM {documents} WHERE text <> ''"
