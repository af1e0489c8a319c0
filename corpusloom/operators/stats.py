"""Statistics of the corpus: lengths, characters, bytes, pairs, splits, times and metrics."""

from __future__ import annotations

from corpusloom.operators.cleaning import block_of, strip
from corpusloom.plans.dialect import Duck, Spark, relational

#: Keywords of C++ that are counted in programs.
KEYWORDS = "int void return if else for while do class struct public private const auto static namespace using include std vector string template typename new delete try catch throw break continue switch case default true false".split()


def lengths(d: Spark) -> str:
    return f"SELECT doc_id, n FROM (SELECT doc_id, CAST(length({strip(d, 'text')}) AS BIGINT) AS n FROM {{documents}}) AS l WHERE n > 0"


def chars(d: Spark) -> str:
    """Characters of the corpus with their counts."""
    return f"SELECT item AS ch, count(*) AS n FROM {{documents}} AS t, {d.each(d.chars('t.text'))} AS c WHERE item <> '' GROUP BY item"


@relational("unique_char_count")
def unique_char_count(d: Spark) -> str:
    """Distinct characters, by grouping, not by a set in one place."""
    return f"SELECT count(*) AS n_distinct FROM ({chars(d)}) AS c"


@relational("char_frequency_top50")
def char_frequency_top50(d: Spark) -> str:
    """The fifty commonest characters, ties by code point, with their mean a document."""
    return f"SELECT {d.code('ch')} AS code_point, n, n / (SELECT count(*) FROM {{documents}} WHERE text IS NOT NULL) AS mean FROM ({chars(d)}) AS c ORDER BY n DESC, code_point LIMIT 50"


@relational("keyword_counts")
def keyword_counts(d: Spark) -> str:
    """How often each keyword stands in all programs, overlaps not counted, those without any left out; one pass over the files."""
    sums = ", ".join(f"CAST(sum((length(code) - length(replace(code, '{k}', ''))) / {len(k)}) AS BIGINT) AS k{i}" for i, k in enumerate(KEYWORDS))
    rows = " UNION ALL ".join(f"SELECT '{k}' AS keyword, k{i} AS n FROM s" for i, k in enumerate(KEYWORDS))
    return f"WITH s AS (SELECT {sums} FROM {{source_files}} WHERE code IS NOT NULL) SELECT keyword, n FROM ({rows}) AS r WHERE n > 0"


@relational("length_histogram")
def length_histogram(d: Spark) -> str:
    """Fifty bins of equal width; the longest text is in the last."""
    return f"SELECT CAST(least(floor((n - lo) * 50 / greatest(hi - lo, 1)), 49) AS BIGINT) AS bin, count(*) AS n_texts, min(n) AS least, max(n) AS most FROM ({lengths(d)}) AS l CROSS JOIN (SELECT min(n) AS lo, max(n) AS hi FROM ({lengths(d)}) AS m) AS r GROUP BY least(floor((n - lo) * 50 / greatest(hi - lo, 1)), 49)"


@relational("length_ecdf")
def length_ecdf(d: Spark) -> str:
    """The share of texts up to each of a hundred bins; the running sum is over bins, not texts."""
    b = "CAST(least(floor((n - lo) * 100 / greatest(hi - lo, 1)), 99) AS BIGINT)"
    binned = f"SELECT {b} AS bin, count(*) AS n_texts FROM ({lengths(d)}) AS l CROSS JOIN (SELECT min(n) AS lo, max(n) AS hi FROM ({lengths(d)}) AS m) AS r GROUP BY {b}"
    return f"SELECT bin, n_texts, sum(n_texts) OVER (ORDER BY bin) / sum(n_texts) OVER () AS share FROM ({binned}) AS x"


@relational("length_outliers")
def length_outliers(d: Spark) -> str:
    """The bound of one and a half quartile ranges, and texts over it, over 2500 characters and over the 95th percentile; quartiles from counts by length."""
    q = f"SELECT {d.pct('n', 0.25)} AS q1, {d.pct('n', 0.75)} AS q3, {d.pct('n', 0.95)} AS p95 FROM ({lengths(d)}) AS l"
    return f"SELECT q3 + 1.5 * (q3 - q1) AS bound, count(*) FILTER (WHERE n > q3 + 1.5 * (q3 - q1)) AS n_over, count(*) FILTER (WHERE n > 2500) AS n_over_2500, count(*) FILTER (WHERE n > p95) AS n_over_p95 FROM ({lengths(d)}) AS l CROSS JOIN ({q}) AS q GROUP BY q3, q1"


@relational("split_sizes")
def split_sizes(d: Spark) -> str:
    """Rows of each split and their share."""
    return "SELECT split, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER () AS percent FROM {examples} GROUP BY split"


@relational("length_buckets")
def length_buckets(d: Spark) -> str:
    """Descriptions by length in five buckets closed on both sides; longer ones are in none."""
    b = "CASE WHEN n <= 50 THEN '0-50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200' WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' END"
    return f"SELECT {b} AS bucket, count(*) AS n, avg(n) AS mean FROM (SELECT length(description) AS n FROM {{examples}} WHERE description <> '') AS l WHERE n <= 1000 GROUP BY {b}"


def words_of(d: Spark, x: str) -> str:
    return d.filter(d.split(d.sub(f"lower({x})", r"[\t\n\r ]+", " "), " "), "x <> ''")


@relational("token_top10")
def token_top10(d: Spark) -> str:
    """The ten commonest words, ties by the alphabet."""
    return f"SELECT word, n FROM (SELECT item AS word, count(*) AS n FROM {{documents}} AS t, {d.each(words_of(d, 't.text'))} AS w GROUP BY item) AS c ORDER BY n DESC, word LIMIT 10"


@relational("min_freq_vocab")
def min_freq_vocab(d: Spark) -> str:
    """Words that come five times or more."""
    return f"SELECT item AS word, count(*) AS n FROM {{documents}} AS t, {d.each(words_of(d, 't.text'))} AS w GROUP BY item HAVING count(*) >= 5"


@relational("word_tokenizer")
def word_tokenizer(d: Spark) -> str:
    """Ids of the thousand commonest words from 2 on, 1 for all others; how often each comes. The rank is among words, of which the commonest are taken first."""
    words = f"SELECT item AS word, count(*) AS n FROM {{documents}} AS t, {d.each(words_of(d, 't.text'))} AS w GROUP BY item"
    top = f"SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id FROM (SELECT word, n FROM ({words}) AS a ORDER BY n DESC, word LIMIT 1000) AS b"
    return f"SELECT coalesce(t.id, 1) AS id, CAST(sum(w.n) AS BIGINT) AS n, count(*) AS n_words FROM ({words}) AS w LEFT JOIN ({top}) AS t ON w.word = t.word GROUP BY coalesce(t.id, 1)"


@relational("char_bigrams")
def char_bigrams(d: Spark) -> str:
    """Pairs of characters side by side with their counts."""
    cs = d.chars("text")
    pair = "[c[i] || c[i + 1] for i in range(1, len(c))]" if isinstance(d, Duck) else "zip_with(c, slice(c, 2, greatest(size(c), 1)), (x, y) -> x || y)"
    return f"SELECT item AS pair, count(*) AS n FROM (SELECT {pair} AS pairs FROM (SELECT {d.filter(cs, chr(120) + chr(32) + chr(60) + chr(62) + chr(32) + chr(39) * 2)} AS c FROM {{documents}} WHERE text IS NOT NULL) AS a) AS t, {d.each('t.pairs')} AS e WHERE length(item) = 2 GROUP BY item"


def hexed(d: Spark, x: str) -> str:
    return f"hex(encode({x}))" if isinstance(d, Duck) else f"hex(encode({x}, 'UTF-8'))"


def byte_runs(d: Spark, n: int) -> str:
    """One byte or two side by side, in hexadecimal, with their counts over all documents; Spark counts them in Arrow batches."""
    if not isinstance(d, Duck):
        return f"SELECT run, n FROM {{bytes_{n}}}"
    runs = f"[substr(h, 2 * i + 1, {2 * n}) for i in range(len(h) // 2 - {n - 1})]"
    return f"SELECT item AS run, count(*) AS n FROM (SELECT {runs} AS runs FROM (SELECT {hexed(d, 'text')} AS h FROM {{documents}} WHERE text IS NOT NULL) AS a) AS t, {d.each('t.runs')} AS e WHERE length(item) = {2 * n} GROUP BY item"


@relational("byte_counts")
def byte_counts(d: Spark) -> str:
    """How often each byte comes; partial counts are summed."""
    return f"SELECT run AS byte, n FROM ({byte_runs(d, 1)}) AS r"


@relational("byte_bigrams")
def byte_bigrams(d: Spark) -> str:
    """Pairs of bytes side by side with their counts."""
    return f"SELECT run AS pair, n FROM ({byte_runs(d, 2)}) AS r"


@relational("best_pair")
def best_pair(d: Spark) -> str:
    """The commonest pair of bytes, ties by the pair."""
    return f"SELECT run AS pair, n FROM ({byte_runs(d, 2)}) AS r ORDER BY n DESC, pair LIMIT 1"


def vocabulary_hex(d: Spark) -> str:
    """Tokens of two bytes of the vocabulary, in hexadecimal."""
    c = d.code("x")
    byte = f"CASE WHEN {c} >= 57344 THEN {c} - 57344 ELSE {c} END"
    hex2 = f"lpad(hex({byte}), 2, '0')" if not isinstance(d, Duck) else f"printf('%02X', {byte})"
    return f"SELECT DISTINCT {d.join(d.transform(d.filter(d.chars('token'), chr(120) + chr(32) + chr(60) + chr(62) + chr(32) + chr(39) * 2), hex2), '')} AS run FROM {{bpe_vocab}} WHERE length(token) = 2 AND token_id >= 4"


@relational("first_new_pair")
def first_new_pair(d: Spark) -> str:
    """The commonest pair of bytes that the vocabulary does not hold."""
    return f"SELECT r.run AS pair, r.n FROM ({byte_runs(d, 2)}) AS r LEFT JOIN ({vocabulary_hex(d)}) AS v ON r.run = v.run WHERE v.run IS NULL ORDER BY r.n DESC, pair LIMIT 1"


@relational("bigram_vocab")
def bigram_vocab(d: Spark) -> str:
    """In one pass, the commonest pairs of bytes that the vocabulary does not hold, as many as make it 1600 tokens."""
    room = "SELECT greatest(1600 - count(DISTINCT token), 0) FROM {bpe_vocab}"
    return f"SELECT pair, n FROM (SELECT r.run AS pair, r.n, row_number() OVER (ORDER BY r.n DESC, r.run) AS place FROM (SELECT run, n FROM ({byte_runs(d, 2)}) AS a ORDER BY n DESC, run LIMIT 4000) AS r LEFT JOIN ({vocabulary_hex(d)}) AS v ON r.run = v.run WHERE v.run IS NULL) AS x WHERE place <= ({room})"


@relational("bigram_vocab_assembled")
def bigram_vocab_assembled(d: Spark) -> str:
    """The four special tokens, all bytes, and the two hundred commonest pairs, with ids in that order."""
    special = " UNION ALL ".join(f"SELECT {i} AS id, '{t}' AS token" for i, t in enumerate(("<PAD>", "<UNK>", "<BOS>", "<EOS>")))
    number = "lpad(hex(item), 2, '0')" if not isinstance(d, Duck) else "printf('%02X', item)"
    single = f"SELECT 4 + item AS id, {number} AS token FROM (SELECT 1 AS one) AS o, {d.each(d.series('0', '255'))} AS b"
    pairs = f"SELECT 259 + row_number() OVER (ORDER BY n DESC, run) AS id, run AS token FROM (SELECT run, n FROM ({byte_runs(d, 2)}) AS a ORDER BY n DESC, run LIMIT 200) AS p"
    return f"SELECT CAST(id AS BIGINT) AS id, token FROM ({special} UNION ALL {single} UNION ALL {pairs}) AS u"


@relational("base_vocabulary")
def base_vocabulary(d: Spark) -> str:
    """Special tokens, then every character of the corpus in the order of code points."""
    special = " UNION ALL ".join(f"SELECT {i} AS id, '{t}' AS token" for i, t in enumerate(("<PAD>", "<UNK>", "<BOS>", "<EOS>")))
    return f"SELECT CAST(id AS BIGINT) AS id, token FROM ({special} UNION ALL SELECT 3 + row_number() OVER (ORDER BY {d.code('ch')}, ch) AS id, ch AS token FROM ({chars(d)}) AS c) AS u"


@relational("byte_symbols")
def byte_symbols(d: Spark) -> str:
    """B2: the symbols of each text, bytes and an end mark, counted, with the first and last."""
    return f"SELECT doc_id, CAST(length(h) / 2 + 1 AS BIGINT) AS n_symbols, substr(h, 1, 2) AS first_byte, substr(h, length(h) - 1, 2) AS last_byte FROM (SELECT doc_id, {hexed(d, 'text')} AS h FROM {{documents}} WHERE text <> '') AS a"


@relational("byte_table")
def byte_table(d: Spark) -> str:
    """B1: the character that stands for each byte: itself where it prints or ends a line, else one of the private range."""
    return f"SELECT CAST(item AS BIGINT) AS byte, CAST(CASE WHEN item IN (9, 10, 13) OR item BETWEEN 32 AND 126 OR item >= 161 THEN item ELSE 57344 + item END AS BIGINT) AS code_point FROM (SELECT 1 AS one) AS o, {d.each(d.series('0', '255'))} AS b"


@relational("timing_stats")
def timing_stats(d: Spark) -> str:
    """Mean, median, deviation of sample and population, variation, bounds and rate of the times over 0, by success."""
    t = "compile_time"
    return f"SELECT success, count(*) AS n, avg({t}) AS mean, {d.pct(t, 0.5)} AS median, stddev_samp({t}) AS sd_sample, stddev_pop({t}) AS sd, stddev_samp({t}) / avg({t}) * 100 AS cv, min({t}) AS least, max({t}) AS most, count(*) / sum({t}) AS per_second FROM (SELECT DISTINCT * FROM {{compile_results}}) AS r WHERE {t} > 0 GROUP BY success"


@relational("profiler_report")
def profiler_report(d: Spark) -> str:
    """Total, mean, bounds, count and share of each type of event, the largest first."""
    return "SELECT event_type AS name, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most, count(*) AS n, sum(value) * 100 / sum(sum(value)) OVER () AS percent FROM {events} GROUP BY event_type ORDER BY total DESC"


@relational("hit_rate")
def hit_rate(d: Spark) -> str:
    """A request hits if its endpoint and size came before from the same client; the rate of sums by endpoint. Sums of parts can be added."""
    seen = "SELECT client_ip, endpoint, n_chars, count(*) AS n FROM (SELECT DISTINCT * FROM {request_log}) AS r WHERE client_ip IS NOT NULL AND n_chars >= 0 GROUP BY client_ip, endpoint, n_chars"
    return f"SELECT endpoint, CAST(sum(n) AS BIGINT) AS n_requests, CAST(sum(n - 1) AS BIGINT) AS n_hits, sum(n - 1) / sum(n) AS rate FROM ({seen}) AS s GROUP BY endpoint"


@relational("perplexity")
def perplexity(d: Spark) -> str:
    """The exponent of summed loss over summed tokens, and of the mean of losses; an event's value over 100 is a loss, its key a number of tokens."""
    rows = f"SELECT event_type, value / 100 AS loss, CAST({d.extract('props', '([0-9]+)')} AS BIGINT) AS n FROM {{events}} WHERE {d.match('props', '[0-9]')}"
    return f"SELECT event_type, exp(sum(loss * n) / nullif(sum(n), 0)) AS by_token, exp(avg(loss)) AS by_batch, stddev_pop(loss) AS sd, min(loss) AS least, max(loss) AS most FROM ({rows}) AS r GROUP BY event_type"


@relational("masked_accuracy")
def masked_accuracy(d: Spark) -> str:
    """The share of right guesses where the target is no padding: an event's key is the target, the hundredth of its value the guess."""
    rows = f"SELECT event_type, CAST({d.extract('props', '([0-9]+)')} AS BIGINT) AS target, CAST(floor(value) AS BIGINT) AS guess FROM {{events}} WHERE {d.match('props', '[0-9]')}"
    return f"SELECT event_type, count(*) FILTER (WHERE target <> 0) AS n, count(*) FILTER (WHERE target <> 0 AND guess = target) / nullif(count(*) FILTER (WHERE target <> 0), 0) AS accuracy FROM ({rows}) AS r GROUP BY event_type"


@relational("early_stop")
def early_stop(d: Spark) -> str:
    """For each user, the event after which five in a row brought no new least value; NULL where there is none."""
    best = "SELECT user_id, event_id, ts, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {events}"
    groups = f"SELECT *, sum(CASE WHEN before IS NULL OR value < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM ({best}) AS b"
    counted = f"SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1 AS stale FROM ({groups}) AS x"
    first = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ({counted}) AS c WHERE stale = 5"
    return f"SELECT u.user_id, s.event_id FROM (SELECT DISTINCT user_id FROM {{events}}) AS u LEFT JOIN (SELECT user_id, event_id FROM ({first}) AS f WHERE k = 1) AS s ON u.user_id = s.user_id"


@relational("repeat_stop")
def repeat_stop(d: Spark) -> str:
    """Documents in which a word comes five times in a row, with the first place."""
    w = words_of(d, "text")
    same = "[CASE WHEN w[i] = w[i + 1] THEN '1' ELSE '0' END for i in range(1, len(w))]" if isinstance(d, Duck) else "zip_with(w, slice(w, 2, greatest(size(w), 1)), (x, y) -> CASE WHEN x = y THEN '1' ELSE '0' END)"
    return f"SELECT doc_id, CAST(place AS BIGINT) AS place FROM (SELECT doc_id, instr({d.join(same, '')}, '1111') AS place FROM (SELECT doc_id, {w} AS w FROM {{documents}} WHERE text IS NOT NULL) AS a) AS b WHERE place > 0"


@relational("top_k_filter")
def top_k_filter(d: Spark) -> str:
    """The three likeliest events of each user, ties by id."""
    return "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM {events}) AS r WHERE place <= 3"


@relational("top_p_filter")
def top_p_filter(d: Spark) -> str:
    """The likeliest events of each user until those before make up nine tenths."""
    return (
        "SELECT user_id, event_id FROM (SELECT user_id, event_id, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM "
        "(SELECT user_id, event_id, value / sum(value) OVER (PARTITION BY user_id) AS p FROM {events}) AS a) AS b WHERE before <= 0.9"
    )


@relational("beam_step")
def beam_step(d: Spark) -> str:
    """One step of a beam of three: every hypothesis, a user's three likeliest events, goes on with each of three kinds of next event, and the three best sums stay."""
    p = "SELECT user_id, event_id, ln(value + 1) AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM {events}"
    nexts = "SELECT event_type, avg(ln(value + 1)) AS score, row_number() OVER (ORDER BY avg(ln(value + 1)) DESC, event_type) AS place FROM {events} GROUP BY event_type"
    return f"SELECT user_id, event_id, event_type, score FROM (SELECT h.user_id, h.event_id, n.event_type, h.score + n.score AS score, row_number() OVER (PARTITION BY h.user_id ORDER BY h.score + n.score DESC, h.event_id, n.event_type) AS place FROM ({p}) AS h JOIN ({nexts}) AS n ON n.place <= 3 AND h.place <= 3) AS b WHERE place <= 3"


@relational("oov_by_block")
def oov_by_block(d: Spark) -> str:
    """Distinct characters of the corpus by range, and those that no token holds as they are."""
    held = f"SELECT DISTINCT item AS ch FROM {{bpe_vocab}} AS v, {d.each(d.chars('v.token'))} AS e WHERE v.token_id >= 4 AND item <> ''"
    return f"SELECT {block_of(d, 'c.ch')} AS block, count(*) AS n_distinct, count(*) FILTER (WHERE h.ch IS NULL) AS n_unknown, CAST(coalesce(sum(CASE WHEN h.ch IS NULL THEN c.n END), 0) AS BIGINT) AS n_occurrences FROM ({chars(d)}) AS c LEFT JOIN ({held}) AS h ON c.ch = h.ch GROUP BY {block_of(d, 'c.ch')}"
