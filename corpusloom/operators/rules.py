"""Rules that descriptions, keywords, styles, topics and programs must keep, and what breaks them.

Word lists are parameters with defaults for the tables at hand.
"""

from __future__ import annotations

from corpusloom.operators.cleaning import error_kind, strip, style_of
from corpusloom.plans.dialect import Spark, relational

#: First words that a task may begin with, in the languages of the tables.
VERBS = "write create make build develop implement define task exercise schreibe erstelle entwickle implementiere escribe crea desarrolla implementa напиши создай реализуй разработай составь выполни покажи".split()
#: Marks of code in a description.
MARKS = ("#include", "using namespace", "int main()", "cout <<", ";", "{", "}", "return ")
#: Names of the standard library that take its prefix in the explicit style.
LIBRARY = "cout cin endl string vector map set pair tuple queue deque stack array list bitset optional variant shared_ptr unique_ptr sort swap find_if count_if transform accumulate reverse regex thread mutex chrono getline stringstream ofstream iterator unordered_map".split()


def described(d: Spark) -> str:
    low = f"lower({strip(d, 'description')})"
    verb = " OR ".join(f"{low} LIKE '{v}%'" for v in VERBS)
    code = " OR ".join(d.has("description", d.lit(m)) for m in MARKS)
    return f"SELECT example_id, description, NOT ({verb}) AS wrong_verb, length(description) < 10 AS too_short, length(description) > 500 AS too_long, ({code}) AS code_in_description FROM {{examples}} WHERE description IS NOT NULL"


@relational("description_rules")
def description_rules(d: Spark) -> str:
    """the rules that each description breaks."""
    return f"SELECT example_id, wrong_verb, too_short, too_long, code_in_description FROM ({described(d)}) AS t"


@relational("good_descriptions")
def good_descriptions(d: Spark) -> str:
    """descriptions of 20 to 200 characters that break no rule."""
    return f"SELECT example_id, description FROM ({described(d)}) AS t WHERE length(description) BETWEEN 20 AND 200 AND NOT wrong_verb AND NOT code_in_description"


def keywords_of(d: Spark) -> str:
    """The keywords between commas, without blanks at their ends."""
    return d.filter(d.transform(d.split("keywords", ","), strip(d, "x")), "x <> ''")


def library(x: str) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in LIBRARY)})"


def keyworded(d: Spark) -> str:
    return f"SELECT example_id, topic, {style_of(d, 'style')} AS named, code, {keywords_of(d)} AS kws FROM {{examples}} WHERE keywords IS NOT NULL AND code IS NOT NULL"


BASE = "CASE WHEN item LIKE 'std::%' THEN substr(item, 6) ELSE item END"


@relational("keyword_rules")
def keyword_rules(d: Spark) -> str:
    """for each example none, too few and too many keywords, and keywords whose prefix is not that of the style or of the code."""
    base = "CASE WHEN x LIKE 'std::%' THEN substr(x, 6) ELSE x END"
    bare, full = f"x NOT LIKE 'std::%' AND {library('x')}", f"x LIKE 'std::%' AND {library(base)}"
    n = lambda c: d.size(d.filter("kws", c))
    has = lambda t: d.has("code", t)
    return (
        f"SELECT example_id, {d.size('kws')} = 0 AS none, {d.size('kws')} = 1 AS too_few, {d.size('kws')} > 15 AS too_many, "
        f"CASE WHEN named = 'explicit' THEN {n(bare)} WHEN named = 'using' THEN {n(full)} ELSE 0 END AS n_wrong_prefix, "
        f"CASE WHEN named = 'explicit' THEN {n(bare + ' AND ' + has(d.concat(d.lit('std::'), 'x')))} WHEN named = 'using' THEN {n(full + ' AND ' + has(base) + ' AND NOT ' + has('x'))} ELSE 0 END AS n_mismatch FROM ({keyworded(d)}) AS t"
    )


@relational("rule_totals")
def rule_totals(d: Spark) -> str:
    """A5: examples that break each rule of descriptions, and in all."""
    rules = ["wrong_verb", "too_short", "too_long", "code_in_description"]
    ones = {r: f"count(*) FILTER (WHERE {r})" for r in rules}
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, {e} AS n FROM ({described(d)}) AS t" for r, e in [*ones.items(), ("total", " + ".join(ones.values()))])


@relational("std_keywords")
def std_keywords(d: Spark) -> str:
    """keywords that are names of the library, with and without its prefix."""
    return f"SELECT {BASE} AS base, count(*) AS n, count(*) FILTER (WHERE item LIKE 'std::%') AS n_prefixed FROM ({keyworded(d)}) AS t, {d.each('t.kws')} AS e WHERE {library(BASE)} GROUP BY {BASE}"


def stands_in(d: Spark, kw: str, code: str) -> str:
    """Whether a keyword stands in code beside one of the signs that end a word, or at an end."""
    sides = [(" ", " "), ("", " "), (" ", ""), ("(", ""), ("", ")"), ("<", ">"), ("", ";"), ("", ","), ("", "."), ("->", ""), ("::", "")]
    return "(" + " OR ".join(d.has(code, d.concat(d.lit(a), kw, d.lit(b))) for a, b in sides) + f" OR starts_with({code}, {kw}) OR {'endswith' if d.name == 'spark' else 'ends_with'}({code}, {kw}))".replace("starts_with", "startswith" if d.name == "spark" else "starts_with")


@relational("keyword_in_code")
def keyword_in_code(d: Spark) -> str:
    """keywords of each example that stand in its code as words."""
    return f"SELECT example_id, count(*) AS n_keywords, count(*) FILTER (WHERE {stands_in(d, 'item', 'code')}) AS n_in_code FROM ({keyworded(d)}) AS t, {d.each('t.kws')} AS e GROUP BY example_id"


@relational("keyword_text_hits")
def keyword_text_hits(d: Spark) -> str:
    """Every keyword that its example's code holds, with or without the prefix; a row's keywords meet its own code only."""
    return f"SELECT example_id, item AS keyword FROM ({keyworded(d)}) AS t, {d.each('t.kws')} AS e WHERE {d.has('code', BASE)}"


@relational("keyword_prefix_fix")
def keyword_prefix_fix(d: Spark) -> str:
    """In the explicit style, names of the library without the prefix that the code uses with it get it."""
    fixed = d.transform("kws", f"CASE WHEN x NOT LIKE 'std::%' AND {library('x')} AND {d.has('code', d.concat(d.lit('std::'), 'x'))} THEN 'std::' || x ELSE x END")
    return f"SELECT example_id, {d.join('kws', ', ')} AS before, {d.join('fixed', ', ')} AS after FROM (SELECT example_id, kws, {fixed} AS fixed FROM ({keyworded(d)}) AS t WHERE named = 'explicit') AS f WHERE {d.join('kws', ', ')} <> {d.join('fixed', ', ')}"


@relational("style_violations")
def style_violations(d: Spark) -> str:
    """examples of the style without prefixes whose code uses them."""
    return f"SELECT example_id FROM {{examples}} WHERE {style_of(d, 'style')} = 'using' AND {d.has('code', d.lit('std::'))}"


@relational("code_structure_rules")
def code_structure_rules(d: Spark) -> str:
    """F8: programs of under ten characters, over 500 lines, or with control characters anywhere."""
    return f"SELECT file_id, length(code) >= 10 AS long_enough, length(code) - length(replace(code, {d.lit(chr(10))}, '')) <= 500 AS few_lines, NOT {d.match('code', '[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0B' + chr(92) + 'x0C' + chr(92) + 'x0E-' + chr(92) + 'x1F]')} AS no_control FROM {{source_files}} WHERE code IS NOT NULL"


@relational("malformed_code")
def malformed_code(d: Spark) -> str:
    """files with a line of over 1000 characters and no brace; every line is looked at."""
    return f"SELECT file_id FROM {{source_files}} WHERE code IS NOT NULL AND {d.exists(d.split('code', chr(10)), f'length(x) > 1000 AND NOT {d.has(chr(120), d.lit(chr(123)))} AND NOT {d.has(chr(120), d.lit(chr(125)))}')}"


@relational("load_stats")
def load_stats(d: Spark) -> str:
    """Programs by length, with the bounds of seven bins closed on the right; hashes that come again."""
    n = "length(code)"
    label = f"CASE WHEN {n} <= 100 THEN '<100' WHEN {n} <= 500 THEN '100-500' WHEN {n} <= 1000 THEN '500-1000' WHEN {n} <= 2000 THEN '1000-2000' WHEN {n} <= 5000 THEN '2000-5000' WHEN {n} <= 10000 THEN '5000-10000' ELSE '>10000' END"
    return f"SELECT {label} AS bin, count(*) AS n_programs, avg({n}) AS mean, CAST(min({n}) AS BIGINT) AS shortest, CAST(max({n}) AS BIGINT) AS longest, count(*) - count(DISTINCT md5(code)) AS n_repeats FROM {{examples}} WHERE code IS NOT NULL GROUP BY {label}"


@relational("unknown_styles")
def unknown_styles(d: Spark) -> str:
    """The ten commonest styles that name neither of the two, cut at fifty characters."""
    return f"SELECT substr(style, 1, 50) AS style, count(*) AS n FROM {{examples}} WHERE style IS NOT NULL AND {style_of(d, 'style')} IS NULL GROUP BY substr(style, 1, 50) ORDER BY n DESC, style LIMIT 10"


@relational("compile_summary")
def compile_summary(d: Spark) -> str:
    """Results by style with the success rate and the times that are over 0; exact repeats of a row count once."""
    t = "CASE WHEN compile_time > 0 THEN compile_time END"
    return (
        f"SELECT style, count(*) AS n, count(*) FILTER (WHERE success) AS n_success, count(*) FILTER (WHERE success) / nullif(count(*) FILTER (WHERE success IS NOT NULL), 0) AS rate, avg({t}) AS mean_time, min({t}) AS least_time, max({t}) AS most_time, "
        f"count(DISTINCT topic) AS n_topics FROM (SELECT DISTINCT * FROM {{compile_results}}) AS r GROUP BY style"
    )


@relational("compile_error_kinds")
def compile_error_kinds(d: Spark) -> str:
    """Failures by kind and topic."""
    return f"SELECT {error_kind(d, 'error_message')} AS kind, topic, count(*) AS n FROM (SELECT DISTINCT * FROM {{compile_results}}) AS r WHERE NOT success AND error_message IS NOT NULL GROUP BY {error_kind(d, 'error_message')}, topic"


@relational("topic_order")
def topic_order(d: Spark) -> str:
    """Topics in the order in which they first come."""
    return "SELECT topic, first_line, row_number() OVER (ORDER BY first_line, topic) AS place FROM (SELECT topic, min(example_id) AS first_line FROM {examples} WHERE topic IS NOT NULL GROUP BY topic) AS t"


@relational("topic_typos")
def topic_typos(d: Spark) -> str:
    """Pairs of topics that may be one: equal but for case, for `_`, for `_` and `-`, or one within the other and at most two characters longer.

    No pair is tried: equal keys are joined, for the last kind all that is left of a topic without two characters of its ends.
    """
    topics = "SELECT topic, lower(topic) AS low, min(example_id) AS first FROM {examples} WHERE topic IS NOT NULL AND topic <> '' GROUP BY topic"
    keys = [("case", "low", "low"), ("separator", "replace(low, '_', '')", "replace(low, '_', '')"), ("hyphen", "replace(low, '_', '-')", "replace(low, '_', '-')")]
    keys += [("within", f"substr(low, {1 + i}, greatest(length(low) - {i + j}, 0))", "low") for i in range(3) for j in range(3 - i) if i + j]
    keys += [("within", "low", "low")]
    joins = " UNION ".join(f"SELECT a.topic AS x, a.first AS fx, b.topic AS y, b.first AS fy, {k} AS kind FROM (SELECT topic, first, {e} AS key FROM ({topics}) AS t) AS a JOIN (SELECT topic, first, {f} AS key FROM ({topics}) AS t) AS b ON a.key = b.key AND a.topic <> b.topic AND a.key <> ''" for k, (_, e, f) in [({'case': 1, 'separator': 2, 'hyphen': 3, 'within': 4}[n], (n, e, f)) for n, e, f in keys])
    ordered = f"SELECT CASE WHEN fx < fy OR fx = fy AND x < y THEN x ELSE y END AS topic_a, CASE WHEN fx < fy OR fx = fy AND x < y THEN y ELSE x END AS topic_b, kind FROM ({joins}) AS j"
    return f"SELECT topic_a, topic_b, CASE min(kind) WHEN 1 THEN 'case' WHEN 2 THEN 'separator' WHEN 3 THEN 'hyphen' ELSE 'within' END AS kind FROM ({ordered}) AS o GROUP BY topic_a, topic_b"


@relational("keyword_set_consistency")
def keyword_set_consistency(d: Spark) -> str:
    """For each topic with both styles, the keywords that only one of them has; the prefix does not count on the explicit side.

    Distinct rows are joined both ways, so no topic is gathered in one place.
    """
    rows = f"SELECT DISTINCT topic, named, CASE WHEN named = 'explicit' THEN {BASE} ELSE item END AS kw FROM ({keyworded(d)}) AS t, {d.each('t.kws')} AS e WHERE topic IS NOT NULL AND named IS NOT NULL AND {d.has('code', BASE)}"
    both = f"SELECT coalesce(u.topic, x.topic) AS topic, u.kw AS u, x.kw AS x FROM (SELECT topic, kw FROM ({rows}) AS a WHERE named = 'using') AS u FULL OUTER JOIN (SELECT topic, kw FROM ({rows}) AS b WHERE named = 'explicit') AS x ON u.topic = x.topic AND u.kw = x.kw"
    counted = f"SELECT topic, count(u) AS n_using, count(x) AS n_explicit, count(*) FILTER (WHERE x IS NULL) AS only_using, count(*) FILTER (WHERE u IS NULL) AS only_explicit FROM ({both}) AS f GROUP BY topic"
    return f"SELECT *, CASE WHEN n_using = 0 OR n_explicit = 0 THEN 'skipped' WHEN only_using + only_explicit = 0 THEN 'consistent' ELSE 'inconsistent' END AS state FROM ({counted}) AS c"


@relational("result_lookup")
def result_lookup(d: Spark) -> str:
    """Each result with the example it is of."""
    return "SELECT r.result_id, e.example_id, e.split, r.success FROM (SELECT DISTINCT result_id, example_id, success FROM {compile_results}) AS r JOIN {examples} AS e ON r.example_id = e.example_id"


@relational("semi_lookup")
def semi_lookup(d: Spark) -> str:
    """Examples that have a result."""
    return "SELECT e.example_id FROM {examples} AS e WHERE EXISTS (SELECT 1 FROM {compile_results} AS r WHERE r.example_id = e.example_id)"


@relational("anti_lookup")
def anti_lookup(d: Spark) -> str:
    """Examples that have none."""
    return "SELECT e.example_id FROM {examples} AS e WHERE NOT EXISTS (SELECT 1 FROM {compile_results} AS r WHERE r.example_id = e.example_id)"


@relational("label_lookup")
def label_lookup(d: Spark) -> str:
    """Labels with the kind of their document, spelling variants of a subject joined, repeats of a label once."""
    return "SELECT DISTINCT l.doc_id, lower(trim(l.subject)) AS subject, x.doc_kind FROM {doc_labels} AS l JOIN {documents} AS x ON l.doc_id = x.doc_id WHERE l.subject IS NOT NULL"


@relational("synonym_first_hit")
def synonym_first_hit(d: Spark) -> str:
    """For every word of a description, the first entry of a list that it holds."""
    entries = ["write", "create", "program", "function", "list", "sort", "number"]
    low = "lower(item)"
    hit = "CASE " + " ".join(f"WHEN {d.has(low, d.lit(e))} THEN '{e}'" for e in entries) + " END"
    return f"SELECT entry, count(*) AS n FROM (SELECT {hit} AS entry FROM {{examples}} AS t, {d.each(d.split('t.description', ' '))} AS e) AS h WHERE entry IS NOT NULL GROUP BY entry"
