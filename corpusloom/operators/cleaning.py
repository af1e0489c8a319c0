"""Cleaning and derived columns of texts and programs."""

from __future__ import annotations

from corpusloom.plans.dialect import Spark, relational

#: The characters that a model's text form replaces, in the order in which they are replaced (brackets of earlier ones are replaced again).
PLACEHOLDERS = {
    ",": "COMMA", "\n": "NEWLINE", ";": "SEMICOLON", "{": "LBRACE", "}": "RBRACE", "(": "LPAREN", ")": "RPAREN", "[": "LBRACKET", "]": "RBRACKET", "<": "LT", ">": "GT",
    "=": "EQUALS", "+": "PLUS", "-": "MINUS", "*": "MULTIPLY", "/": "DIVIDE", '"': "QUOTE", "'": "SQUOTE", "#": "HASH",
}
#: What strip() of Python and its \s take, as the inside of a character class that both engines read alike.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(d: Spark, x: str) -> str:
    return d.sub(d.sub(x, rf"\A[{SPACE}]+", ""), rf"[{SPACE}]+\z", "")


def squeeze(d: Spark, x: str) -> str:
    """Every run of white space one blank, none at the ends."""
    return strip(d, d.sub(x, rf"[{SPACE}]+", " "))


def folded(d: Spark, x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {d.lit(a)}, {d.lit(b)})"
    return x


@relational("clean_code_field")
def clean_code_field(d: Spark) -> str:
    """One pair of outer quotes off, then white space; NULL stays NULL. A field is what stands between the first two separators."""
    field = d.elem(d.split("line_text", '","'), 2)
    outer = f"CASE WHEN length(f) >= 2 AND f LIKE '\"%' AND f LIKE '%\"' THEN substr(f, 2, length(f) - 2) ELSE f END"
    return f"SELECT line_id, {strip(d, outer)} AS code FROM (SELECT line_id, CASE WHEN line_id % 2 = 0 THEN '\"' || {field} || '\"' ELSE {field} END AS f FROM {{raw_lines}}) AS t WHERE f IS NOT NULL"


@relational("clean_text_v1")
def clean_text_v1(d: Spark) -> str:
    """Commas and line ends become words, NULL the empty text."""
    return f"SELECT doc_id, {squeeze(d, folded(d, 'coalesce(text, {})'.format(d.lit('')), [(',', ' [COMMA] '), (chr(10), ' [NEWLINE] ')]))} AS cleaned FROM {{documents}}"


@relational("clean_text_v2")
def clean_text_v2(d: Spark) -> str:
    """D3: nineteen characters become words, one after the other."""
    return f"SELECT doc_id, {squeeze(d, folded(d, 'coalesce(text, {})'.format(d.lit('')), [(c, f' [{w}] ') for c, w in PLACEHOLDERS.items()]))} AS cleaned FROM {{documents}}"


@relational("clean_text_inverse")
def clean_text_inverse(d: Spark) -> str:
    """The words become characters again; line ends are lost to the last squeeze."""
    v1 = squeeze(d, folded(d, "text", [(",", " [COMMA] "), ("\n", " [NEWLINE] ")]))
    return f"SELECT doc_id, {squeeze(d, folded(d, v1, [(f' [{w}] ', c) for c, w in PLACEHOLDERS.items()]))} AS restored FROM {{documents}} WHERE text IS NOT NULL"


@relational("unescape_code")
def unescape_code(d: Spark) -> str:
    """Escaped quotes and line ends undone, any other backslash before a character dropped."""
    inner = folded(d, "code", [('\\"', '"'), ("\\n", "\n")])
    return f"SELECT line_id, {d.sub(inner, chr(92) * 2 + '([^' + chr(92) * 2 + '])', '$1')} AS code FROM (SELECT line_id, {d.elem(d.split('line_text', chr(34) + ',' + chr(34)), 2)} AS code FROM {{raw_lines}}) AS t WHERE code IS NOT NULL"


@relational("code_hashes")
def code_hashes(d: Spark) -> str:
    """The first sixteen digits of the md5, and whether the table's own agree."""
    return "SELECT example_id, substr(md5(code), 1, 16) AS code_hash, substr(md5(code), 1, 16) = code_hash AS agrees FROM {examples} WHERE code IS NOT NULL"


@relational("code_sizes")
def code_sizes(d: Spark) -> str:
    """Characters and lines, and whether the table's own agree."""
    lines = f"length(code) - length(replace(code, {d.lit(chr(10))}, '')) + 1"
    return f"SELECT example_id, CAST(length(code) AS BIGINT) AS n_chars, CAST({lines} AS BIGINT) AS n_lines, length(code) = code_length AND {lines} = lines_in_code AS agrees FROM {{examples}} WHERE code IS NOT NULL"


def style_of(d: Spark, x: str) -> str:
    """Which of the two styles a label names; NULL for one that looks like code, and for any other."""
    s = f"lower({strip(d, x)})"
    code = " OR ".join(d.has(x, d.lit(t)) for t in ("<<", ">>", "cout", "printf", ";", "{", "}"))
    return (
        f"CASE WHEN {x} IS NULL OR length({strip(d, x)}) > 100 OR {code} THEN NULL WHEN {d.has(s, d.lit('using_namespace_std'))} OR {d.has(s, d.lit('using namespace std'))} THEN 'using' "
        f"WHEN {d.has(s, d.lit('explicit_std'))} OR {d.has(s, d.lit('explicit std'))} THEN 'explicit' END"
    )


@relational("style_type")
def style_type(d: Spark) -> str:
    """The style that a label names, beside the table's own, which knows no spelling variants."""
    return f"SELECT example_id, style, {style_of(d, 'style')} AS named, style_type FROM {{examples}}"


def error_kind(d: Spark, x: str) -> str:
    """The first of eight marks that a compiler's message holds."""
    m = f"lower({x})"
    has = lambda t: d.has(m, d.lit(t))
    return (
        f"CASE WHEN {has('expected')} THEN 'syntax_error' WHEN {has('undefined reference')} THEN 'undefined_reference' WHEN {has('not declared')} THEN 'undeclared_identifier' "
        f"WHEN {has('invalid')} AND {has('character')} THEN 'invalid_character' WHEN {has('missing')} THEN 'missing_symbol' WHEN {has('timeout')} THEN 'timeout' "
        f"WHEN {has('error:')} THEN 'compiler_error' WHEN {has('warning:')} THEN 'warning_treated_as_error' ELSE 'other_error' END"
    )


@relational("error_category")
def error_category(d: Spark) -> str:
    """The kind of every message; a result without a message has none."""
    return f"SELECT result_id, {error_kind(d, 'error_message')} AS category FROM {{compile_results}} WHERE error_message IS NOT NULL"


def block_of(d: Spark, ch: str) -> str:
    """Which of eight ranges of code points a character is in."""
    c = d.code(ch)
    ranges = [(0x20, 0x7E, "ascii"), (0x0, 0x1F, "control"), (0x400, 0x4FF, "cyrillic"), (0xC0, 0x24F, "latin_extended"), (0x2000, 0x206F, "punctuation"), (0x4E00, 0x9FFF, "cjk"), (0x1F300, 0x1FAFF, "emoji")]
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in ranges) + " ELSE 'other' END"


@relational("unicode_blocks")
def unicode_blocks(d: Spark) -> str:
    """Characters of the corpus by range."""
    return f"SELECT block, CAST(sum(n) AS BIGINT) AS n_chars, count(*) AS n_distinct FROM (SELECT item, {block_of(d, 'item')} AS block, count(*) AS n FROM {{documents}} AS t, {d.each(d.chars('t.text'))} AS c WHERE item <> '' GROUP BY item) AS g GROUP BY block"


@relational("prefix_strip")
def prefix_strip(d: Spark) -> str:
    """`std::` off every name, in files of the style that uses none; wider than a list of names, as any name counts."""
    return f"SELECT file_id, {d.sub('code', 'std::([A-Za-z_])', '$1')} AS code FROM {{source_files}} WHERE style = 'using_namespace_std' AND code IS NOT NULL"


@relational("preview")
def preview(d: Spark) -> str:
    """The first hundred characters, and dots where there are more."""
    return "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM {documents}"


@relational("instruction_pairs")
def instruction_pairs(d: Spark) -> str:
    """Description and code joined by a blank line, and cut at the first one again; pairs with an empty side are left out."""
    text = d.lit("\n\n")
    return (
        f"SELECT example_id, CASE WHEN place > 0 THEN substr(t, 1, place - 1) ELSE t END AS instruction, CASE WHEN place > 0 THEN substr(t, place + 2) ELSE '' END AS code FROM "
        f"(SELECT example_id, t, instr(t, {text}) AS place FROM (SELECT example_id, description || {text} || code AS t FROM {{examples}} WHERE {strip(d, 'description')} <> '' AND {strip(d, 'code')} <> '') AS a) AS b"
    )


@relational("nonempty_pairs")
def nonempty_pairs(d: Spark) -> str:
    """rows with both a description and code."""
    return f"SELECT example_id FROM {{examples}} WHERE {strip(d, 'description')} <> '' AND {strip(d, 'code')} <> ''"


@relational("training_texts")
def training_texts(d: Spark) -> str:
    """M1: descriptions and code as one column of texts, repeats kept."""
    return "SELECT example_id, 'description' AS kind, description AS text FROM {examples} UNION ALL SELECT example_id, 'code' AS kind, code AS text FROM {examples}"


@relational("distinct_texts")
def distinct_texts(d: Spark) -> str:
    """M6: every text once, by its hash, with its first document."""
    return "SELECT md5(text) AS text_hash, min(doc_id) AS first_doc, count(*) AS n_docs FROM {documents} WHERE text IS NOT NULL GROUP BY md5(text)"


@relational("corpus_lines")
def corpus_lines(d: Spark) -> str:
    """The lines of the corpus without white space at their ends, empty ones left out."""
    return f"SELECT doc_id, pos, line FROM (SELECT doc_id, CAST(pos AS BIGINT) AS pos, {strip(d, 'item')} AS line FROM {{documents}} AS t, {d.each(d.split('t.text', chr(10)))} AS l) AS s WHERE line <> ''"


@relational("first_k_lines")
def first_k_lines(d: Spark) -> str:
    """The first hundred lines of the corpus, in the order of documents."""
    return corpus_lines(d).replace("WHERE line <> ''", "WHERE line <> '' ORDER BY doc_id, pos LIMIT 100")


@relational("source_crawl")
def source_crawl(d: Spark) -> str:
    """C++ files with the lines that are neither empty nor comments; all files and lines, not a few."""
    line = strip(d, "x")
    kept = d.filter(d.split("code", "\n"), f"{line} <> '' AND {line} NOT LIKE '//%' AND {line} NOT LIKE '/*%' AND {line} NOT LIKE '*%'")
    return f"SELECT file_id, repo, file_path, {d.size('kept')} AS n_lines, CAST(length({d.join('kept', '')}) AS BIGINT) AS n_chars FROM (SELECT file_id, repo, file_path, {kept} AS kept FROM {{source_files}} WHERE {d.match('file_path', '[.](cpp|cc|h|hpp)$')} AND code IS NOT NULL) AS t"


@relational("log_scrape")
def log_scrape(d: Spark) -> str:
    """The first pattern of a list that finds a number, else the last number of the message."""
    ladder = ["after ([0-9]+) s", "line ([0-9]+)", ":([0-9]+):", "([0-9]+)[^0-9]*$"]
    found = ', '.join(f"nullif({d.extract('error_message', p)}, '')" for p in ladder)
    return f"SELECT result_id, CAST(coalesce({found}) AS BIGINT) AS value FROM {{compile_results}} WHERE error_message IS NOT NULL"


@relational("string_functions")
def string_functions(d: Spark) -> str:
    """Case of ASCII letters only, ends, places and counts of a text."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        f"SELECT doc_id, md5(translate(text, '{up}', '{low}')) AS lower_hash, md5(translate(text, '{low}', '{up}')) AS upper_hash, CAST(length({strip(d, 'text')}) AS BIGINT) AS n_stripped, text LIKE '#%' AS heading, text LIKE '%.' AS ends_with_dot, "
        f"CAST(instr(text, 'the') AS BIGINT) AS first_the, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n_the, {d.size(d.split('text', ' '))} AS n_blanks_split FROM {{documents}} WHERE text IS NOT NULL"
    )


@relational("regex_functions")
def regex_functions(d: Spark) -> str:
    """White space squeezed, backslashes dropped, the first number found."""
    return f"SELECT doc_id, CAST(length({squeeze(d, 'text')}) AS BIGINT) AS n_squeezed, CAST(length({d.sub('text', chr(92) * 2, '')}) AS BIGINT) AS n_without_backslash, {d.extract('text', '([0-9]+)')} AS first_number FROM {{documents}} WHERE text IS NOT NULL"


@relational("utf8_functions")
def utf8_functions(d: Spark) -> str:
    """Characters and bytes, and the bytes of a text's first character."""
    return f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST({d.utf8('text')} AS BIGINT) AS n_bytes, CAST({d.utf8('substr(text, 1, 1)')} AS BIGINT) AS first_bytes, {d.code('substr(text, 1, 1)')} AS first_code FROM {{documents}} WHERE text <> ''"


@relational("math_functions")
def math_functions(d: Spark) -> str:
    """Exponent, logarithm, root, a share with a guard against zero, and softmax within a type of event."""
    sums = "SELECT event_type, sum(value) AS total, sum(exp(value / 100)) AS weights FROM {events} WHERE value >= 0 GROUP BY event_type"  # summed first, so a hot type stays spread
    return f"SELECT e.event_id, exp(-e.value / 100) AS decay, ln(e.value + 1) AS log_value, sqrt(e.value) AS root, e.value / nullif(s.total, 0) AS share, exp(e.value / 100) / s.weights AS softmax FROM {{events}} AS e JOIN ({sums}) AS s ON e.event_type = s.event_type WHERE e.value >= 0"
