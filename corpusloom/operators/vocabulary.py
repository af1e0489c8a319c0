"""Vocabularies and merge lists: membership, defects, gaps, profiles, conversions."""

from __future__ import annotations

from corpusloom.plans.dialect import Duck, Spark, relational

#: Tokens with their ids, each id once: of rows that share an id, the least token.
CLEAN = "SELECT token_id, min(token) AS token FROM {bpe_vocab} WHERE token_id IS NOT NULL AND token IS NOT NULL GROUP BY token_id"
#: Characters that a program needs.
ESSENTIAL = "{}()[]<>;:,.+-*/%=!&|^~#\"'\\_ \t\n0a"


@relational("vocab_defects")
def vocab_defects(d: Spark) -> str:
    """rows whose token is empty, comes again, is over 1000 characters or holds a control character."""
    again = "row_number() OVER (PARTITION BY token ORDER BY token_id) > 1"
    return (
        f"SELECT token_id, defect FROM (SELECT token_id, CASE WHEN token IS NULL OR token = '' THEN 'empty' WHEN again THEN 'duplicate' WHEN length(token) > 1000 THEN 'long' WHEN {d.match('token', '[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0B' + chr(92) + 'x0C' + chr(92) + 'x0E-' + chr(92) + 'x1F]')} THEN 'control' END AS defect "
        f"FROM (SELECT token_id, token, {again} AS again FROM {{bpe_vocab}}) AS r) AS x WHERE defect IS NOT NULL"
    )


@relational("vocab_membership")
def vocab_membership(d: Spark) -> str:
    """whether each operand of a merge, and its result, is a token."""
    has = lambda e: f"EXISTS (SELECT 1 FROM ({CLEAN}) AS v WHERE v.token = {e})"
    return f"SELECT merge_rank, {has('m.left_token')} AS has_left, {has('m.right_token')} AS has_right FROM {{bpe_merges}} AS m"


@relational("vocab_accessors")
def vocab_accessors(d: Spark) -> str:
    """Sizes, bounds of ids and the special tokens."""
    return "SELECT count(*) AS n_rows, count(DISTINCT token_id) AS n_ids, count(DISTINCT token) AS n_tokens, min(token_id) AS least, max(token_id) AS most, max(CASE WHEN token_id = 0 THEN token END) AS pad, max(CASE WHEN token_id = 1 THEN token END) AS unk, max(CASE WHEN token_id = 2 THEN token END) AS bos, max(CASE WHEN token_id = 3 THEN token END) AS eos FROM {bpe_vocab}"


@relational("vocab_inverse")
def vocab_inverse(d: Spark) -> str:
    """The least id of each token."""
    return "SELECT token, min(token_id) AS token_id FROM {bpe_vocab} WHERE token <> '' GROUP BY token"


@relational("vocab_profile")
def vocab_profile(d: Spark) -> str:
    """Tokens by class with the bounds, mean and upper median of their lengths, the median from counts by length."""
    cls = f"CASE WHEN token_id < 4 THEN 'special' WHEN {d.match('token', chr(92) + 'A[ -~]*' + chr(92) + 'z')} THEN 'ascii' ELSE 'other' END"
    by = f"SELECT cls, n, count(*) AS c FROM (SELECT {cls} AS cls, CAST(length(token) AS BIGINT) AS n FROM ({CLEAN}) AS v WHERE token <> '') AS l GROUP BY cls, n"
    run = f"SELECT cls, n, c, sum(c) OVER (PARTITION BY cls ORDER BY n) AS upto, sum(c) OVER (PARTITION BY cls) AS total FROM ({by}) AS b"
    return f"SELECT cls, CAST(max(total) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN n = 1 THEN c ELSE 0 END) AS BIGINT) AS n_single, min(n) AS least, max(n) AS most, sum(n * c) / sum(c) AS mean, min(CASE WHEN upto > floor(total / 2) THEN n END) AS median FROM ({run}) AS r GROUP BY cls"


@relational("longest_tokens")
def longest_tokens(d: Spark) -> str:
    """T4: the ten longest tokens, ties by id."""
    return f"SELECT token_id, token, CAST(length(token) AS BIGINT) AS n FROM ({CLEAN}) AS v ORDER BY n DESC, token_id LIMIT 10"


@relational("vocab_densify")
def vocab_densify(d: Spark) -> str:
    """Ids from 0 without gaps, and the old ones; missing ids filled with a name."""
    span = f"SELECT CAST(item AS BIGINT) AS id FROM (SELECT min(token_id) AS lo, max(token_id) AS hi FROM ({CLEAN}) AS v) AS b, {d.each(d.series('b.lo', 'b.hi'))} AS e"
    return f"SELECT s.id AS old_id, coalesce(v.token, '<MISSING_' || CAST(s.id AS VARCHAR(20)) || '>') AS token, CASE WHEN v.token IS NOT NULL THEN row_number() OVER (PARTITION BY v.token IS NOT NULL ORDER BY s.id) - 1 END AS new_id FROM ({span}) AS s LEFT JOIN ({CLEAN}) AS v ON v.token_id = s.id"


@relational("vocab_export")
def vocab_export(d: Spark) -> str:
    """K8: a line of text for each token."""
    return f"SELECT token_id, token || {d.lit(chr(9))} || CAST(token_id AS VARCHAR(20)) AS line FROM ({CLEAN}) AS v"


@relational("vocab_layouts")
def vocab_layouts(d: Spark) -> str:
    """The vocabulary written as JSON in three layouts, an object by id, a list under `tokens` and a bare list, and read again. A list has no gaps, so its ids are places."""
    tokens = f"SELECT token_id, row_number() OVER (ORDER BY token_id) - 1 AS place, token FROM ({CLEAN}) AS v"
    if isinstance(d, Duck):
        return f"SELECT l.layout, CASE WHEN l.layout = 'object' THEN t.token_id ELSE t.place END AS id, t.token FROM ({tokens}) AS t, (VALUES ('object'), ('tokens'), ('list')) AS l(layout)"
    as_map = f"SELECT to_json(map_from_entries(collect_list(struct(CAST(token_id AS STRING), token)))) AS j FROM ({tokens}) AS t"
    as_list = f"SELECT to_json(transform(sort_array(collect_list(struct(place, token))), x -> x.token)) AS j FROM ({tokens}) AS t"
    return (
        f"SELECT 'object' AS layout, CAST(key AS BIGINT) AS id, value AS token FROM ({as_map}) AS a LATERAL VIEW explode(from_json(j, 'map<string,string>')) AS key, value "
        f"UNION ALL SELECT 'tokens' AS layout, CAST(pos AS BIGINT) AS id, token FROM ({as_list}) AS b LATERAL VIEW posexplode(from_json('{{\"tokens\":' || j || '}}', 'tokens array<string>').tokens) AS pos, token "
        f"UNION ALL SELECT 'list' AS layout, CAST(pos AS BIGINT) AS id, token FROM ({as_list}) AS c LATERAL VIEW posexplode(from_json(j, 'array<string>')) AS pos, token"
    )


@relational("token_lookup")
def token_lookup(d: Spark) -> str:
    """The ids of a merge's operands, 1 for one that is no token."""
    inverse = "SELECT token, min(token_id) AS token_id FROM {bpe_vocab} WHERE token <> '' GROUP BY token"
    return f"SELECT m.merge_rank, coalesce(l.token_id, 1) AS left_id, coalesce(r.token_id, 1) AS right_id FROM {{bpe_merges}} AS m LEFT JOIN ({inverse}) AS l ON l.token = m.left_token LEFT JOIN ({inverse}) AS r ON r.token = m.right_token"


@relational("merge_rule_ids")
def merge_rule_ids(d: Spark) -> str:
    """Merges whose operands and result are tokens, in ids."""
    inverse = "SELECT token, min(token_id) AS token_id FROM {bpe_vocab} WHERE token <> '' GROUP BY token"
    return f"SELECT m.merge_rank, l.token_id AS left_id, r.token_id AS right_id, x.token_id AS merged_id FROM {{bpe_merges}} AS m JOIN ({inverse}) AS l ON l.token = m.left_token JOIN ({inverse}) AS r ON r.token = m.right_token JOIN ({inverse}) AS x ON x.token = m.left_token || m.right_token"


@relational("packed_merge_keys")
def packed_merge_keys(d: Spark) -> str:
    """Both ids of a merge in one number, and taken out again."""
    rules = merge_rule_ids(d)
    left = "shiftleft(CAST(left_id AS BIGINT), 32)" if d.name == "spark" else "(CAST(left_id AS BIGINT) << 32)"
    back = "shiftright(k, 32)" if d.name == "spark" else "(k >> 32)"
    return f"SELECT merge_rank, k AS packed, CAST({back} AS BIGINT) AS left_id, CAST(k & 4294967295 AS BIGINT) AS right_id FROM (SELECT merge_rank, {left} | CAST(right_id AS BIGINT) AS k FROM ({rules}) AS r) AS p"


@relational("bpe_pair_rank_join")
def bpe_pair_rank_join(d: Spark) -> str:
    """For every pair of characters side by side in a token, the rank of its merge."""
    cs = d.filter(d.chars("token"), "x <> ''")
    pair = "[{'l': c[i], 'r': c[i + 1]} for i in range(1, len(c))]" if isinstance(d, Duck) else "transform(sequence(1, greatest(size(c) - 1, 1)), i -> struct(try_element_at(c, i) AS l, try_element_at(c, i + 1) AS r))"
    pairs = f"SELECT token_id, CAST(pos AS BIGINT) AS pos, item.l AS l, item.r AS r FROM (SELECT token_id, {pair} AS ps FROM (SELECT token_id, {cs} AS c FROM ({CLEAN}) AS v WHERE length(token) > 1 AND token_id >= 4) AS a) AS t, {d.each('t.ps')} AS e"
    return f"SELECT p.token_id, p.pos, m.merge_rank FROM ({pairs}) AS p JOIN (SELECT left_token, right_token, min(merge_rank) AS merge_rank FROM {{bpe_merges}} GROUP BY left_token, right_token) AS m ON m.left_token = p.l AND m.right_token = p.r"


@relational("essential_chars")
def essential_chars(d: Spark) -> str:
    """Which characters that programs need are tokens of their own."""
    codes = d.array(*(str(ord(c)) for c in ESSENTIAL))
    return f"SELECT CAST(e.item AS BIGINT) AS code_point, EXISTS (SELECT 1 FROM ({CLEAN}) AS v WHERE length(v.token) = 1 AND {d.code('v.token')} = e.item) AS known FROM (SELECT 1 AS one) AS o, {d.each(codes)} AS e"
