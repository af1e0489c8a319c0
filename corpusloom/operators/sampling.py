"""Samples, splits, shuffles, chunks and variations that are the same on any cluster: ordered by a hash of the id, not by chance.

A place in the whole order is the count of all smaller hash prefixes, cumulated over the prefixes, and a rank within the prefix; no window spans all rows.
"""

from __future__ import annotations

from corpusloom.plans.dialect import Spark, relational

#: A verb and what may stand for it.
VARIANTS = {"Write": ["Create", "Make", "Develop", "Implement"], "Create": ["Write", "Make", "Build", "Implement"], "Implement": ["Write", "Create", "Build", "Develop"], "Make": ["Write", "Create", "Build", "Develop"], "Напишите": ["Создайте", "Реализуйте", "Разработайте", "Составьте"]}
SEED = 42


def placed(d: Spark, table: str, key: str, bucket: str | None = None, order: str | None = None) -> str:
    """(key, place from 1) of every row with a key."""
    h = order or d.hashed(key, SEED)
    bucket = bucket or "substr(h, 1, 3)"
    rows = f"SELECT k, h, {bucket} AS bucket FROM (SELECT {key} AS k, {h} AS h FROM {table} WHERE {key} IS NOT NULL) AS a"
    before = f"SELECT bucket, sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM (SELECT bucket, count(*) AS n FROM ({rows}) AS r GROUP BY bucket) AS c"
    return f"SELECT r.k, CAST(b.before + row_number() OVER (PARTITION BY r.bucket ORDER BY r.h, r.k) AS BIGINT) AS place FROM ({rows}) AS r JOIN ({before}) AS b ON r.bucket = b.bucket"


@relational("hash_sample")
def hash_sample(d: Spark) -> str:
    """Two hundred rows without replacement."""
    return f"SELECT example_id FROM (SELECT example_id, {d.hashed('example_id', SEED)} AS h FROM {{examples}}) AS a ORDER BY h, example_id LIMIT 200"


@relational("hash_shuffle")
def hash_shuffle(d: Spark) -> str:
    """Every row with its place in a mixed order."""
    return f"SELECT k AS example_id, place FROM ({placed(d, '{examples}', 'example_id')}) AS p"


@relational("fixed_split")
def fixed_split(d: Spark) -> str:
    """500 rows for test, then 800 for validation, the rest for training; fewer where the table is small."""
    return f"SELECT k AS example_id, CASE WHEN place <= 500 THEN 'test' WHEN place <= 1300 THEN 'val' ELSE 'train' END AS part FROM ({placed(d, '{examples}', 'example_id')}) AS p"


@relational("fraction_split")
def fraction_split(d: Spark) -> str:
    """Four fifths for training, the number rounded down."""
    return f"SELECT k AS example_id, CASE WHEN place <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS part FROM ({placed(d, '{examples}', 'example_id')}) AS p CROSS JOIN (SELECT count(*) AS n FROM {{examples}} WHERE example_id IS NOT NULL) AS c"


@relational("contiguous_chunks")
def contiguous_chunks(d: Spark) -> str:
    """Eight chunks of documents side by side in the order of their ids, the first ones longer by one where it does not come out even."""
    p = placed(d, "{documents}", "doc_id", "floor(k / 4096)", "doc_id")
    chunk = "CASE WHEN place <= m * (q + 1) THEN floor((place - 1) / (q + 1)) ELSE m + floor((place - 1 - m * (q + 1)) / greatest(q, 1)) END"
    return f"SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(k) AS first_doc, max(k) AS last_doc FROM (SELECT k, {chunk} AS chunk FROM ({p}) AS p CROSS JOIN (SELECT floor(count(*) / 8) AS q, count(*) % 8 AS m FROM {{documents}} WHERE doc_id IS NOT NULL) AS c) AS x GROUP BY chunk"


@relational("augment")
def augment(d: Spark) -> str:
    """Seven rows in ten get up to two variations, which begin with another verb; those equal to the original are left out, and all stand with the originals."""
    first = d.elem(d.split("description", " "), 1)
    h = d.hashed(d.concat("CAST(v.item AS VARCHAR(9))", d.lit(":"), "CAST(example_id AS VARCHAR(30))"), SEED)
    verb = "CASE " + " ".join(f"WHEN verb = '{v}' THEN CASE WHEN substr(h, 3, 1) < '4' THEN '{a}' WHEN substr(h, 3, 1) < '8' THEN '{b}' WHEN substr(h, 3, 1) < 'c' THEN '{c}' ELSE '{e}' END" for v, (a, b, c, e) in VARIANTS.items()) + " ELSE verb END"
    rows = f"SELECT example_id, description, verb, CAST(v.item AS BIGINT) AS variation, {h} AS h FROM (SELECT example_id, description, {first} AS verb FROM {{examples}} WHERE description IS NOT NULL) AS e, {d.each(d.array('1', '2'))} AS v"
    new = f"SELECT example_id, variation, {verb} || substr(description, length(verb) + 1) AS text, description FROM ({rows}) AS r WHERE substr(h, 1, 2) < 'b3'"
    return f"SELECT example_id, CAST(0 AS BIGINT) AS variation, description AS text FROM {{examples}} WHERE description IS NOT NULL UNION ALL SELECT example_id, variation, text FROM ({new}) AS n WHERE text <> description"
