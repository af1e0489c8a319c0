from corpusloom.functions.packed import plain
from corpusloom.operators.packed_values import split_packed
from corpusloom.operators.records import parse_records

GOOD = '"d","int main() {\\n}","explicit_std","t","a, b"'
LINES = [
    (GOOD, None), (GOOD.replace("main()", 'f(""x"", \\"y\\")'), None), (GOOD.replace('"d",', "'d',"), "quoting"), (GOOD[:-1], "quoting"),
    (GOOD.replace('","t"', '","t","u"'), "columns"), (GOOD.replace("explicit_std", "explicit_std "), "values"), (GOOD.replace('"d"', '"  "'), "values"),
    (GOOD.replace("a, b", " , "), "values"), (GOOD.replace("int", "\x07"), "values"), (GOOD.replace("int", "\tint"), None), (GOOD + "\\", "quoting"),
    (GOOD.replace("int", "x\\n" * 30_000), None), ('"' * 6, "columns"), ("﷐" + GOOD, "quoting"),
]


def test_records(spark):
    none = ["", "# x", "﻿description,code,style,topic,keywords", None, '"description","code","style","topic","keywords"', "  "]
    df = spark.createDataFrame([(k, x, "clash") for k, (x, _) in enumerate(LINES)] + [(-1, x, "clash") for x in none], "line_id int, line_text string, description string")
    rows = {r["line_id"]: r for r in parse_records(df).collect()}
    assert {k: (r["errors"] or [None])[0] for k, r in rows.items()} == {k: why for k, (_, why) in enumerate(LINES)}
    assert rows[1]["_record"]["code"] == 'int f("x", "y") {\n}' and rows[0]["_record"]["keywords"] == "a, b" and rows[0]["description"] == "clash"
    assert parse_records(df.limit(0)).count() == 0


def test_pieces():
    assert plain('"a | b"\t#include\tfor(\;\;)') == ["a | b", "#include", "for(;;)"]
    assert plain("{i/o / 'operator||'|x,, x}") == ["i/o", "operator||", "x", "x"]
    assert plain(' ["a", "read, then write"] ') == ["a", "read, then write"] and plain(" , ") == [] == plain(None)
    assert plain("rule of five，C++17") == ["rule of five", "C++17"] and len(plain("x," * 50_000)) == 50_000


def test_split_learns_values(spark):
    rows = [(k, x) for k, x in enumerate(['"a | b", sort'] * 9 + ["sort|map"] * 9 + ["map | a | b", None, "", " ; ", "sort, sort"])]
    df = spark.createDataFrame(rows, "id int, kw string").withColumn("value", __import__("pyspark").sql.functions.lit("clash"))
    got = {}
    for r in split_packed(df, "id", "kw").orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["value"]))
    assert got[18] == [(1, "map"), (2, "a | b")]  # no quotes, yet the column knows the value
    assert got[0] == [(1, "a | b"), (2, "sort")] and got[22] == [(1, "sort"), (2, "sort")] and not {19, 20, 21} & set(got)
    assert split_packed(df.limit(0), "id", "kw").count() == 0
