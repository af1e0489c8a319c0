import random

import numpy as np
from corpusloom.llm.overlap import FullText, classes, links, pairs, similarity, statements

A = """#include <map>
using namespace std;
// one
int main() { int total = 4; cout << "a" << total << endl; for (int i = 0; i < 9; ++i) { total += max(i, 3); } return 0; }"""
B = """int   main ( )  {  int n=12; std::cout << "other text" << n << '\\n';
for (int k = 1; k < 5; ++k) { n += std::max(k, 8); /* two */ } return 1; }"""


def test_normal_form():
    assert statements(A) == statements(B) and len(statements(A)) == 6 and statements(None) == statements("// x") == []
    assert statements(A.replace("+=", "-=")) != statements(A)
    assert statements('auto s = R"x(int a; " } )x"; int b;') == ["auto x = 0", "int x"]


def test_backward_search_is_exact():
    rng = random.Random(1)
    texts = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))], dtype=np.int64) for _ in range(60)]
    index = FullText(texts)
    flat = [(int(index.firsts[k]) + j, k, j) for k, t in enumerate(texts) for j in range(len(t))]
    for _ in range(200):
        pattern = [rng.randrange(6) for _ in range(rng.randrange(1, 5))]
        lo, hi = np.array([0]), np.array([index.n])
        for c in reversed(pattern):
            symbol = np.array([index.n_ends + int(np.searchsorted(index.symbols, c))])
            lo, hi = index._back(symbol, lo), index._back(symbol, hi)
        want = sorted(p for p, k, j in flat if texts[k][j : j + len(pattern)].tolist() == pattern)
        assert sorted(index.positions(np.arange(lo[0], hi[0])).tolist()) == want


def test_pairs_as_brute_force():
    rng = random.Random(8)
    texts = [np.array([rng.randrange(400) for _ in range(rng.randrange(1, 50))], dtype=np.int64) for _ in range(120)]
    queries = []
    for t in texts:
        q = t.tolist()
        for _ in range(rng.randrange(0, 1 + len(q) // 6)):
            k = rng.randrange(len(q))
            q[k : k + 1] = rng.choice(([], [rng.randrange(400)], [q[k], rng.randrange(400)]))
        queries.append(np.array(q or [1], dtype=np.int64))
    want = {(i, j) for i, q in enumerate(queries) for j, t in enumerate(texts) if similarity(q.tolist(), t.tolist(), 0.8) >= 0.8}
    got = {(i, j) for i, j, _ in FullText(texts).pairs(queries, 0.8)}
    assert got <= want and len(got) >= 0.97 * len(want) > 100
    assert {(i, j) for i, j, _ in FullText(texts).pairs(queries, 0.8, long_=1)} == want
    family = [np.array([*range(k), 1000 + k, *range(k + 1, 30)], dtype=np.int64) for k in range(30)]  # near copies of one program, so that every run is common
    assert len(FullText(family).pairs(family, 0.8)) == 900
    assert FullText([]).pairs(queries) == [] == FullText(texts).pairs([])


def test_frames(spark):
    rows = [(1, A, "train"), (2, B, "test"), (3, A, "train"), (4, None, "val"), (5, "", "test"), (6, "int x;", None), (7, A.replace("return 0;", "int z = 3; return 0;"), " VAL"), (8, "void f() { g(); }", "val")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "example_id long, code string, split string, class string")
    members, by = classes(df, "example_id", "code", "split")
    assert sorted(tuple(r) for r in pairs(members, links(by), "example_id").collect()) == [(1, 2), (1, 7), (3, 2), (3, 7)]
    for shard, slice_ in ((1, 1), (2, 3)):
        assert links(by, shard=shard, slice_=slice_).count() == 1
    members, by = classes(df.limit(0), "example_id", "code", "split")
    assert pairs(members, links(by), "example_id").count() == 0
