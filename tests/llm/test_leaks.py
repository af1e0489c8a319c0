import random

import numpy as np
from corpusloom.llm.leaks import Index, leaks


def made(rng):
    known = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    return [[rng.choice(known) for _ in range(60)] for _ in range(3)], [rng.choice(known) for _ in range(400)]


ASKED = "Answer the question using only the passage that follows.\n"


def test_found():
    passage, other = made(random.Random(7))
    index = Index([(1, ASKED + " ".join(passage[0])), (2, ASKED + " ".join(passage[1])), (3, " ".join(passage[2])), (4, ASKED + " ".join(passage[1]))])
    text = lambda w: " ".join(other[:200] + w + other[200:])
    assert index.found(text(passage[0])) == [1] and index.found(text(passage[1])) == [2, 4]
    assert index.found(text(["&lt;b&gt;" + x.upper() + ",</b>" for x in passage[2]])) == [3]
    assert index.found(text(["x" if k % 10 == 5 else x for k, x in enumerate(passage[2])])) == [3]
    assert index.found(text(passage[2][:30] + other[50:62] + passage[2][30:])) == index.found(text(passage[2][20:45])) == [3]
    assert index.found(text(passage[2][:20])) == index.found(text(ASKED.split())) == index.found(None) == index.found("") == []


def test_search_loses_nothing():
    """Block-max WAND returns what scoring every item returns."""
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcdefghij") + rng.choice("kl") for _ in range(rng.randrange(3, 60)))) for k in range(80)]
    index = Index(items)
    terms = index.known.tolist()
    for _ in range(300):
        query = set(rng.sample(terms, rng.randrange(1, 60)))
        score = {}
        for t in query:
            for i, v in zip(*index.postings[t]):
                score[i] = score.get(i, 0) + v
        assert sorted(index.search(np.searchsorted(index.known, sorted(query)), list(range(len(index.block_least))))) == sorted(i for i, s in score.items() if s >= index.least[i])


def test_frames(spark):
    passage, other = made(random.Random(5))
    docs = spark.createDataFrame([(1, " ".join(passage[0]), 9), (1, " ".join(passage[0]), 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, " ".join(passage[0])), (8, None)], "item_id long, text string")
    assert sorted(map(tuple, leaks(docs, items).collect())) == [(1, 7), (1, 7)]
    assert leaks(docs, items.limit(0)).count() == 0 == leaks(docs.limit(0), items).count()
