import random

from corpusloom.llm.subjects import PLACE, SECTION, THING, Votes, learn, sentences, subject_shares

LAW, SPORT = "Here the defendants and the witnesses wait for some time.", "The referees count all of the penalty kicks again."
NONE = "Use a loop and keep the result in an array."


def test_sentences():
    text = f"# The court of law\n\n- {LAW}\n- {SPORT} {NONE}\n\n```cpp\n#include <map>\nint main() {{\n    // {LAW}\n    std::cout << \"{SPORT}\";\n}}\n```\n/*\n * {NONE}\n */\n> quoted lines that go on\n> to the next one. No.\n"
    got = sentences(text)
    assert [x for x, _, _ in got] == [x.lower() for x in (LAW, SPORT, NONE, LAW, NONE, "quoted lines that go on to the next one.")]
    assert got[0][1] == "the court of law" and sentences(None) == sentences("") == sentences("int x = 3;") == []
    assert sentences(f"<p>{LAW}</p>\\n&lt;p&gt;{SPORT}&lt;/p&gt;")[1][0] == SPORT.lower() and len(sentences((NONE + " ") * 30_000)) == 30_000


def test_votes():
    v = Votes({"law": "witness, witnesses, depots@de", "sport": "witnessing"}, {"law": "under oath"})
    n, c = v.patterns("The witness spoke under oath today. The eyewitnesses saw it happen again. Wie groß sind die Depots heute. How large are the depots now.")
    assert (n, c) == (4, {("law", THING | PLACE): 1, ("law", THING): 1})
    assert v.patterns("# law\n\nOne two three four.")[1] == {("law", SECTION): 1}


def test_accuracies_are_learnt():
    """Posteriors of votes drawn with known accuracies come out as those accuracies say."""
    rng = random.Random(1)
    counts: dict = {}
    for _ in range(40_000):
        y = rng.random() < 0.3
        p = sum((rng.random() < (h if y else a)) << k for k, (h, a) in enumerate(((0.8, 0.02), (0.5, 0.05), (0.3, 0.01))))
        counts["x", p] = counts.get(("x", p), 0) + 1
    post = learn(counts, 200)
    assert post["x", 0] < 0.15 and post["x", 1] > 0.85 and post["x", 2] > 0.3 and post["x", 3] > 0.99


def test_frames(spark):
    text = " ".join([LAW] * 3 + [NONE] * 5 + [SPORT])
    rows = [(k, text, "a", "clash") for k in range(20)] + [(90, None, "a", "x"), (91, "", None, "x"), (92, NONE, None, "x"), (5, text, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, subject string")
    got = sorted((r["doc_id"], r["subject"], r["n_about"], r["n_sentences"]) for r in subject_shares(df).collect())
    assert got == sorted((k, s, n, 9) for k in [*range(20), 5] for s, n in (("law", 3), ("sport", 1)))
    assert subject_shares(df.limit(0)).count() == 0
