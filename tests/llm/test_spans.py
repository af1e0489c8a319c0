import re

import pytest
from corpusloom.llm.spans import SEED, Profiles, extract, language_shares, languages, sentence_language

P = Profiles()


def found(code, lang):
    return sorted({k for t, _ in extract(code, lang) for k, _ in languages(t, P)})


def test_lexers():
    assert found('int x; // this is one short sentence\nauto s = "вот ещё одно короткое предложение";', "cpp") == ["en", "ru"]
    assert found('/*\n * La lista se ordena antes\n * de la búsqueda.\n */ auto s = R"x(// keine Zeile ist hier zu viel)x"; int i = 1; // int k = i + 1;', "cpp") == ["de", "es"]
    assert found('def f():\n    """Cette boucle renvoie toujours la même valeur."""\n    return f"{x} is % s" # 计数器从不修改需要的大小\n', "python") == ["fr", "zh"]
    assert found('{"a": "the first of all the rows", "b": "\\u0412\\u043e\\u0442 \\u0435\\u0449\\u0451 \\u043e\\u0434\\u043d\\u0430 \\u0441\\u0442\\u0440\\u043e\\u043a\\u0430"}', "json") == ["en", "ru"]
    assert found("// the first part of a\n// sentence is here\nint x", "cpp") == found('const char* s = "the first part"\n  "of one long sentence";', "cpp") == ["en"]
    assert found("/* it is never closed at all", "cpp") == found('x = "it is never closed at all', "python") == ["en"]


def test_what_is_no_sentence():
    for x in ("int wage = frame + 1;", "for (auto total : crate) {", "src/main/data.csv ./a/b c/d e/f", "%d %s %d\n", "three short words", "<b> a </b>", "page = fee", "一二三", "if (a > b) return the value;"):
        assert not languages(x, P), x
    assert languages(None, P) == languages("", P) == [] == extract(None, "cpp") == extract("x", None) == extract("x", "rust")
    assert extract("x" * 2_000_000, "cpp") == [] and len(extract("// a\n\n" * 50_000, "cpp")) == 50_000


@pytest.mark.parametrize("lang", SEED)
def test_held_out_sentences(lang):
    """Each sentence of the seed is told by profiles made without it."""
    parts = re.findall(r"[^.]+\.", SEED[lang])
    right = sum(sentence_language(s, Profiles(SEED | {lang: SEED[lang].replace(s, "")})) == lang for s in parts)
    assert right >= len(parts) - 1


def test_frames(spark):
    rows = [(1, "// this is one short sentence", "cpp", 5), (2, "// this is one short sentence", "cpp", 5), (3, None, "cpp", 5), (4, "", None, 5)]
    df = spark.createDataFrame(rows, "file_id long, code string, lang string, n int")
    got = [tuple(r) for r in language_shares(df, "file_id", "code", "lang").orderBy("file_id").collect()]
    assert got == [(1, "en", 1, 29, 1.0), (2, "en", 1, 29, 1.0)] and language_shares(df.limit(0), "file_id", "code", "lang").count() == 0


def test_a_word_is_scored_once():
    """Its letter runs are looked up when it first comes, and again only after it was forgotten; the language is that of all runs of all words."""
    looked = []

    class Counted(Profiles):
        @staticmethod
        def runs(word):
            looked.append(word)
            return Profiles.runs(word)

    sentences = [re.sub(r"[.;]", "", s).split() for text in SEED.values() for s in text.split(". ")]
    for most in (50_000, 7):
        p = Counted()
        p.MOST, start = most, len(looked)
        for _ in range(3):
            for s in sentences:
                words = Profiles.words(" ".join(s))
                every = [sum(p.shares.get(x, p.none)[k] for w in words for x in Profiles.runs(w)) for k in range(len(p.langs))]
                assert p.language(words) == p.langs[every.index(max(every))]
        if most == 50_000:
            assert sorted(looked[start:]) == sorted({w for s in sentences for w in Profiles.words(" ".join(s))})
        assert len(p.known) <= most
    text = "The list is sorted before the search. " * 50
    assert languages(text, p) == languages(text, P) == [("en", 1.0)]
