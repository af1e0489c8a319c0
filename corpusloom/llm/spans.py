"""Natural language in the comments and string literals of source files: queries p6_found, p6_shares and p6_spans."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.registry import LLM
from corpusloom.runtime import cut, kept, read

#: Comments and literals of each language; what is not closed goes to the end of its line, or of the file where lines do not end it.
CPP = re.compile(
    r'(?P<line>(?://(?:[^\n\\]|\\.|\\\n)*(?:\n[ \t]*(?=//))?)+)|/\*(?P<block>(?:.|\n)*?)(?:\*/|\Z)'
    r'|(?P<text>(?:(?:u8|[uUL])?(?:R"(?P<d>[^\s()\\]{0,16})\((?:.|\n)*?(?:\)(?P=d)"|\Z)|"(?:[^"\\\n]|\\(?:.|\n))*(?:"|$))\s*)+)|\'(?:[^\'\\\n]|\\.)*\'',
    re.M,
)
PYTHON = re.compile(
    r"(?P<line>(?:\#[^\n]*(?:\n[ \t]*(?=\#))?)+)|(?P<text>(?:(?:\b[rRbBuUfF]{1,2})?(?:\"\"\"(?:[^\\]|\\(?:.|\n))*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\(?:.|\n))*?(?:'''|\Z)"
    r"|\"(?:[^\"\\\n]|\\(?:.|\n))*(?:\"|$)|'(?:[^'\\\n]|\\(?:.|\n))*(?:'|$))[ \t]*(?:\n[ \t]*(?=[\"']))?)+)",
    re.M,
)
JSON = re.compile(r'(?P<text>"(?:[^"\\\n]|\\.)*(?:"|$))', re.M)
LEXERS = {"cpp": CPP, "python": PYTHON, "json": JSON}
ONE_TEXT = re.compile(r"""[A-Za-z0-9]{0,2}?(?:R"(?P<d>[^\s()\\]{0,16})\((?P<raw>(?:.|\n)*?)(?:\)(?P=d)"|\Z)|\"\"\"(?P<a>(?:[^\\]|\\(?:.|\n))*?)(?:\"\"\"|\Z)|'''(?P<b>(?:[^\\]|\\(?:.|\n))*?)(?:'''|\Z)|"(?P<c>(?:[^"\\\n]|\\(?:.|\n))*)"?|'(?P<e>(?:[^'\\\n]|\\(?:.|\n))*)'?)""")
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(\n)|(.))")
PLAIN = {"n": "\n", "t": "\t", "r": "\r"}
MARKS = re.compile(r"^[ \t]*(?:/{2,}[!<]?|\#+|\*+(?!/))[ \t]?", re.M)
FORMAT = re.compile(r"%[-+#0 ]*\d*(?:\.\d+)?[a-zA-Z]|\{[^{}\s]*\}|\$\{[^}]*\}|</?[A-Za-z][^<>\n]*>|https?://\S+|(?:\.{0,2}/)?[\w.-]+(?:/[\w.-]+)+")
#: Signs of code: operators, calls, and ends of statements; characters without one of which there are none, and words that begin a statement.
CODE = re.compile(r"[;{}]\s*$|[^\s=]\s*==|[-+*/%&|^!<>]=|->|::|&&|\|\||\+\+|--\w|\w\(|\w\[|\s=\s|^\s*[\w.]+\s*=\s*\S|<<|>>")
CODE_NEEDS = re.compile(r"[;{}=>&|+(\[<]|::|--")
STATEMENT = re.compile(r"\s*(?:import|from|def|#include|return|class|else|elif)\b[^.,]*$")
#: Characters without one of which FORMAT finds nothing.
FORMAT_NEEDS = re.compile(r"[%{</]")
VISIBLE, NUMBER = re.compile(r"\w"), re.compile(r"\W*\d[\d.,]*\W*")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
HAN = re.compile(r"[㐀-䶿一-鿿]")
#: Words of the least sentence, and characters where a language has no blanks (about two a word).
LEAST_WORDS, LEAST_HAN = 4, 8
#: Text from which the letter profiles are made, one for each language that shares its letters with others.
SEED = {
    "en": "The list is sorted before the search, so every value that is not found can be skipped. In most cases the result stays the same when the input is empty. "
    "This function returns the sum of all numbers and writes them to the next line. If there is no answer, we check whether the other rows were counted twice. "
    "They have been moved because of the weather, although nobody had expected it; what matters is how much they have in common with each other. "
    "Some people think that this would take more than three weeks, but about half of them were ready by the end of the year. Use a loop and keep the last element which was read. "
    "It should always be possible to start again without changing anything else. We need a short example that shows which of these steps comes first and why.",
    "de": "Die Liste wird vor der Suche sortiert, damit jeder Wert, der nicht gefunden wird, übersprungen werden kann. In den meisten Fällen bleibt das Ergebnis gleich, wenn die Eingabe leer ist. "
    "Diese Funktion gibt die Summe aller Zahlen zurück und schreibt sie in die nächste Zeile. Wenn es keine Antwort gibt, prüfen wir, ob die anderen Zeilen doppelt gezählt wurden. "
    "Sie sind wegen des Wetters verschoben worden, obwohl niemand damit gerechnet hatte; wichtig ist, wie viel sie miteinander gemeinsam haben. "
    "Manche Leute glauben, dass das mehr als drei Wochen dauern würde, aber etwa die Hälfte war am Ende des Jahres fertig. Benutze eine Schleife und behalte das letzte gelesene Element. "
    "Es sollte immer möglich sein, neu zu beginnen, ohne etwas anderes zu ändern. Wir brauchen ein kurzes Beispiel, das zeigt, welcher dieser Schritte zuerst kommt und warum.",
    "es": "La lista se ordena antes de la búsqueda para que cada valor que no se encuentra se pueda saltar. En la mayoría de los casos el resultado sigue igual cuando la entrada está vacía. "
    "Esta función devuelve la suma de todos los números y los escribe en la línea siguiente. Si no hay respuesta, comprobamos si las otras filas se contaron dos veces. "
    "Se han aplazado a causa del tiempo, aunque nadie lo había esperado; lo que importa es cuánto tienen en común los unos con los otros. "
    "Algunas personas creen que eso duraría más de tres semanas, pero casi la mitad estaba lista al final del año. Usa un bucle y guarda el último elemento leído. "
    "Siempre debería ser posible empezar de nuevo sin cambiar nada más. Necesitamos un ejemplo corto que muestre cuál de estos pasos viene primero y por qué.",
    "fr": "La liste est triée avant la recherche pour que chaque valeur qui n'est pas trouvée puisse être ignorée. Dans la plupart des cas le résultat reste le même quand l'entrée est vide. "
    "Cette fonction renvoie la somme de tous les nombres et les écrit à la ligne suivante. S'il n'y a pas de réponse, nous vérifions si les autres lignes ont été comptées deux fois. "
    "Elles ont été reportées à cause du temps, bien que personne ne s'y soit attendu ; ce qui compte, c'est ce qu'elles ont en commun les unes avec les autres. "
    "Certains pensent que cela durerait plus de trois semaines, mais environ la moitié était prête à la fin de l'année. Utilise une boucle et garde le dernier élément lu. "
    "Il devrait toujours être possible de recommencer sans rien changer d'autre. Nous avons besoin d'un court exemple qui montre laquelle de ces étapes vient d'abord et pourquoi.",
}
SCRIPTS = {"ru": re.compile(r"[Ѐ-ӿ]")}


class Profiles:
    """Letter runs of one to four in each language, as logarithms of smoothed shares; the likeliest language is that of a text.

    What is found out about a word is kept for the next time it comes; where MOST are kept, all are forgotten.
    """

    MOST = 50_000

    def __init__(self, seed: dict[str, str] = SEED) -> None:
        counts = {lang: Counter(x for w in self.words(text) for x in self.runs(w)) for lang, text in seed.items()}
        every = set().union(*counts.values())
        self.langs = list(counts)
        sums = [sum(c.values()) + 0.5 * len(every) for c in counts.values()]
        self.none = [-math.log(s / 0.5) for s in sums]
        self.shares = {x: [math.log((c[x] + 0.5) / s) for c, s in zip(counts.values(), sums)] for x in every}
        self.known: dict[str, tuple[float, ...]] = {}
        self.parts: dict[str, tuple[str | None, int, tuple[int, ...], bool]] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return WORD.findall(text.lower())

    @staticmethod
    def runs(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + k] for k in (1, 2, 3, 4) for i in range(len(w) - k + 1)]

    def scores(self, word: str) -> tuple[float, ...]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            shares, none = self.shares, self.none
            out = self.known[word] = tuple(map(sum, zip(*[shares.get(x, none) for x in self.runs(word)])))
        return out

    def language(self, words: list[str]) -> str:
        scores = list(map(sum, zip(*map(self.scores, words))))
        return self.langs[scores.index(max(scores))]

    def part(self, part: str) -> tuple[str | None, int, tuple[int, ...], bool]:
        """What stands between blanks: (the word in small letters or None, its letters, those of each of SCRIPTS, whether it counts as a word or a sign)."""
        out = self.parts.get(part)
        if out is None:
            if len(self.parts) >= self.MOST:
                self.parts.clear()
            w = part.strip("\"'“”«»‘’`()[]<>*_.,:;!?…-–—¿¡=#")
            word = w and WORD.fullmatch(w) and (w.islower() or w[1:].islower() or len(w) == 1 or (w.isupper() and len(w) < 6))
            counts = VISIBLE.search(part) is not None and not NUMBER.fullmatch(part)
            out = self.parts[part] = (w.lower(), len(w), tuple(len(x.findall(w)) for x in SCRIPTS.values()), counts) if word else (None, 0, (), counts)
        return out


def _decoded(literal: str) -> str:
    def one(m: re.Match) -> str:
        if m["raw"] is not None:
            return m["raw"]
        body = next((m[k] for k in ("a", "b", "c", "e") if m[k] is not None), "")
        if "\\" not in body:
            return body
        text = ESCAPE.sub(lambda x: chr(int(x[1] or x[3], 16)) if x[1] or x[3] else chr(int(x[2], 16)) if x[2] and int(x[2], 16) < 0x110000 else "" if x[4] else PLAIN.get(x[5] or "", x[5] or ""), body)
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return "".join(one(m) for m in ONE_TEXT.finditer(literal))


def guessed(code: str, lang: str | None) -> str | None:
    """The lexer for a file: that of its extension, unless the text plainly begins as another language does."""
    head = code.lstrip("﻿ \t\r\n")[:4000]
    if lang != "json" and head[:1] in "{[" and re.match(r'[\[{]\s*(?:"|\{|\[|\]|\})', head):
        return "json"
    if lang != "python" and re.search(r"^(?:def \w+\(.*\).*:|import \w+|from \w+ import |class \w+.*:)\s*$", head, re.M) and not re.search(r";\s*$", head, re.M):
        return "python"
    if lang != "cpp" and re.search(r"^\s*#include\s*[<\"]", head, re.M):
        return "cpp"
    return lang


def extract(code: str | None, lang: str | None) -> list[tuple[str, int]]:
    """(text, bytes in the file) of each comment and literal; comments on lines below each other and literals side by side are one."""
    if not code:
        return []
    lexer = LEXERS.get(guessed(code, lang) or "")
    if lexer is None:
        return []
    out = []
    for m in lexer.finditer(code):
        kind = m.lastgroup if m.lastgroup != "d" else "text"
        if m["text"] is not None:
            out.append((_decoded(m["text"]), len(m[0].encode("utf-8", "replace"))))
        elif kind is not None and m[kind] is not None:
            out.append((MARKS.sub("", m[kind]), len(m[0].encode("utf-8", "replace"))))
    return out


def sentence_language(text: str, profiles: Profiles) -> str | None:
    """The language of a line, or None if it is no sentence."""
    t = (FORMAT.sub(" ", text) if FORMAT_NEEDS.search(text) else text).strip()
    if not t.isascii():
        han = HAN.findall(t)
        if len(han) >= LEAST_HAN and len(han) >= 0.4 * len(re.sub(r"[\s\d\W]", "", t)):
            return "zh"
    if STATEMENT.match(t) or CODE_NEEDS.search(t) and CODE.search(t):
        return None
    parts = [profiles.part(p) for p in t.split()]
    words = [x for x in parts if x[0] is not None]
    if len(words) < LEAST_WORDS or len(words) < 0.6 * sum(x[3] for x in parts):
        return None
    letters = sum(x[1] for x in words)
    if letters < 3 * len(words) * 0.75:
        return None
    for k, lang in enumerate(SCRIPTS):
        if sum(x[2][k] for x in words) > 0.6 * letters:
            return lang
    return profiles.language([x[0] for x in words])


def languages(text: str | None, profiles: Profiles) -> list[tuple[str, float]]:
    """(language, share of the span's characters in its sentences). Lines are judged each; if none is a sentence, the whole span is."""
    t = html.unescape(text) if text and "&" in text else text or ""
    lines = [x for x in t.split("\n") if x.strip()]
    total = sum(map(len, lines)) or 1
    out: Counter[str] = Counter()
    for x in lines:
        if lang := sentence_language(x, profiles):
            out[lang] += len(x)
    if not out and len(lines) > 1 and (lang := sentence_language(" ".join(lines), profiles)):
        out[lang] = total
    return [(lang, n / total) for lang, n in out.items()]


def language_shares(files: DataFrame, key: str, code: str, lang: str) -> DataFrame:
    """(key, text_lang, n_spans, n_bytes, share) for each language with a sentence in a comment or literal of the file; share of the file's bytes.

    Spans are told apart by a 128-bit hash; each distinct one is classified once and its languages joined back. Spans that stand
    in very many files are joined under several salts. NULL and empty files, and languages without a lexer, give no row.
    """
    salts = 8

    @F.pandas_udf("array<struct<hash:string,n:bigint,text:string>>")
    def spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for codes, langs in batches:
            out = []
            for c, x in zip(codes, langs):
                held: dict[str, list] = {}
                for t, n in extract(c, x):
                    if len(t) < LEAST_HAN:
                        continue
                    h = hashlib.md5(t.encode("utf-8", "replace")).hexdigest()
                    if h in held:
                        held[h][1] += n
                    else:
                        held[h] = [h, n, t.encode("utf-8", "replace").decode()]
                out.append([{"hash": h, "n": n, "text": t} for h, n, t in held.values()])
            yield pd.Series(out, dtype=object)

    @F.pandas_udf("array<struct<text_lang:string,part:double>>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        profiles = kept("profiles", Profiles)
        for texts in batches:
            yield pd.Series([[{"text_lang": k, "part": v} for k, v in languages(t, profiles)] for t in texts], dtype=object)

    size = F.octet_length(code).alias("_size")
    found = cut(files.select(F.col(key).alias("_key"), size, F.explode(spans(code, lang)).alias("s")).select("_key", "_size", "s.*"))  # read twice, extracted once
    distinct = found.groupBy("hash").agg(F.first("text").alias("text"))
    labels = distinct.select("hash", F.inline(classify("text")))
    salted = labels.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = found.select("_key", "_size", "hash", "n", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int").alias("salt")).join(salted, ["hash", "salt"])
    by = joined.groupBy("_key", "text_lang").agg(F.count("*").alias("n_spans"), F.sum(F.round(F.col("n") * F.col("part"))).cast("bigint").alias("n_bytes"), F.first("_size").alias("_size"))
    return by.select(F.col("_key").alias(key), "text_lang", "n_spans", "n_bytes", (F.col("n_bytes") / F.col("_size")).alias("share"))


@LLM.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of the sentences in each file."""
    return language_shares(read(spark, sf_dir, "source_files"), "file_id", "code", "lang").select("file_id", "text_lang")


@LLM.query("p6_shares")
def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of comments and literals, their bytes and their share of the file."""
    return language_shares(read(spark, sf_dir, "source_files"), "file_id", "code", "lang")
