"""Values packed in one string: how it is cut into pieces, and which pieces belong together."""

from __future__ import annotations

import math
from typing import NamedTuple

SEPARATORS = frozenset(",;|\t\n\r，；｜、")
ENCLOSED = {"[": "]", "{": "}"}


class Piece(NamedTuple):
    start: int
    end: int
    value: str
    protected: bool


def pieces(packed: str | None) -> tuple[str, list[Piece]]:
    """The text between its outer brackets and its pieces between separators, empty ones too.

    A separator does not count inside quotes that open a piece or behind a backslash; such marks are left out of the value.
    A slash separates only between blanks.
    """
    s = (packed or "").strip()
    if len(s) > 1 and ENCLOSED.get(s[0]) == s[-1]:
        s = s[1:-1]
    found: list[Piece] = []
    piece: list[str] = []
    held = 0  # characters of the piece up to here are protected, so blanks among them stay
    start, guarded = 0, False

    def close(end: int, after: int) -> None:
        nonlocal held, start, guarded
        kept, rest = "".join(piece[:held]), "".join(piece[held:])
        found.append(Piece(start, end, kept + rest.rstrip() if held else rest.strip(), guarded))
        piece.clear()
        held, start, guarded = 0, after, False

    i, n = 0, len(s)
    while i < n:
        ch = s[i]
        if ch in "\"'" and not held and not "".join(piece).strip():
            j, inner = i + 1, []
            while j < n:
                if s[j] == "\\" and j + 1 < n:
                    inner.append(s[j + 1])
                    j += 2
                elif s[j] == ch and s[j + 1 : j + 2] == ch:
                    if not inner and (j + 2 >= n or s[j + 2 :].lstrip(" ")[:1] in SEPARATORS):
                        break
                    inner.append(ch)
                    j += 2
                elif s[j] == ch:
                    break
                else:
                    inner.append(s[j])
                    j += 1
            after = s[j + 1 :].lstrip(" ")[:1] if j < n else None
            if after is not None and (after == "" or after in SEPARATORS or after == "/"):
                piece[:] = "".join(inner).strip()
                held, guarded = len(piece), True
                i = j + 1
                continue
        if ch == "\\" and i + 1 < n:
            if not held:
                piece[:] = "".join(piece).lstrip()
            piece.append(s[i + 1])
            held, guarded = len(piece), True
            i += 2
        elif ch in SEPARATORS or (ch == "/" and (i == 0 or s[i - 1].isspace()) and (i + 1 == n or s[i + 1].isspace())):
            close(i, i + 1)
            i += 1
        else:
            piece.append(ch)
            i += 1
    close(n, n)
    return s, found


def lattice(packed: str | None, span: int) -> list[tuple[int, int, str, bool]]:
    """The edges (from, to, value, plain) over the piece boundaries: every piece alone, and every run of up to `span` pieces
    without quotes or escapes read as one value with its separators."""
    s, parts = pieces(packed)
    edges = []
    for i, p in enumerate(parts):
        edges.append((i, i + 1, p.value, True))
        if p.value and not p.protected:
            for j in range(i + 1, min(len(parts), i + span)):
                if parts[j].protected:
                    break
                if parts[j].value:
                    edges.append((i, j + 1, s[p.start : parts[j].end].strip(), False))
    return edges


def plain(packed: str | None) -> list[str]:
    """Every piece that is not empty, in order."""
    return [p.value for p in pieces(packed)[1] if p.value]


Edge = tuple[int, int, str, float]
#: The log likelihood of a piece that is nowhere a value by itself; an empty piece costs nothing.
UNSEEN = -40.0


def _score(value: str, likelihood: float) -> float:
    return 0.0 if not value else math.log(likelihood) if likelihood > 0 else UNSEEN


def expected(edges: list[Edge]) -> list[tuple[str, float]]:
    """How often each value stands in the string, over all its readings, by forward and backward sums. edges: (from, to, value, likelihood)."""
    last = max(e[1] for e in edges)
    ahead, behind = [-math.inf] * (last + 1), [-math.inf] * (last + 1)
    ahead[0] = behind[last] = 0.0
    add = lambda x, y: y if x == -math.inf else x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
    for i, j, v, p in sorted(edges):
        ahead[j] = add(ahead[j], ahead[i] + _score(v, p))
    for i, j, v, p in sorted(edges, key=lambda e: -e[1]):
        behind[i] = add(behind[i], behind[j] + _score(v, p))
    return [(v, math.exp(ahead[i] + _score(v, p) + behind[j] - ahead[last])) for i, j, v, p in edges if v]


def best(edges: list[Edge]) -> list[str]:
    """The values of the likeliest reading; of equal ones the one with the shorter first piece."""
    last = max(e[1] for e in edges)
    top: list[tuple[float, Edge | None]] = [(-math.inf, None)] * (last + 1)
    top[0] = (0.0, None)
    for e in sorted(edges):
        score = top[e[0]][0] + _score(e[2], e[3])
        if score > top[e[1]][0]:
            top[e[1]] = (score, e)
    out, at = [], last
    while at:
        e = top[at][1]
        assert e
        out.append(e[2])
        at = e[0]
    return [v for v in reversed(out) if v]
