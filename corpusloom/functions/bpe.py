"""Byte-pair encoding over a byte-level vocabulary: encode, greedy encode, decode, and one training step on sequences."""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Pieces whose ids a worker keeps.
KEPT = 200_000
UNK = 1


def byte_token(b: int) -> str:
    """The character that stands for a byte in the vocabulary."""
    return chr(b) if b in (9, 10, 13) or 32 <= b <= 126 or b >= 161 else chr(0xE000 + b)


BYTES = {byte_token(b): b for b in range(256)}


class Encoder:
    """Lowest rank first, all occurrences from left to right, over whole texts: one way at every vocabulary size.

    Each token is one character, bytes being U+0000-U+00FF, so a merge is a replacement in one string. When a merge
    makes an operand of an earlier one, the earlier one comes next. Texts are cut between bytes that no token holds
    side by side, as no merge can reach over such a place. Tokens that the vocabulary lacks have the id of <UNK>.
    """

    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int]) -> None:
        as_char = {byte_token(b): chr(b) for b in range(256)}
        self.joint, free = chr(0x100), iter(c for c in range(0x101, 0x110000) if not 0xD800 <= c < 0xE000)
        self.cuts = np.ones(1 << 16, dtype=bool)
        for token in dict.fromkeys(x + y for x, y in merges):
            as_char[token] = chr(next(free))
            held = [BYTES[c] for c in token]
            for x, y in zip(held, held[1:]):
                self.cuts[x << 8 | y] = False
        usable = [(x, y) for x, y in merges if x in as_char and y in as_char]
        self.steps = [(as_char[x] + as_char[y], as_char[x + y]) for x, y in usable]
        first: dict[str, int] = {}
        for k, (x, y) in enumerate(usable):
            first.setdefault(x, k)
            first.setdefault(y, k)
        self.again = [first.get(x + y, len(usable)) for x, y in usable]
        self.token = {c: t for t, c in as_char.items()}
        self.id = {c: ids.get(t, UNK) for t, c in as_char.items()}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _merge(self, pieces: list[bytes]) -> list[str]:
        s = self.joint.join(x.decode("latin-1") for x in pieces)
        k = 0
        while k < len(self.steps):
            pair, token = self.steps[k]
            if pair in s:
                s = s.replace(pair, token)
                k = min(k + 1, self.again[k])
            else:
                k += 1
        return s.split(self.joint)

    def _pieces(self, text: bytes) -> list[bytes]:
        a = np.frombuffer(text, dtype=np.uint8).astype(np.uint16)
        at = (np.flatnonzero(self.cuts[a[:-1] << 8 | a[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """The ids of each text; NULL stays NULL."""
        cut = [None if x is None else self._pieces(x.encode("utf-8", "replace")) if x else [] for x in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = list({p for c in cut if c for p in c if p not in self.known})
        get = self.id.__getitem__
        if new:
            self.known.update(zip(new, (tuple(map(get, s)) for s in self._merge(new))))
        return [None if c is None else list(chain.from_iterable(map(self.known.__getitem__, c))) for c in cut]


class Decoder:
    """Ids to text: special and unknown ids are left out, bytes that are no UTF-8 dropped."""

    def __init__(self, tokens: dict[int, str], special: int = 4) -> None:
        self.bytes = {i: bytes(BYTES[c] for c in t) for i, t in tokens.items() if i >= special and all(c in BYTES for c in t)}

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "ignore")


def greedy(symbols: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """A stack whose two top ids are merged as long as there is a rule for them, whatever its rank."""
    out: list[int] = []
    for s in symbols:
        out.append(s)
        while len(out) > 1 and (m := rules.get((out[-2], out[-1]))) is not None:
            out[-2:] = [m]
    return out
