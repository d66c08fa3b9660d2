"""Tokens of many texts at once: runs of bytes found and hashed with array operations.

A text's bytes fall into letters (A-Z, a-z and all non-ASCII bytes), digits, white space and
signs.  A token is a run of letters, a run of digits, or a run of one and the same sign.
Its hash is a polynomial over lower-cased bytes, modulo 2**64, taken from one running sum.
Texts are handled in windows of bounded size; a longer text is cut at white space, so that
memory doesn't follow the longest text, and each of its windows can begin with the last
tokens of the one before, so that nothing that spans a few tokens is lost at a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from colweave.llm.worker import kept

#: Bytes of a window.
WINDOW = 1 << 20

SPACE, LETTER, DIGIT, SIGN = 0, 1, 2, 3
_CLASS = np.full(256, SIGN, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = LETTER
_CLASS[128:] = LETTER
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    found: list[np.ndarray] = kept(("powers",), list)
    if not found or len(found[0]) < n:
        size = max(n, min(1 << n.bit_length(), WINDOW + 1))  # few for short texts alone, as on the driver
        for k, x in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, x, np.uint64)
            factors[0] = 1
            found[k : k + 1] = [np.cumprod(factors, out=factors)]
    return found[0], found[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Tokens:
    """Tokens of a window: starts, lengths, doc (index of the text), kind, hash, upper (A-Z in the token).

    The first ``again`` tokens were in the window before; ``words_before`` tokens other than
    signs lie before the window in its text.
    """

    def __init__(self, data: np.ndarray, doc_of_start: np.ndarray, docs: np.ndarray, again: int = 0, words_before: int = 0):
        self.data, self.again, self.words_before = data, again, words_before
        kind = _CLASS[data]
        fresh = np.ones(len(data), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == SIGN) & (data[1:] != data[:-1]))
        fresh[doc_of_start[doc_of_start < len(data)]] = True
        at = np.nonzero(fresh)[0]
        end = np.append(at[1:], len(data))
        kept = kind[at] != SPACE
        self.at, self.end = at[kept], end[kept]
        self.kind = kind[self.at]
        self.doc = docs[np.searchsorted(doc_of_start, self.at, side="right") - 1]
        power, inverse = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWER[data] * power[: len(data)], out=self._sum[1:])
        self._inverse = inverse
        self.hash = self.hash_of(self.end)
        upper = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
        self.upper = upper[self.end] - upper[self.at]
        self.first_upper = (data[self.at] >= 65) & (data[self.at] <= 90)

    def hash_of(self, end: np.ndarray) -> np.ndarray:
        """Hash of each token's bytes up to ``end``."""
        return mix((self._sum[end] - self._sum[self.at]) * self._inverse[self.at] + (end - self.at).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.at)


def _long(data: bytes, n: int, overlap: int, words: bool) -> Iterator[Tokens]:
    """Windows of one long text."""
    at = again = before = 0
    while True:
        end = len(data)
        if end - at > WINDOW:
            cut = max(data.rfind(b" ", at, at + WINDOW), data.rfind(b"\n", at, at + WINDOW)) + 1
            end = cut if cut > at + WINDOW // 2 else at + WINDOW
        t = Tokens(np.frombuffer(data, np.uint8, end - at, at), np.zeros(1, np.int64), np.array([n], np.int64), again, before)
        yield t
        if end == len(data):
            return
        counted = np.nonzero(t.kind != SIGN)[0] if words else np.arange(len(t))
        first = int(counted[max(0, len(counted) - overlap)]) if overlap and len(counted) else len(t)
        if first < len(t) and t.at[first] <= (end - at) // 2:
            first = len(t)  # tokens as long as half a window: no window may be all repetition
        before += int((t.kind[:first] != SIGN).sum())
        again = len(t) - first
        at = at + int(t.at[first]) if again else end


def windows(texts: list[str | None], overlap: int = 0, words: bool = False) -> Iterator[Tokens]:
    """Tokens of all texts, window by window; ``doc`` counts texts from 0.

    Windows of a text that has several begin with the last ``overlap`` tokens (with ``words``,
    tokens other than signs) of the one before.
    """
    held: list[bytes] = []
    docs: list[int] = []
    size = 0

    def done() -> Tokens:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])[:-1].astype(np.int64)
        return Tokens(np.frombuffer(b"".join(held), np.uint8), starts, np.array(docs, np.int64))

    for n, text in enumerate(texts):
        data = (text or "").encode()
        if not data:
            continue
        if held and size + len(data) > WINDOW:
            yield done()
            held, docs, size = [], [], 0
        if len(data) > WINDOW:
            yield from _long(data, n, overlap, words)
            continue
        held.append(data)
        docs.append(n)
        size += len(data)
    if held:
        yield done()
