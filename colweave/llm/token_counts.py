"""Exact token counts at every prefix of a text, by dynamic programming over BPE prefixes.

A byte-pair encoding is characterised by its adjacent pairs: a token sequence is the
encoding of its bytes exactly if every token and every adjacent pair of tokens is left
alone by the merges.  So the encoding of a prefix ends in exactly one token, and

    count[i] = count[i - len(t)] + 1

where t is the one token ending at i that is compatible with the last token of the
prefix before it.  One pass over a piece therefore gives the count of *every* prefix.
Pieces of the pre-tokeniser are independent of each other, and a text falls into chunks
(white space, then non-space) between which no piece reaches, so counts of chunks add up.
Both pieces and chunks repeat heavily in prose; per-process caches of bounded size keep
what was computed.

What is kept of a chunk, and stored for each document, is the *differences* between the
counts of neighbouring prefixes, by character: 16-bit integers that add up over chunks.  A
running sum of a document's differences is its count at every prefix, so its total, whether
it exceeds a limit, and the longest prefix within any budget all come from this one column
(``prefix_deltas``), without encoding again.

Defined results: a null text counts as the empty text (0 tokens); rows are never merged or
dropped, repeated rows repeat in the result; special strings in a text are one token each,
as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub
from struct import Struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

#: Entries that a worker keeps in its cache of chunks, of token pairs and of prefixes, before each starts afresh.
CHUNK_ENTRIES, PAIR_ENTRIES, PREFIX_ENTRIES = 600_000, 300_000, 400_000

#: Bytes of a piece from which its prefixes aren't kept for other pieces.
LONG_PIECE = 64

PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CHUNK = regex.compile(r"\s*\S+|\s+")
_BLANKS = regex.compile(r"\s*")
_PACK = Struct("<h").pack
_STEPS = {n: _PACK(n) for n in (-1, 0, 1)}
_ONE = _STEPS[1]
_CONTRACTION = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_COUNTERS: dict[str, PrefixCounter] = {}


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _unpack(deltas: bytes) -> array:
    """Differences as numbers."""
    out = array("h", deltas)
    if sys.byteorder == "big":
        out.byteswap()
    return out


def _differences(counts: list[int]) -> bytes:
    return b"".join(map(_PACK, map(sub, counts[1:], counts)))


class _Chunks(dict):
    """Differences of a chunk that follows one space, or begins with one line feed; computed on first use."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, rest: str) -> bytes:
        if len(self) >= CHUNK_ENTRIES:
            self.clear()
        if rest[-1:] in (".", ",") and rest[:-1].isalpha():
            d = self[rest[:-1]] + _ONE
        else:
            d = self.counter.chunk_deltas(rest if rest[:1] == "\n" else f" {rest}")
        self[rest] = d
        return d


class PrefixCounter:
    """Token counts under a byte-level BPE file (``.json`` of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        known = {as_bytes(s) for s in spec["model"]["vocab"] if all(c in alphabet for c in s)}
        self.rank: dict[bytes, int] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.pair_rank: dict[tuple[bytes, bytes], int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            if a + b in known:
                self.pair_rank[a, b] = n
                self.rank.setdefault(a + b, n)
                self.halves.setdefault(a + b, (a, b))
        for b in range(256):
            self.rank[bytes([b])] = -1
        #: every end of a token: the token if it is one itself
        self.tails = {t[i:]: None for t in self.rank for i in range(1, len(t))} | {t: t for t in self.rank}
        self.whole: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        #: of a prefix of a piece: its last token, its number of tokens, and the differences up to it
        self.prefixes: dict[bytes, tuple[bytes, int, bytes]] = {b"": (b"", 0, b"")}
        #: characters that chunks of plain pieces don't hold: those before which pieces can change while they grow
        self.unsure = frozenset("'" + "".join(x[0] for x in self.special))
        self.chunks = _Chunks(self)
        #: the last long piece and its counts: those of its beginnings are asked for as well
        self.long: tuple[bytes, list[int]] = (b"", [0])

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: lowest rank first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            n, i = min((self.pair_rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if n == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stands(self, token: bytes) -> bool:
        """Whether the token's bytes encode to that one token."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = len(token) == 1 or self.merged(token) == [token]
        return known

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether left and right stay apart when their bytes are encoded together."""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Undo the merges around the border, latest first; a pair that could merge before the undone one would have."""
        bound = 1 << 60
        last_left = False
        while True:
            n = self.pair_rank.get((a, b), 1 << 60)
            if n < bound or n == bound and last_left:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            # a merge on the right of the border loses a tie to one that starts further left
            if ra > rb:
                bound, last_left, a = ra, False, self.halves[a][1]
            else:
                bound, last_left, b = rb, True, self.halves[b][0]

    def prefix(self, piece: bytes) -> tuple[bytes, int, bytes]:
        """Last token, tokens and differences of a piece; on the way, of each of its prefixes that isn't known yet. Words that begin alike share them."""
        table, tails, pairs, n = self.prefixes, self.tails, self.pairs, len(piece)
        if len(table) >= PREFIX_ENTRIES:
            table.clear()
            table[b""] = (b"", 0, b"")
        i = n
        while piece[:i] not in table:
            i -= 1
        now = table[piece[:i]]
        for i in range(i + 1, n + 1):
            ends = []
            for j in range(i - 1, -1, -1):
                if (t := tails.get(piece[j:i], 0)) == 0:
                    break
                if t is not None:
                    ends.append((j, t))
            for j, t in reversed(ends):
                last, count, _ = table[piece[:j]]
                if j == 0:
                    ok = self.stands(t)
                elif (ok := pairs.get((last, t))) is None:
                    ok = self.fits(last, t)
                if ok:
                    step = count + 1 - now[1]
                    now = table[piece[:i]] = (t, count + 1, now[2] + (_STEPS[step] if -2 < step < 2 else _PACK(step)))
                    break
        return now

    def prefix_counts(self, piece: bytes) -> list[int]:
        """count[i] for i in 0..len(piece)."""
        if len(piece) > LONG_PIECE:
            return self._long(piece)
        return [0, *accumulate(_unpack(self.prefix(piece)[2]))]

    def _long(self, piece: bytes) -> list[int]:
        """prefix_counts of a piece too long to keep its prefixes by their bytes."""
        if self.long[0].startswith(piece):
            return self.long[1][: len(piece) + 1]
        last, count = [b""], [0]
        for i in range(1, len(piece) + 1):
            ends = []
            for j in range(i - 1, -1, -1):
                if (t := self.tails.get(piece[j:i], 0)) == 0:
                    break
                if t is not None:
                    ends.append((j, t))
            j, t = next((j, t) for j, t in reversed(ends) if (self.fits(last[j], t) if j else self.stands(t)))
            last.append(t)
            count.append(count[j] + 1)
        self.long = piece, count
        return count

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings; True marks those."""
        at = 0
        if self.special_at is not None and self.special[-1][:1] in text:
            for m in self.special_at.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def piece_deltas(self, piece: str) -> bytes:
        """Differences within one piece, by character."""
        data = piece.encode()
        if len(data) == len(piece) <= LONG_PIECE:
            return self.prefix(data)[2]
        return _differences(self._each_char(piece))

    def chunk_deltas(self, chunk: str) -> bytes:
        """Differences of a chunk's counts from one character to the next."""
        rest = chunk[1:]
        if rest.isalpha() and chunk[:1] == " ":  # one piece
            return self.piece_deltas(chunk)
        if self.unsure.isdisjoint(chunk) and not any(map(str.isspace, rest)):
            return b"".join(map(self.piece_deltas, PIECE.findall(chunk)))
        return _differences(self.by_char(chunk))

    def deltas(self, text: str) -> bytes:
        """Differences of the whole text."""
        if "  " not in text and "\n " not in text and " \n" not in text and "\n\n" not in text and text[:1] != " " and text.replace("\n", "").isprintable():
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.chunk_deltas(first) + b"".join(map(self.chunks.__getitem__, rest))
        return b"".join([self.chunks[c[1:]] if c[0] == " " and c[1:2] != "\n" else self.chunk_deltas(c) for c in CHUNK.findall(text)])

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return int(np.frombuffer(self.deltas(text), "<i2").sum(dtype=np.int64))

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        return longest_within(self.deltas(text), limit)

    def by_char(self, text: str) -> list[int]:
        """count[k]: tokens of text[:k] encoded by itself, for k in 0..len(text)."""
        out, base = [0], 0
        for part, special in self._segments(text):
            if special:
                for k in range(1, len(part)):  # the string isn't special until it's complete
                    out.append(base + self._plain(part[:k])[-1])
                base += 1
                out.append(base)
            else:
                inner = self._plain(part)
                out += [base + x for x in inner[1:]]
                base += inner[-1]
        # a piece of ordinary text before a half-finished special string can reach into it
        a = 0
        if self.special_at is not None:
            for m in self.special_at.finditer(text):
                head = out[a]
                for k in range(m.start() + 1, m.end()):
                    out[k] = head + self._plain(text[a:k])[-1]
                a = m.end()
        return out

    def _plain(self, text: str) -> list[int]:
        """by_char of a text without special strings."""
        out, base, run_end = [0], 0, 0
        for m in PIECE.finditer(text):
            p, start = m[0], m.start()
            blanks = _BLANKS.match(p).end()
            if blanks:
                if start >= run_end:
                    # a prefix that ends in white space takes the whole run as one piece: one pass counts all of these
                    run = _BLANKS.match(text, start)[0]
                    run_at, run_end, run_base = start, start + len(run), base
                    in_run = self._each_char(run)
                out += [run_base + n for n in in_run[start - run_at + 1 : start - run_at + blanks + 1]]
            own = self._each_char(p)
            if p in _CONTRACTION:  # while it's incomplete, the quote is a piece of its own
                out += [base + 1 + (own_part[-1] if k else 0) for k in range(len(p) - 1) for own_part in [self.prefix_counts(p[1 : k + 1].encode())]]
                out.append(base + own[-1])
            elif blanks < len(p):
                out += [base + n for n in own[blanks + 1 :]]
            base += own[-1]
        return out

    def _each_char(self, piece: str) -> list[int]:
        """prefix_counts by character."""
        data = piece.encode()
        counts = self.prefix_counts(data)
        if len(data) == len(piece):
            return counts
        return [counts[0], *(n for n, b in zip(counts[1:], [*data[1:], 0], strict=True) if b & 0xC0 != 0x80)]


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix within a budget of tokens, from stored differences; 0 if even the empty one isn't."""
    counts = np.cumsum(np.frombuffer(deltas, "<i2"), dtype=np.int64)
    fits = np.nonzero(counts <= budget)[0]
    return int(fits[-1]) + 1 if len(fits) else 0


def counter(path: str) -> PrefixCounter:
    """One counter for a file and process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within the limit), prefix_deltas.

    ``prefix_deltas`` holds 16-bit little-endian integers, one a character: its running sum is
    the count of every prefix, which ``prefix_tokens`` and ``longest_prefix`` read.  Rows are
    independent, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            deltas = [own.deltas(x.as_py()) for x in texts]
            tokens = [int(np.frombuffer(d, "<i2").sum(dtype=np.int64)) for d in deltas]
            fits = [len(d) // 2 if n <= limit else longest_within(d, limit) for d, n in zip(deltas, tokens, strict=True)]
            n_tokens = pa.array(tokens, pa.int64())
            cols = [b.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit), pa.array(fits, pa.int64()), pa.array(deltas, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_deltas"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint, prefix_deltas binary")


@F.pandas_udf(ArrayType(IntegerType()))
def prefix_tokens(deltas: pd.Series) -> pd.Series:
    """Counts at every prefix by character, from 0, of stored differences."""
    return deltas.map(lambda d: np.concatenate([[0], np.cumsum(np.frombuffer(d, "<i2"), dtype=np.int64)]).astype(np.int32))


@F.pandas_udf(LongType())
def longest_prefix(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix within ``budget``, from stored differences."""
    return pd.Series([longest_within(d, n) for d, n in zip(deltas, budget, strict=True)], dtype="int64")
