"""Language identification by cross-parsing against suffix automata.

Labelled text of each language is turned into a suffix automaton, which recognises exactly
the substrings of that text.  A text is parsed against it: the longest match is a phrase, the
next phrase starts after it.  With c phrases over n symbols and N symbols of training text,
c * log2(N) / n estimates the bits that a symbol costs in that language (cross-parsing
entropy); the language that needs fewest wins.

Texts are lower-cased and reduced to frequent letters, one symbol for rarer letters, and one
for each run of anything else.  The parse restarts every ``STRIP`` symbols, so that the strips
of all texts of a batch can step through one transition table side by side with array
operations; whole texts are parsed, and the time is linear in their length.

The automata are built from a bounded sample of labelled documents (``SAMPLE_SYMBOLS`` for
each language); the sample itself is what is sent to the executors.  Documents of up to
``SAMPLE_CHARS`` characters are drawn first, so that many of them fit; a language that has
longer ones only is learned from those, each cut to ``SAMPLE_SYMBOLS`` characters when it is drawn.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is
everything if no language was learned; ties go to the language first in the alphabet.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm.worker import kept

#: Most symbols of training text for each language, and most languages' worth of it in all.
SAMPLE_SYMBOLS, ALL_SYMBOLS = 40_000, 600_000
#: Labelled documents that the sample is drawn from: their number for each language, and characters of one where there are such.
SAMPLE_DOCS, SAMPLE_CHARS = 60, 4000
#: Letters with a symbol of their own.
LETTERS = 61
#: Symbols after which a parse restarts, and characters that are parsed side by side.
STRIP, BATCH = 1024, 4_000_000
#: Bits of a symbol that divide the score of a language by two, against the best one.
HALF = 0.25

_BREAK, _RARE = 0, 1


class Alphabet:
    """Code points to symbols: 0 between words, 1 rare letters, then the frequent letters."""

    def __init__(self, texts: list[str]):
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
        chosen = sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS]
        self.size = len(chosen) + 2
        self.table = np.fromiter((_RARE if chr(c).isalpha() else _BREAK for c in range(0x110000)), np.uint8, 0x110000)
        for n, c in enumerate(chosen):
            self.table[ord(c)] = n + 2

    def symbols(self, text: str) -> np.ndarray:
        s = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = s != _BREAK
        keep[1:] |= s[:-1] != _BREAK
        return s[keep]


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton: states x symbols, -1 where there is none."""
    # one flat array: a worker holds four bytes a transition, and no more while it builds
    blank = array("i", [-1]) * size
    go = array("i", blank)
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(link)
        go.extend(blank)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and go[p * size + c] < 0:
            go[p * size + c] = new
            p = link[p]
        if p >= 0:
            q = go[p * size + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                go.extend(go[q * size : (q + 1) * size])
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p * size + c] == q:
                    go[p * size + c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return np.frombuffer(go, np.int32).reshape(-1, size)


class Parser:
    """Cross-parses texts against all languages at once."""

    def __init__(self, sample: dict[str, list[str]]):
        self.languages = sorted(sample)
        self.alphabet = Alphabet([t for x in self.languages for t in sample[x]])
        bound = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(sample)))
        # one array that grows, so that no table is held twice
        table, self.base, self.bits, at = array("i"), [], [], 0
        for x in self.languages:
            s = np.concatenate([self.alphabet.symbols(f"\n{t}\n") for t in sample[x]])[:bound]
            go = automaton(s.tolist(), self.alphabet.size)
            self.bits.append(np.log2(max(2, len(s))))
            self.base.append(at)
            # entries are row starts in one table; a step that ends a phrase is negative: it already holds the next phrase's first state
            rows = go * np.int32(self.alphabet.size) + np.int32(at)
            first = np.where(go[0] >= 0, rows[0], np.int32(at))
            np.copyto(rows, -first[None, :], where=go < 0)
            rows[0] = -first
            table.frombytes(memoryview(rows).cast("B"))
            at += go.size
        self.table = np.frombuffer(table, np.int32) if table else np.zeros(0, np.int32)

    def _strips(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each strip in each language."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
        base = np.array(self.base, np.int32)[:, None]
        state = np.repeat(base, len(sizes), axis=1)
        count = np.zeros((len(base), len(sizes)), np.int32)
        for t, n in enumerate(active.tolist()):
            step = self.table[state[:, :n] + symbols[starts[:n] + t]]
            count[:, :n] += step <= 0
            np.abs(step, out=state[:, :n])
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def costs(self, texts: list[str | None]) -> np.ndarray:
        """Bits of a symbol, texts x languages; NaN for texts without a letter."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        if not self.languages:
            return out
        at = 0
        while at < len(texts):
            own, size = [], 0
            while at + len(own) < len(texts) and (not own or size + len(texts[at + len(own)] or "") <= BATCH):
                own.append(texts[at + len(own)] or "")
                size += len(own[-1])
            parts = [self.alphabet.symbols(t) for t in own]
            n = np.array([len(p) for p in parts], np.int64)
            lettered = np.array([bool((p != _BREAK).any()) for p in parts])
            strips = -(-n // STRIP)
            of = np.repeat(np.arange(len(own)), strips)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
            starts = np.repeat(np.cumsum(n) - n, strips) + inner * STRIP
            sizes = np.minimum(STRIP, np.repeat(n, strips) - inner * STRIP)
            if len(of):
                c = self._strips(np.concatenate(parts), starts, sizes)
                for k, bits in enumerate(self.bits):
                    total = np.bincount(of, c[k], len(own))
                    out[at : at + len(own), k] = np.where(lettered, total * bits / np.maximum(n, 1), np.nan)
            at += len(own)
        return out


def _parser(key: str, sample: dict[str, list[str]]) -> Parser:
    """One parser for a model and process; the last model is kept."""
    return kept(("languages", key), lambda: Parser(sample))


def learn_languages(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The bounded sample of labelled texts of each language, chosen by a hash of the text among rows that ``learn`` admits."""
    some = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "order", "doc_id"))
    keyed = some.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("doc_id"), (F.length(text_col) > SAMPLE_CHARS).alias("long"), F.xxhash64(text_col).alias("order"))
    chosen = keyed.withColumn("n", rank).where(F.col("n") <= SAMPLE_DOCS)
    # long texts of a language only if it hasn't a short one
    chosen = chosen.withColumn("some", F.min("long").over(Window.partitionBy("lang"))).where("long = some")
    texts = some.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("order"), F.substring(text_col, 1, SAMPLE_SYMBOLS).alias("text"))
    got = texts.join(F.broadcast(chosen.select("lang", "order").distinct()), ["lang", "order"]).groupBy("lang", "order").agg(F.min("text").alias("text")).orderBy("lang", "order").collect()
    sample: dict[str, list[str]] = {}
    for r in got:
        sample.setdefault(r.lang, []).append(r.text)
    return sample


def score_languages(docs: DataFrame, sample: dict[str, list[str]], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1), bits (of a symbol in that language); ``keep`` columns come along."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)  # bounded: SAMPLE_DOCS texts of bounded size for each language
    key = uuid.uuid4().hex  # workers outlive a model, and addresses come back
    sent = [id_col, text_col, *(k for k in keep if k not in (id_col, text_col))]  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _parser(key, shared.value)
        names = [*own.languages, "und"]
        for b in batches:
            cost = own.costs(b.column(1).to_pylist())
            known = ~np.isnan(cost).all(axis=1) if cost.shape[1] else np.zeros(b.num_rows, bool)
            filled = np.where(known[:, None], cost, 0.0)
            if cost.shape[1]:
                best = np.where(known, filled.argmin(axis=1), len(names) - 1)
                least = filled.min(axis=1)
                score = np.where(known, 1 / np.exp2((least[:, None] - filled) / HALF).sum(axis=1), 0.0)
            else:
                best, least, score = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] for k in best], pa.string()), pa.array(score), pa.array(least, mask=~known), *(b.column(sent.index(k)) for k in keep)], [id_col, "lang_pred", "score", "bits", *keep])

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*sent).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, bits double{more}")
