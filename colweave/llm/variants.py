"""Spelling variants of words, by an Aho-Corasick automaton of word halves.

A word that differs from another by one code point keeps one of that one's halves whole: the
first half at its start, or the second at its end.  The halves of all words are held by
automaton shards, one for each length of a word and each ``SHARD`` words of it.  Every word is
scanned by the shards of its own length and of the next one; a half that ends where its offset
and the two lengths demand gives a candidate, and the distance decides.  Shards and the words
that they scan are both dealt in bounded blocks, so no task holds all words of a length.

Words are counted first: tasks count what they have read and emit a word once for many
occurrences, and the sums meet by word.

Defined results: a null text has no runs; a null id is written as nothing before the colon;
repeated rows count each time; ties of form go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.simhash import LOWER
from colweave.llm.store import settle

#: Words of a shard, and words that a task scans with it; words that a task counts before it emits them; bytes of text taken together.
SHARD, COUNTED, BYTES = 20_000, 500_000, 1 << 22
#: Letters of a run.
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _runs(text: str) -> Iterator[list[str]]:
    """Lower-cased (A-Z) runs, in lists from slices of bounded size that end between runs."""
    low = text.encode().translate(LOWER).decode()
    at = 0
    while at < len(low):
        end = min(len(low), at + BYTES)
        if end < len(low) and (rest := RUN.match(low, end)):
            end = rest.end()
        yield RUN.findall(low, at, end)
        at = end


def without(run: str, crc: int) -> str:
    """The run without the code point that crc names."""
    k = crc % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, *, every: int = 199, least_letters: int = 6, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least ``least_letters`` code points and ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rows

        for b in batches:
            for d, t in zip(*b.columns, strict=True):
                start = zlib.crc32(f"{'' if d.as_py() is None else d.as_py()}:".encode())
                for found in _runs(t.as_py()):
                    for word, n in Counter(found).items():
                        if len(word) >= least_letters:
                            crc = zlib.crc32(word.encode(), start)
                            if crc % every == 0:
                                word = without(word, crc)
                                if len(word) < least_letters:
                                    continue
                            counts[word] = counts.get(word, 0) + n
                    if len(counts) > COUNTED:
                        yield out()
        if counts:
            yield out()

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced; ``b`` isn't shorter than ``a`` by more, nor longer."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Halves:
    """An automaton over both halves of words of one length.

    The half that is not whole has its edit in one of its own two parts, and the other part is
    whole: the words of a half are filed under each of these parts as well, so that what is left
    for the distance to decide shares three quarters with the word.
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.size = len(words[0]) if words else 0
        self.half = self.size // 2
        #: ends of the first and the third quarter
        self.cuts = self.half // 2, self.half + (self.size - self.half) // 2
        self.left: dict[tuple[str, int, str], list[int]] = {}
        self.right: dict[tuple[str, int, str], list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        one, three = self.cuts
        for k, w in enumerate(words):
            first, second = w[: self.half], w[self.half :]
            for files, half, parts in ((self.left, first, (w[self.half : three], w[three:])), (self.right, second, (w[:one], w[one : self.half]))):
                for n, part in enumerate(parts):
                    files.setdefault((half, n, part), []).append(k)
            self.automaton.add_word(first, first)
            self.automaton.add_word(second, second)
        if words:
            self.automaton.make_automaton()

    def near(self, word: str) -> set[int]:
        """Places of the words at distance one, for a word that is as long or shorter by one."""
        found: set[int] = set()
        if not self.words:
            return found
        one, three = self.cuts
        n, tail = len(word), self.size - self.half
        asked: set[int] = set()
        for end, half in self.automaton.iter(word):
            if end + 1 == self.half == len(half):  # a first half at its own offset
                asked.update(self.left.get((half, 0, word[self.half : three]), ()), self.left.get((half, 1, word[n - self.size + three :]), ()))
            if end + 1 == n and len(half) == tail:  # a second half, its offset moved by the difference of lengths
                asked.update(self.right.get((half, 0, word[:one]), ()), self.right.get((half, 1, word[n - self.size + one : n - tail]), ()))
        words = self.words
        found.update(k for k in asked if one_apart(word, words[k]))
        return found


def near_words(words: DataFrame) -> DataFrame:
    """word, other, n_word, n_other: each pair (one way) of words (word, n) at distance one."""
    sized = words.select("word", "n", F.length("word").alias("size"))
    # a row for each length that words have
    blocks = settle(sized.groupBy("size").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks")), "lengths")
    counted = lambda of, name: blocks.select(F.col("size").alias(of), F.col("blocks").alias(name))
    dealt = lambda seed, into: F.pmod(F.xxhash64("word", F.lit(seed)), into).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # every block of words of a length meets every shard of that length and of the next one
    scanned = sized.join(counted("size", "parts"), "size").select("word", "n", "size", dealt(1, "parts").alias("part"), F.explode(F.array("size", F.col("size") + 1)).alias("of"))
    scanned = scanned.join(counted("of", "shards"), "of").select("of", "size", copies("shards").alias("shard"), "part", F.col("word").alias("asked"), F.col("n").alias("n_asked"))
    held = sized.join(counted("size", "shards"), "size").select("word", "n", F.col("size").alias("of"), dealt(2, "shards").alias("shard"), F.explode(F.array("size", F.col("size") - 1)).alias("size"))
    held = held.join(counted("size", "parts"), "size").select("of", "size", "shard", copies("parts").alias("part"), "word", "n")

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["word", "other", "n_word", "n_other"]
        words, ns = left["word"].to_pylist(), left["n"].to_pylist()
        shard = Halves(words)
        rows = [(w, words[k], n, ns[k]) for w, n in zip(right["asked"].to_pylist(), right["n_asked"].to_pylist(), strict=True) for k in shard.near(w) if len(w) < len(words[k]) or w < words[k]]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)

    keys = ["of", "size", "shard", "part"]
    return held.groupBy(*keys).cogroup(scanned.groupBy(*keys)).applyInArrow(meet, "word string, other string, n_word bigint, n_other bigint")


def variants(docs: DataFrame, *, every: int = 199, least_letters: int = 6, least: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word.

    ``form`` is the most frequent word at distance one, if it occurs at least ``ratio`` times as
    often; ``root`` is where forms lead to.  Counts rise by ``ratio`` with every step, so ways
    are short: pointers are doubled until none moves.
    """
    words = settle(word_counts(docs, every=every, least_letters=least_letters, least=least, id_col=id_col, text_col=text_col), "words")
    pairs = settle(near_words(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n_other").alias("n_word"), F.col("n_word").alias("n_other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("neg"), "other")).alias("b"))
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.neg") >= ratio * F.col("n"), F.col("b.other")).alias("form"), F.when(-F.col("b.neg") >= ratio * F.col("n"), -F.col("b.neg")).alias("form_n"))
    formed = settle(formed, "forms")
    way = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(way.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        way = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
