"""Spelling variants: words at one edit from each other, each led to its commonest form.

Pairs come from a finite-state composition: the minimised acceptor of a vocabulary, a transducer that makes one edit, and
the acceptor again. Both acceptors start together; the edit stands where the two words first differ, so every pair has one
path. Initial states are spread over partitions: an initial state stands for what a pair shares before and behind the
part that may differ. Two words with an edit in the second half of the shorter share its first half, others share the rest, so a word
has two initial states for each length of the shorter. Those of too many words are halved again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
#: Initial states of more words are divided, unless at most one letter of the shorter word is free, which bounds them.
LARGEST = 20_000
#: Words whose acceptor is in memory at once, at least.
CHUNK = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """A minimised acyclic acceptor. Each call of add() gives an initial state; equal right languages share a state."""

    def __init__(self) -> None:
        self.final: list[bool] = []
        self.arcs: list[tuple[tuple[str, int], ...]] = []
        self.shortest: list[int] = []
        self.longest: list[int] = []
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int, int], list[str]] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(tuple(arcs))
            self.shortest.append(0 if final else 1 + min((self.shortest[t] for _, t in arcs), default=0))
            self.longest.append(1 + max((self.longest[t] for _, t in arcs), default=-1))
        return state

    def add(self, words: Iterable[str]) -> int:
        """The initial state that accepts these words, which ascend and are distinct."""
        path: list[list] = [[False, []]]
        before = ""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                final, arcs = path.pop()
                path[-1][1].append((before[len(path) - 1], self._state(final, arcs)))

        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            before = word
        close(0)
        return self._state(*path[0])

    def common(self, a: int, b: int, n: int) -> list[str]:
        """Strings of n letters that both states accept."""
        if not (self.shortest[a] <= n <= self.longest[a] and self.shortest[b] <= n <= self.longest[b]):
            return []
        if n == 0:
            return [""]
        key = (a, b, n) if a < b else (b, a, n)
        found = self._common.get(key)
        if found is None:
            found = self._common[key] = list(self._both(a, b, n))
        return found

    def _both(self, a: int, b: int, n: int) -> Iterator[str]:
        path: list[str] = []
        stack: list[tuple[int, int, int, str]] = [(a, b, 0, "")]
        shortest, longest, arcs = self.shortest, self.longest, self.arcs
        while stack:
            a, b, depth, letter = stack.pop()
            left = n - depth
            if not (shortest[a] <= left <= longest[a] and shortest[b] <= left <= longest[b]):
                continue
            if depth:
                del path[depth - 1 :]
                path.append(letter)
            if not left:
                if self.final[a] and self.final[b]:
                    yield "".join(path)
                continue
            other = dict(arcs[b])
            stack.extend((t, other[c], depth + 1, c) for c, t in arcs[a] if c in other)

    def near(self, start: int, n: int, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs at one edit from each other that ``start`` accepts, the first of n letters, the second of n or n + 1.

        With ``at_end`` the added letter may be the last. Nothing is edited before the pair's first difference: up to it
        both acceptors are in one state.
        """
        path: list[str] = []
        stack: list[tuple[int, int, str]] = [(start, 0, "")]
        while stack:
            state, depth, letter = stack.pop()
            if depth:
                del path[depth - 1 :]
                path.append(letter)
            arcs, left = self.arcs[state], n - depth
            if left > 0:
                if len(arcs) > 1:
                    for (x, s), (y, t) in combinations(arcs, 2):
                        if rest := self.common(s, t, left - 1):
                            head = "".join(path)
                            yield from ((head + x + r, head + y + r) for r in rest)
                    for y, t in arcs:
                        if rest := self.common(state, t, left):
                            head = "".join(path)
                            yield from ((head + r, head + y + r) for r in rest if r[0] != y)
                stack.extend((t, depth + 1, c) for c, t in arcs)
            elif at_end and self.final[state]:
                head = "".join(path)
                yield from ((head, head + y) for y, t in arcs if self.final[t])


class _Chunk:
    """Initial states whose words share an acceptor, and what each word's pairs amount to."""

    def __init__(self) -> None:
        self.acceptor = Acceptor()
        self.words = 0
        #: word: [near words, minus the largest n, its word]
        self.best: dict[str, list] = {}

    def _note(self, word: str, other: str, n: int) -> None:
        held = self.best.get(word)
        if held is None:
            self.best[word] = [1, -n, other]
        else:
            held[0] += 1
            if (-n, other) < (held[1], held[2]):
                held[1:] = -n, other

    def add(self, size: int, before: int, behind: int, rows: list[tuple[str, int]]) -> None:
        """Rows (word, n) of one initial state: pairs whose shorter word has ``size`` letters, whose first ``before`` and
        last ``behind`` letters are shared."""
        shared: dict[tuple[str, str], dict[str, tuple[str, int]]] = {}
        for word, n in rows:  # hashes of different ends may be equal
            end = len(word) - behind
            shared.setdefault((word[:before], word[end:]), {})[word[before:end]] = (word, n)
        for middle in shared.values():
            if len(middle) > 1:
                start = self.acceptor.add(sorted(middle))
                for a, b in self.acceptor.near(start, size - before - behind, behind == 0):
                    (u, n), (v, m) = middle[a], middle[b]
                    self._note(u, v, m)
                    self._note(v, u, n)
        self.words += len(rows)


def word_counts(docs: DataFrame, least: int = 7, text: str = "text", doc_id: str = "doc_id", every: int = 31) -> DataFrame:
    """(word, n): runs of letters in lower case (A to Z only), with one letter deleted where ``every`` divides the crc32 of
    "doc_id:run", of ``least`` letters or more, and how often they occur. Counts are pre-aggregated."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _end_hash() -> Column:
    return F.xxhash64(F.expr("substring(word, 1, before)"), F.expr("right(word, behind)"))


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of initial states (size, before, behind) under the two that divide each: edits behind the middle of what is
    free in the shorter word, and edits before it."""
    half = F.expr("(size - before - behind + 1) div 2").cast("int")
    ends = F.array(F.struct((F.col("before") + half).alias("before"), F.col("behind")), F.struct(F.col("before"), (F.col("size") - F.col("before") - half).alias("behind")))
    rows = rows.withColumn("e", F.explode(ends)).select("word", "n", "size", F.col("e.before").alias("before"), F.col("e.behind").alias("behind"))
    return rows.withColumn("h", _end_hash())


_KEY = ["size", "before", "behind", "h"]


def near_words(vocabulary: DataFrame, least: int = 7, largest: int = LARGEST) -> DataFrame:
    """(word, n_near, near_n, near_word): for each word (word, n) with words at one edit their number, and of them the one of
    largest n, of equals the first by code points."""
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda s: s >= least)
    rows = vocabulary.select("word", "n", F.explode(sizes).alias("size"), F.lit(0).alias("before"), F.lit(0).alias("behind"))
    rows = _divided(rows)
    done = None
    while True:
        free = F.col("size") - F.col("before") - F.col("behind")
        big = rows.groupBy(*_KEY).agg(F.count("*").alias("words")).filter((F.col("words") > largest) & (free > 1)).select(*_KEY)
        big = C.materialize(big, "initial-states")
        small = rows.join(big, _KEY, "left_anti") if (more := not big.isEmpty()) else rows
        done = small if done is None else done.unionByName(small)
        if not more:
            break
        rows = C.materialize(_divided(rows.join(big, _KEY, "left_semi")), "initial-states")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()

        def result() -> pa.RecordBatch:
            words = list(chunk.best)
            n, m, w = zip(*chunk.best.values(), strict=True) if words else ((), (), ())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((words, n, m, w), kinds, strict=True)], ["word", "n_near", "minus", "near_word"])

        every = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("word", "n", *_KEY)), strict=True) for b in batches)
        for (size, before, behind, _), group in groupby(every, itemgetter(2, 3, 4, 5)):
            held = [(r[0], r[1]) for r in group]
            if len(held) > 1:
                chunk.add(size, before, behind, held)
                if chunk.words >= CHUNK:
                    yield result()
                    chunk = _Chunk()
        yield result()

    dealt = done.repartition(*_KEY).sortWithinPartitions(*_KEY)
    found = dealt.mapInArrow(run, "word string, n_near long, minus long, near_word string")
    best = F.min(F.struct("minus", "near_word"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("near_n"), F.col("b.near_word").alias("near_word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms, which has no form itself. Chains have no circles; each
    round halves them."""
    links = C.materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = links.join(onward, F.col("root") == F.col("_at"), "left")
        before, links = links, C.materialize(moved.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "forms")
        C.discard(before)
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def variants(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, text: str = "text", doc_id: str = "doc_id", largest: int = LARGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``least`` letters that occurs ``times`` times.

    form is the word at one edit of largest n (of equals the first by code points), if that is ``ratio`` times the word's own;
    root is the last of the chain of forms, the word itself if it has none. Null texts have no words; a null doc_id counts
    as an empty one in what decides on deletions; repeated rows count each. Words of any length are taken whole. An empty
    table gives an empty result. Further columns of docs are ignored.
    """
    vocabulary = C.materialize(word_counts(docs, least, text, doc_id).filter(F.col("n") >= times), "vocabulary")
    near = C.materialize(near_words(vocabulary, least, largest), "near-words")
    led = F.col("near_n") >= ratio * F.col("n")
    rows = vocabulary.join(near, "word", "left")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("near_word")).alias("form"), F.when(led, F.col("near_n")).alias("form_n"))
    rows = C.materialize(rows, "variants")
    C.discard(vocabulary, near)
    found = rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
