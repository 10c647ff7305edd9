"""Document quality rules, run as a short-circuit cascade.

Costs and rejections are estimated on a bounded random sample: the rule with most rejections per second goes first, the
next is found on what it leaves, with the features that it has computed at hand, and so on. A document leaves the cascade
at its first rejection. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_INNER = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes
_SYMBOLS = b"#*$%&|<>"


class Document:
    """Features of one text, each computed when a rule first asks for it."""

    def __init__(self, text: bytes | None):
        self.raw = text or b""

    def copy(self) -> Document:
        """Another with the features computed so far."""
        other = Document.__new__(Document)
        other.__dict__.update(self.__dict__)
        return other

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, _SPACES + _INNER))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        pair = ids[:-1] * len(known) + ids[1:]
        if len(known) > 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(known) + ids[2:]
        found, which, counts = np.unique(window, return_inverse=True, return_counts=True)
        if len(found) == len(window):
            return 0
        again = counts[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def capitals(self) -> tuple[int, int]:
        """Capital and small letters of A-Z; other scripts don't count."""
        upper = sum(map(self.raw.count, _UPPER)) if len(self.raw) < 64 else int(_CASE[np.frombuffer(self.raw, np.uint8)].sum())
        lower = len(self.raw) - len(self.raw.translate(None, _LOWER_ALL))
        return upper, lower


_UPPER = [bytes([c]) for c in range(65, 91)]
_LOWER_ALL = bytes(range(97, 123))
_CASE = np.zeros(256, np.uint8)
_CASE[65:91] = 1


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def default_rules(min_words: int = 50, repeat_percent: int = 50) -> list[Rule]:
    """The two base rules, then thresholds far outside what ordinary prose shows."""
    return [
        Rule("few_words", lambda d: d.n_words < min_words),
        Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > repeat_percent * d.n_words),
        Rule("symbols", lambda d: 4 * d.n_symbols > d.n_words),
        Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
        Rule("shouting", lambda d: d.capitals[0] > 2 * d.capitals[1] and 4 * d.capitals[0] > d.word_chars),
        Rule("exclamation", lambda d: 2 * d.raw.count(b"!") > d.n_words),
        Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
    ]


def sampled(docs: DataFrame, text: str = "text", rows: int = 400, chars: int = 20_000, seed: int = 8) -> list[bytes | None]:
    """About ``rows`` random texts, twice as many at most, of at most ``chars`` code points each."""
    body = docs.select(F.col(text).cast("binary").alias("body"), F.length(text).alias("n"))
    share = 1.2 * rows / max(1, docs.count())
    body = body.sample(share, seed) if share < 1 else body
    return [r.body for r in body.filter(F.coalesce("n", F.lit(0)) <= chars).limit(2 * rows).select("body").collect()]


def order_rules(sample: list[bytes | None], rules: list[Rule], clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """Rules by rejections per second among the sampled texts that those before them leave.

    Features that earlier rules compute cost later ones nothing. The sample only sets the order; a rule that rejects none
    of it still runs.
    """
    docs, left, ordered = [Document(x) for x in sample], list(rules), []
    while left:
        tried = []
        for rule in left:
            trial = [d.copy() for d in docs]
            began = clock()
            gone = [rule.rejects(d) for d in trial]
            cost = clock() - began + 1e-7
            tried.append((-sum(gone) / cost, cost, len(tried), [d for d, x in zip(trial, gone, strict=True) if not x]))
        *_, best, docs = min(tried, key=lambda t: t[:3])
        ordered.append(left.pop(best))
    return ordered


def judge(doc: Document, rules: list[Rule]) -> tuple[int, str | None]:
    """(rules that ran, the name of the one that rejected, if any)."""
    for i, rule in enumerate(rules):
        if rule.rejects(doc):
            return i + 1, rule.name
    return len(rules), None


def passes(doc: Document, rules: list[Rule]) -> bool:
    return judge(doc, rules)[1] is None


def _mapped(docs: DataFrame, text: str, fields: list[T.StructField], of: Callable[[bytes | None], tuple]) -> DataFrame:
    """docs with more columns that ``of`` makes from each text."""
    names = [C.in_frame(f.name, docs) for f in fields]
    arrow = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}

    def run(batches):
        for part in C.pieces(batches):
            rows = [of(x) for x in part.column(text).cast(pa.binary()).to_pylist()]
            made = [pa.array([r[i] for r in rows], arrow[f.dataType]) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True))])
    return docs.mapInArrow(run, schema)


def verdicts(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, trace: bool = False) -> DataFrame:
    """docs with the column ``kept`` (``kept_1``... if docs has one): whether no rule rejects the text.

    With ``trace`` also rules_run (how many rules the text met) and rejected_by (the last of them, if it rejected), which
    depend on the order of this run. A null text is an empty one, which few_words rejects. Rows are judged one by one, so
    repeated rows get equal verdicts; an empty table gives an empty result.
    """
    ordered = order_rules(sampled(docs, text), rules or default_rules())
    fields = [T.StructField("kept", T.BooleanType()), *[T.StructField("rules_run", T.LongType()), T.StructField("rejected_by", T.StringType())] * trace]

    def of(x):
        ran, by = judge(Document(x), ordered)
        return (by is None, ran, by)[: len(fields)]

    return _mapped(docs, text, fields, of)


def filter_quality(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that pass every rule, with the columns of docs."""
    flag = C.in_frame("kept", docs)
    return verdicts(docs, text, rules).filter(F.col(flag)).select(*docs.columns)


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is the verdict of the cascade over all rules, the two base rules among them; counts that it had no need of are
    taken after it. Null and empty texts count nothing and fail.
    """
    rules = order_rules(sampled(docs, text), default_rules())
    base = [r for r in rules if r.name in ("few_words", "repeated_windows")]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]

    def of(x):
        d = Document(x)
        kept = passes(d, rules)
        return (*(getattr(d, n) for n in names), not passes(d, base), kept)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _mapped(rows, "text", fields, of).drop("text")
