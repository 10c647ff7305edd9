"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any texts the unlabelled rest, in which toxic ones hide at the rate of the
class prior. With P the positives and U the unlabelled, the risk of a scorer is

    prior * R(P, +) + max(0, R(U, -) - prior * R(P, -)),

where the second term estimates the risk on negatives and is kept from going below zero (Kiryo et al., 2017).

The models are linear in word features, trained in numpy on a bounded sample. Words of the sampled texts, whatever
their length, are counted in Spark; the driver gets the counts of telling words only. Scoring runs over every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FOLDS = 5
SCALE = 10.0
#: Bytes of a word at most that a worker remembers, so that its cache is bounded in bytes.
CACHED_WORD = 64
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”‘’…"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def word_hash(word: bytes) -> int:
    """Of a word in lower case without signs at its edges; 0 if nothing is left."""
    core = word.decode().lower().strip(_EDGES)
    return (xxhash.xxh3_64_intdigest(core) or 1) if core else 0


@dataclass
class Settings:
    """positives, unlabelled: most rows of the training sample; features: most words of the model, the most telling;
    entries: most different telling words of its texts together, beyond which fewer texts are taken."""

    positives: int = 12_000
    unlabelled: int = 24_000
    features: int = 50_000
    entries: int = 20_000_000
    least_texts: int = 4  # in which a word occurs, to be a feature
    least_z: float = 4.5  # of the difference of its shares of positive and unlabelled texts
    models: int = 9
    epochs: int = 16
    batches: int = 24
    rate: float = 2.0
    decay: float = 1e-5
    seed: int = 7


@dataclass
class Model:
    """logit = bias + SCALE * sum over words of weight * log(1 + count) / sqrt(number of words), averaged over models."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    known: dict[bytes, int] = field(default_factory=dict)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        lookup = dict(zip(self.words.tolist(), range(len(self.words)), strict=True))
        known, out = self.known, np.empty(len(texts))
        for k, text in enumerate(texts):
            words = (text or b"").split()
            at = []
            for w in words:
                i = known.get(w)
                if i is None:
                    i = lookup.get(word_hash(w), -1)
                    if len(w) <= CACHED_WORD:
                        if len(known) >= 500_000:
                            known.clear()
                        known[w] = i
                if i >= 0:
                    at.append(i)
            which, count = np.unique(np.array(at, np.int64), return_counts=True)
            out[k] = self.bias + SCALE * (self.weights[which] @ np.log1p(count)) / np.sqrt(max(1, len(words)))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


@dataclass
class Sample:
    """Texts of one kind in sparse rows: places of features in the vocabulary, their counts, where each row starts, and
    the number of all words of each text."""

    at: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.words)

    def __post_init__(self):
        self.sizes = np.diff(np.append(self.starts, len(self.at)))
        self.values = SCALE * np.log1p(self.counts) / np.sqrt(np.maximum(1, np.repeat(self.words, self.sizes)))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, values, place of the row among ``rows``) of all entries of these rows."""
        n = self.sizes[rows]
        where = np.arange(n.sum()) + np.repeat(self.starts[rows] - (np.cumsum(n) - n), n)
        return self.at[where], self.values[where], np.repeat(np.arange(len(rows)), n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk_and_slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk, its term on negatives, slopes by the logits of positives, slopes by those of unlabelled texts).

    Logistic loss: (z, +) is log(1 + exp(-z)), (z, -) is log(1 + exp(z)). Where the term on negatives is below zero, the
    slopes are those of a step back on that term alone.
    """
    negative = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    slope_p, slope_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    risk = prior * float(np.logaddexp(0, -zp).mean()) + max(0.0, negative)
    if negative < 0:
        return risk, negative, -slope_p, -slope_u
    return risk, negative, slope_p + prior * (_sigmoid(zp) - 1) / len(zp), slope_u


def fit(positive: Sample, unlabelled: Sample, vocabulary: np.ndarray, prior: float, settings: Settings | None = None) -> Model:
    """Average of linear models, each trained by AdaGrad on the non-negative risk with logistic loss.

    vocabulary has sorted word hashes. The prior is kept between 1e-4 and 1 - 1e-4. Without positives or unlabelled
    texts the model scores ``prior`` everywhere.
    """
    s = settings or Settings()
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    start = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(np.empty(0, np.uint64), np.empty(0), start)
    p, u = positive, unlabelled
    weights, biases = [], []
    for m in range(s.models):
        rng = np.random.default_rng([s.seed, m])
        w, b = np.zeros(len(vocabulary)), start
        grown, grown_b = np.full(len(w), 1e-8), 1e-8
        for _ in range(s.epochs):
            deal_p = np.array_split(rng.permutation(len(p)), s.batches)
            deal_u = np.array_split(rng.permutation(len(u)), s.batches)
            for rows_p, rows_u in zip(deal_p, deal_u, strict=True):
                if not len(rows_p) or not len(rows_u):
                    continue
                (ap, vp, rp), (au, vu, ru) = p.take(rows_p), u.take(rows_u)
                zp = b + np.bincount(rp, w[ap] * vp, len(rows_p))
                zu = b + np.bincount(ru, w[au] * vu, len(rows_u))
                slope_p, slope_u = risk_and_slopes(zp, zu, prior)[2:]
                g = np.bincount(ap, slope_p[rp] * vp, len(w)) + np.bincount(au, slope_u[ru] * vu, len(w)) + s.decay * w
                gb = slope_p.sum() + slope_u.sum()
                grown += g * g
                grown_b += gb * gb
                w -= s.rate * g / np.sqrt(grown)
                b -= s.rate * gb / np.sqrt(grown_b)
        weights.append(w)
        biases.append(b)
    return Model(vocabulary, np.mean(weights, axis=0), float(np.mean(biases)))


def chosen_texts(docs: DataFrame, labels: DataFrame, settings: Settings, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """(doc_id, positive, words, hashes, counts): the training sample with the word counts of whole texts.

    Outside the held-out fold, at most settings.positives ids with toxic = 1 and settings.unlabelled ids of docs are
    chosen by hash, both bounded, so they are broadcast. Of a repeated id the least text counts. An id may be in both.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).filter("toxic = 1").filter(fold(F.col("doc_id")) != 0)
    order = F.xxhash64("doc_id", F.lit(settings.seed))
    marked = known.select("doc_id").distinct().orderBy(order, "doc_id").limit(settings.positives)
    free = docs.select(F.col(doc_id).alias("doc_id")).filter("doc_id IS NOT NULL").filter(fold(F.col("doc_id")) != 0)
    share = min(1.0, 1.2 * settings.unlabelled / max(free.count(), 1))
    free = free.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).distinct().orderBy(order, "doc_id").limit(settings.unlabelled)
    chosen = marked.withColumn("positive", F.lit(True)).unionByName(free.withColumn("positive", F.lit(False)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def run(batches):
        for part in C.pieces(batches):
            made = []
            for x in part.column("text").cast(pa.binary()).to_pylist():
                found = np.fromiter((word_hash(w) for w in x.split()), np.uint64)
                made.append((len(found), *np.unique(found[found != 0], return_counts=True)))
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1].view(np.int64) for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), *columns], ["doc_id", "positive", "words", "hashes", "counts"])

    kind = dict(rows.dtypes)["doc_id"]
    return C.materialize(rows.mapInArrow(run, f"doc_id {kind}, positive boolean, words long, hashes array<long>, counts array<long>"), "chosen")


def telling_words(chosen: DataFrame, settings: Settings) -> np.ndarray:
    """Sorted hashes of words whose share of texts differs clearly between both kinds; the others would only overfit.

    Words are counted in Spark; at most settings.features, those of the greatest difference, come to the driver.
    """
    m, n = chosen.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not m or not n:
        return np.empty(0, np.uint64)
    words = chosen.select("positive", F.explode("hashes").alias("word")).groupBy("word")
    words = words.agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b")).filter(F.col("a") + F.col("b") >= settings.least_texts)
    both = (F.col("a") + F.col("b") + 1) / (m + n + 2)
    z = F.abs(F.col("a") / m - F.col("b") / n) / F.sqrt(both * (1 - both) * (1 / m + 1 / n))
    found = words.withColumn("z", z).filter(F.col("z") >= settings.least_z).orderBy(F.desc("z"), "word").limit(settings.features).select("word").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def training_sample(chosen: DataFrame, vocabulary: np.ndarray, settings: Settings | None = None) -> tuple[Sample, Sample]:
    """(positives, unlabelled) in rows of vocabulary words. The driver gets their counts, no other words.

    Where the texts hold over settings.entries different words of the vocabulary in all, so many of them are left out, by
    hash and of either kind alike, that about so many stay.
    """
    settings = settings or Settings()
    shared = chosen.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for part in C.pieces(batches):
            at, counts = [], []
            for hashes, n in zip(part.column("hashes"), part.column("counts"), strict=True):
                own, n = hashes.values.to_numpy().view(np.uint64), n.values.to_numpy()
                i = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                hit = known[i] == own if len(known) else np.zeros(len(own), bool)
                at.append(i[hit].astype(np.int32))
                counts.append(n[hit].astype(np.int32))
            columns = [pa.array(x, pa.list_(pa.int32())) for x in (at, counts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), part.column("words"), *columns], ["doc_id", "positive", "words", "at", "counts"])

    kind = dict(chosen.dtypes)["doc_id"]
    rows = C.materialize(chosen.mapInArrow(run, f"doc_id {kind}, positive boolean, words long, at array<int>, counts array<int>"), "sample")
    held = rows.agg(F.sum(F.size("at").cast("long"))).first()[0] or 0
    share = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed + 1)), F.lit(1 << 30)) < int(settings.entries / max(held, 1) * (1 << 30))
    got = (rows.filter(share) if held > settings.entries else rows).toArrow()
    C.discard(rows)
    got = got.sort_by([("doc_id", "ascending")]).combine_chunks()
    out = []
    for kind in (True, False):
        rows = got.filter(pc.equal(got.column("positive"), kind))
        sizes = pc.fill_null(pc.list_value_length(rows.column("at")), 0).to_numpy().astype(np.int64)
        flat = [pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("at", "counts")]
        out.append(Sample(*flat, np.cumsum(sizes) - sizes, rows.column("words").to_numpy()))
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> Model:
    """A model from the rows outside the held-out fold. The prior is the share of toxic rows among all labels there."""
    settings = settings or Settings()
    known = labels.filter(F.col(toxic).isNotNull()).filter(fold(F.col(doc_id)) != 0)
    prior = known.agg(F.avg(F.col(toxic).cast("double"))).first()[0] or 0.0
    chosen = chosen_texts(docs, labels, settings, text, doc_id, toxic)
    vocabulary = telling_words(chosen, settings)
    positive, unlabelled = training_sample(chosen, vocabulary, settings)
    C.discard(chosen)
    return fit(positive, unlabelled, vocabulary, prior, settings)


def scored(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Only the text decides a score; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in C.pieces(batches):
            s = shared.value.scores(part.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, **columns) -> DataFrame:
    """Train outside the held-out fold, then score every row of docs.

    Without toxic labels every score is the smallest prior; an empty table gives an empty result.
    """
    model = train(docs, labels, settings, **columns)
    columns.pop("toxic", None)
    return scored(docs, model, **columns)
