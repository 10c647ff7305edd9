"""Spelling variants, retrieval packing and whitening against brute force, and on odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonolith.llm import packing, spelling, whitening, wordids

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


# spelling variants


@pytest.mark.parametrize("letters", ["ab", "abc"])
def test_composition_gives_every_pair_once(letters):
    r = random.Random(len(letters))
    for _ in range(100):
        n = r.randint(1, 5)
        words = sorted({"".join(r.choice(letters) for _ in range(n + r.randint(0, 1))) for _ in range(40)})
        a = spelling.Acceptor()
        a.add(["zz"])
        got = sorted(a.near(a.add(words), n, True))
        pairs = (tuple(sorted((u, v), key=lambda w: (len(w), w))) for i, u in enumerate(words) for v in words[i + 1 :] if near(u, v))
        assert got == sorted(p for p in pairs if len(p[0]) == n)


def test_acceptor_is_minimal():
    a = spelling.Acceptor()
    a.add(["ab", "bb", "cb"])
    n = len(a.final)
    a.add(["ab", "bb", "cb"])
    assert len(a.final) == n == 3


def brute_variants(rows, least=7, times=2, ratio=10):
    counts = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    n = {w: c for w, c in counts.items() if c >= times}
    out, form = {}, {}
    for w in n:
        close = sorted((-n[v], v) for v in n if near(w, v))
        if close and -close[0][0] >= ratio * n[w]:
            form[w] = close[0][1]
        out[w] = len(close)
    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), n[w], out[w], n[form[w]] if w in form else None) for w in n)


def variant_rows():
    r = random.Random(5)
    base = ["abcdefgh", "abcdefghi", "zzzzzzzz", "Übergrößen", "çadencé", "a" * 40]
    rows = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = base[min(int(r.expovariate(1.2)), 5)]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abz") + w[at:], w[:at] + r.choice("abz") + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i % 390, r.choice(" .,-\n1").join(words), None))
    return [*rows, (None, "abcdefgh " * 50, None), (None, "abcdefgh " * 50, None), (7, None, "x"), (8, "", None), (9, ("q" * 50_000 + " ") * 2, None), (9, "q" * 49_999 + " " + "q" * 49_999, None)]


@pytest.mark.parametrize("largest", [20_000, 3])
def test_variants_equal_brute_force(spark, largest):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "'x' AS root").repartition(3)
    got = spelling.variants(docs, largest=largest).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(r) for r in got) == brute_variants(rows)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "short 12", None)], SCHEMA)
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.filter("false")).count() == 0


# packing


def test_byte_ids_equal_the_library():
    library, own, r = Tokenizer.from_file(BYTES), wordids.ByteEncoder(BYTES), random.Random(3)
    parts = ["a", "b", "Z", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'ll", "é", "à", "ß", "×", "1", "23", "!", "...", " ", "\x85", "\x1c", "ſ", "𝒳", "中", "٣", "<|endoftext|>", "don't", "　", "́", "—", "’s", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", "x" * 100_000, " " * 70]
    ids, sizes = own.encode(pa.array(texts), 1)
    want = [e.ids + [1] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def packed_rows():
    r = random.Random(2)
    topics = [["alpha", "beta", "gamma"], ["red", "green", "blue"], ["one", "two", "three"]]
    rows = [(i, " ".join(r.choice(topics[i % 3]) for _ in range(r.choice([3, 40, 400]))), None) for i in range(200)]
    return [*rows, (5, "a repeated id", "x"), (None, "no id", None), (None, "no id", None), (900, None, None), (901, "", None), (902, "word " * 30_000, None), (903, "x" * 100_000, None)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_every_id_lies_in_one_piece(spark, partitions):
    rows = packed_rows()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS start", "2 AS ids", "3 AS row", "4 AS first").repartition(3)
    got = packing.pack(docs, BYTES, shard_partitions=partitions).collect()
    library = Tokenizer.from_file(BYTES)
    whole = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in rows)
    sequences, seen = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        ids = np.frombuffer(p.ids, "<u4")
        sequences[p.sequence_id].append((p.offset, len(ids)))
        seen[p.doc_id, p.doc_tokens].append((p.start, tuple(ids.tolist())))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces[:-1])]).tolist() and sum(n for _, n in pieces) <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= partitions
    for (i, n), times in collections.Counter((i, len(ids)) for (i, ids), c in whole.items() for _ in range(c)).items():
        assert sum(len(ids) for _, ids in seen[i, n]) == n * times
    single = {key: ids for key, ids in ((k, c) for k, c in whole.items()) if ids == 1}
    for i, ids in single:
        if sum(k[0] == i and len(k[1]) == len(ids) for k in whole) == 1:
            assert sum((x for _, x in sorted(seen[i, len(ids)])), ()) == ids
    again = packing.pack(docs, BYTES, shard_partitions=partitions).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_neighbours_rank_as_bm25_and_fill_windows():
    ids = np.array([1, 2, 3, 1, 2, 9, 4, 5, 6, 1, 7, 8], np.int64)
    lengths = np.array([3, 3, 3, 3])
    f = np.bincount(packing.bags(ids, lengths)[1], minlength=10)
    index = packing.Index(ids, lengths, packing.Weights(f, 4, 12))
    idf = np.log1p((4 - f + 0.5) / (f + 0.5))
    want = [idf[1] + idf[2], 0, idf[1]]  # all lengths equal the mean and every id occurs once: BM25 is the sum of idf
    assert want[0] > want[2] > want[1]
    assert list(index.neighbours(0, np.array([False, True, True, True]))) == [1, 3]
    sequences = list(packing.fill(lengths, index, 5))
    assert sequences[0] == [(0, 0, 3), (1, 0, 2)] and [sum(n for _, _, n in s) for s in sequences] == [5, 5, 2]
    assert sequences[1][0] == (1, 2, 1)


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


# whitening


def test_directions_equal_an_svd():
    r = np.random.default_rng(0)
    for t in range(120):
        d, m = int(r.integers(1, 40)), int(r.integers(1, 80))
        x = r.normal(size=(m, d)) * (10.0 ** r.integers(-3, 4, size=d) if t % 3 else 1)
        if t % 4 == 1:
            x[:, d // 2 :] = x[:, : d - d // 2]  # repeated and zero values
        if t % 7 == 3:
            x = np.diag(r.integers(0, 3, size=d)).astype(float)
        x = x - x.mean(0)
        k = min(8, d)
        squares, v = whitening.directions(whitening._triangle(x), k)
        want = np.linalg.svd(x, compute_uv=False) ** 2
        want = np.concatenate([want, np.zeros(max(0, d - len(want)))])
        scale = max(want.max(), 1e-300)
        assert np.abs(squares - want).max() / scale < 1e-12 and np.abs(v.T @ v - np.eye(k)).max() < 1e-10
        assert np.abs(x.T @ x @ v - v * squares[:k]).max() / scale < 1e-11


def test_small_values_keep_their_digits():
    diagonal, above = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([1e-4, 1e-7, 1e-10])
    got = np.sqrt(whitening.singular_squares(diagonal, above))
    # the determinant is the product of the diagonal, and interlacing pins the rest
    assert np.isclose(np.prod(got), np.prod(diagonal), rtol=1e-12) and np.isclose(got[-1], 1e-9, rtol=1e-6)


def test_whitened_equals_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 12)) @ r.normal(size=(12, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, rows[0][1]), (3, rows[3][1]), (400, None), (401, [None] + rows[1][1][1:]), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (404, [1.0] * 5), (405, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS component", "2 AS n", "3 AS v").repartition(5)
    got = whitening.whitened(df).collect()
    kept = rows + odd[:2]
    y = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    n, s = len(y), y.sum(0)
    c = y - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 8 * n and {g.n for g in got} == {n} and got[0].identity_error < 1e-9
    by = collections.defaultdict(dict)
    for g in got:
        by[g.vec_id][g.component] = g
    signs = {}
    for (i, _), row in zip(kept, c, strict=True):
        for j in range(8):
            g, w = by[i][j + 1], row @ vectors[:, j] / np.sqrt(values[j])
            sign = signs.setdefault(j, np.sign(g.whitened * w))
            assert abs(g.whitened - sign * w) < 1e-9 and abs(g.explained - values[j] / values.sum()) < 1e-12
        assert by[i][1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[[k for k, _ in kept].index(i)], s, strict=True))


def test_no_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.component, r.whitened is None) for r in whitening.whitened(one).collect())
    assert got == [(i, c, c == 2) for i in (1, 2, 3) for c in (1, 2)]
    assert whitening.whitened(one.filter("false")).count() == 0
    alone = whitening.whitened(one.filter("vec_id = 1")).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in alone] == [(None, 0, 0.0, 0.0)] * 2


# spans


def test_brackets_with_spaces():
    from sonolith.llm import pii

    text = "see 192[ . ]168[ . ]0[ . ]1 now"
    assert pii.find(text) == ([], [("ip", 4, 27)]) and text[4:27] == "192[ . ]168[ . ]0[ . ]1"
