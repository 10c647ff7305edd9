"""Operators against brute force, exact round trips and edge cases."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonolith.llm import bpe, common, exact, linededup, mixing, nearjoin, pii, quality, repair, tokenbin, toxicity, warc, wordids
from sonolith.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Rows with nulls in any column, empty and white texts, ties, repeated rows and a very long text.
ROWS = [
    (5, "one two three four five six", "a"), (2, "one  two three\tfour five six", "a"), (2, "one  two three\tfour five six", "a"), (9, None, "b"), (8, "", None), (None, "", "b"),
    (7, " \n\t ", "b"), (None, "null id text here", None), (None, "null id text here", None), (11, "ä€𝒳 mixed ſcripts ẞ", "c"), (12, "word " * 60_000, "c"), (13, "x" * 300_000, "c"),
    (14, "l1 a b\nl2 a b\nl3 a b\nl4\nl1 a b\nl2 a b\nl3 a b\nend", "d"), (15, "top\nl1 a b\nl2 a b\nl3 a b", "d"), (15, "another text of a repeated id", "d"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with those that the operators add
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'k' AS kept", "1 AS recipe", "2 AS n_lines", "3 AS KEY", "4 AS times", "5 AS size", "6 AS component_id").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows_of(df, *names):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# exact deduplication


def test_exact_groups(docs, empty):
    got = exact.duplicate_groups(docs)
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(plain(t), []).append(i)
    assert got.count() == len(ROWS)
    kept = 0
    for r in got.collect():
        kept += r.kept
        members = groups[next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)]
        ids = [m for m in members if m is not None]
        assert r.group_size == len(members) and r.keep_id == (min(ids) if ids else None)
    assert kept == len(groups)
    few = exact.drop_duplicates(docs.filter("doc_id IN (5, 2, 9, 8)").dropDuplicates(["doc_id"]))
    assert few.columns == docs.columns and rows_of(few, "doc_id") == [(2,), (8,)]
    once = exact.drop_duplicates(docs)
    assert once.columns == docs.columns and once.count() == len(groups)
    assert exact.duplicate_groups(empty).count() == 0 and exact.drop_duplicates(empty).count() == 0


def test_exact_identifiers_grow_until_none_collide(docs):
    many = docs.sparkSession.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert exact.verified_size(many, "text", 1) > 1
    assert exact.duplicate_groups(many.select(F.lit(1).cast("long").alias("doc_id"), "text"), size=1).filter("group_size > 1").count() == 0


def test_chunks_join_to_the_text_and_move_with_it():
    rnd = random.Random(1)
    text = bytes(rnd.randrange(97, 123) for _ in range(60_000))
    parts = exact.chunks(text)
    assert b"".join(parts) == text and all(len(p) <= 8192 for p in parts)
    assert len(set(parts) & set(exact.chunks(b"moved by a few bytes" + text))) > len(parts) - 4


# near duplicates


def near_brute(rows, k, percent):
    def shingles(t):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("small", [400, 6])
def test_near_duplicates_equal_brute_force(spark, small):
    rnd = random.Random(small)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randrange(1, 120))]
        for _ in range(40 if g == 0 else rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    got = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85, small=small)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_brute(rows, 3, 85)


def test_near_duplicates_edge_cases(docs, empty):
    got = nearjoin.near_duplicates(docs, k=3, percent=85)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert sum(map(len, by_id.values())) == len(ROWS)
    assert by_id[2] == [(4, 2, True)] * 2 and by_id[5] == [(4, 2, False)]
    assert by_id[9] == [(0, 9, True)] and by_id[7] == [(0, 7, True)]
    assert by_id[12] == [(1, 12, True)] and sorted(x[0] for x in by_id[15]) == [4, 8]
    assert nearjoin.near_duplicates(empty).count() == 0
    out = nearjoin.drop_near_duplicates(docs, k=3, percent=85)
    assert out.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in out.collect())
    # 15's two texts count as linked, the two equal texts without id are one set; all without words stay
    assert ids == sorted(map(str, [2, 9, 8, None, 7, None, 11, 12, 13, 14, 15]))
    with pytest.raises(TypeError):
        nearjoin.near_duplicates(docs.withColumn("doc_id", F.lit("a")))


def test_overlaps_and_pieces():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, n)).astype(np.uint64) for n in rnd.integers(1, 50, 30)]
    for i, got in nearjoin.overlaps(sets, lambda i: i % 3 == 0, most=100):
        assert i % 3 == 0 and got.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]
    sizes = rnd.integers(1, 100, 40)
    pieces = nearjoin._split(sizes, 4000)
    assert len(pieces) > 1 and all(any(a in p and b in p for p in map(set, pieces)) for a in range(40) for b in range(40))


def test_near_links_below_large_nodes(spark):
    # pairs just above the threshold inside one group of similar texts, whose nodes stay large for several levels
    words = lambda *key: [f"w{'_'.join(map(str, key))}_{i}" for i in range(61 if key[0] == "pair" else 89 if key[0] == "own" else 700)]
    rows = [(i, " ".join(words("all") + words("pair", i // 2) + words("own", i))) for i in range(120)]
    got = nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=1, percent=80, small=3)
    assert sum(not r.kept for r in got.collect()) == 60


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    more = links.unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r.node: r.component for r in components(more).collect()}
    assert all(got[i] == 0 for i in range(1, 400)) and got[1001] == 1000


# mixing


def test_mix_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(0, 60), rnd.choice("abcdefg") if rnd.random() < 0.6 else rnd.choice(["hot", None])) for i in range(3000)]
    got = mixing.report(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert got["taken"].le(3 * got["size"]).all()
    merged = got.merge(spark.createDataFrame(rows, SCHEMA).toPandas(), on="doc_id").fillna({"source": "~"})
    per = merged.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(per["target"].sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    assert (per["taken"] - per["target"]).abs().max() <= 60 and (per["target"] <= 3 * per["size"] + 1e-6).all()
    again = mixing.report(spark.createDataFrame(rows[::-1], SCHEMA)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()


def test_mix_ranks_by_random_odds_over_inclusion_odds(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * int(rnd.paretovariate(0.8) * 3), "ab"[i % 2]) for i in range(400)]
    got = {r.doc_id: r for r in mixing.report(spark.createDataFrame(rows, SCHEMA)).collect()}

    def mix(tilted):
        taken = {}
        for source in "ab":
            own = [(i, t) for i, t, s in rows if s == source]
            size = sum(len(t.split()) for _, t in own)
            times = got[own[0][0]].target / size
            copies, p = int(times), times - int(times)
            order = []
            for i, t in own:
                n, mean = len(t.split()), size / len(own)
                u = int(hashlib.md5(f"mix|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / (1 << 52)
                order.append((u / (1 - u) / (p / (1 - p) * (2 * mean / (mean + n) if tilted else 1)), i, n))
            gap, chosen, order = p * size, set(), sorted(order)
            for _ in range(2):  # the head that fits, then one more behind it
                at, most = 0, gap
                order = [x for x in order if x[2] <= most]
                while at < len(order) and order[at][2] <= gap + 1e-6:
                    gap -= order[at][2]
                    chosen.add(order[at][1])
                    at += 1
                order = order[at:]
            taken |= {i: len(t.split()) * (copies + (i in chosen)) for i, t in own}
        return taken

    assert {i: r.taken for i, r in got.items()} == mix(True) != mix(False)


def test_mix_edge_cases(docs, empty):
    got = mixing.report(docs)
    assert got.count() == len(ROWS) and mixing.report(docs, few_sources=0).exceptAll(got).count() == 0
    words = {(i, t): len((t or "").encode().split()) for i, t, _ in ROWS}
    assert got.agg(F.sum("size")).first()[0] == sum(words[(i, t)] for i, t, _ in ROWS)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = sum(len((r.text or "").encode().split()) for r in out.collect())
    assert taken == got.agg(F.sum("taken")).first()[0]
    assert mixing.report(empty).count() == 0 and mixing.mixed(empty).count() == 0


# WARC


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "x"), (1, "http://b\r\nEvil: 1", "x"), (2, None, None), (4, "u", ""), (None, "n", "ü" * 50_000), (6, "r", "x"), (6, "r", "x"), (7, "z", "ü" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).repartition(3)
    got = rows_of(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    want = [(1, 1, "response", None), (2, 0, "response", None), (3, 1, "revisit", 1), (4, 0, "revisit", 2), (6, 1, "revisit", 1), (6, 1, "revisit", 1), (7, 100_000, "response", None), (None, 100_000, "revisit", 7)]
    assert got == want
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_warc_rolls_repeats_and_hides_unfinished_files(spark, tmp_path):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("html"))
    one, two = (f"file://{tmp_path}/{n}" for n in "ab")
    first, second = warc.write(pages, one, roll_bytes=4000), warc.write(pages, two, roll_bytes=4000)
    assert rows_of(first, "file", "records", "bytes", "sha256") == rows_of(second, "file", "records", "bytes", "sha256") and first.count() > 5
    (tmp_path / "a" / "_tmp-pages-000000-00000.warc.gz-dead").write_bytes(b"half")
    back = warc.read(warc.read_manifest(spark, one), one, payload=True)
    assert rows_of(back, "page_id", "payload") == rows_of(pages.withColumn("payload", F.col("html").cast("binary")), "page_id", "payload")
    whole = next((tmp_path / "a").glob("pages-*")).read_bytes()
    assert len(list(warc.members(io.BytesIO(whole), 100))) > 1
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(whole[:-9])))


def test_small_payloads_need_not_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    assert [r[1] for r in rows_of(warc.round_trip(pages, least_bytes=5), "page_id", "record_type")] == ["response", "response", "response", "revisit"]


# byte-level BPE


def test_bpe_equals_tiktoken(docs, empty):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(" \n\t\r ab'sé1٣!𝒳  tion　<|endoftext|>") for _ in range(rnd.randrange(0, 40))) for _ in range(4000)] + ["a" * 5000, " " * 3000, "'ll" * 900]
    for text, packed in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == enc.encode_ordinary(text) and codec.decode(packed) == text.encode()
        for piece in codec.pieces(text)[:3]:
            assert bpe.merged(piece.encode(), codec.ranks) == enc.encode_ordinary(piece)
    short = docs.filter("text IS NULL OR length(text) < 1000")
    for r in bpe.encode_texts(short, RANKS, public_tokenizers.PATTERN).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    whole = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, ids=False).collect()}
    for i, text, _ in ROWS:  # the very long ones too
        ids = enc.encode_ordinary(text or "")
        assert (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()) in whole
    cache = bpe._Cache(10)
    assert cache.take({"a", "b" * 300}, lambda keys: [1] * len(keys)) and set(cache.new) == {"a"}
    assert bpe.encode_texts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# personal data


PII_FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def test_pii_base_equals_plain_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        t = "".join(rnd.choice("a@.-_1 23+(0@.45b٣") for _ in range(rnd.randrange(0, 50)))
        want = []
        for kind, form in PII_FORMS.items():
            for m in form.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
                if ok:
                    want.append((kind, *m.span()))
        assert pii.detect(t) == want


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("jane at example dot org", "email", "jane at example dot org"),
        ("аdmin@ехample.com", "email", "аdmin@ехample.com"),
        ("call plus one two zero two five five five zero one two three ok", "phone", "plus one two zero two five five five zero one two three"),
        ("card ４５３２ ０１５１ １２８３ ０３６６.", "card", "４５３２ ０１５１ １２８３ ０３６６"),
        ("host 1０.0.0.1 up", "ip", "1０.0.0.1"),
    ],
)
def test_pii_behind_disguises(text, kind, span):
    base, added = pii.find(text)
    assert not [s for s in base if s[0] == kind] and [(k, text[a:b]) for k, a, b in added if k == kind] == [(kind, span)]
    assert span not in pii.redact(text)


def test_pii_leaves_prose_and_scales():
    for text in ("look at the dot in one two three", "meet me at noon. one, two, three four", "", None, "at dot at dot at dot"):
        assert pii.find(text) == ([], [])
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 100_000, "@" * 300_000, "a.b-" * 100_000 + "@"):
        pii.find(text)  # linear: seconds at most


@pytest.mark.parametrize("span", [
    "jоhn@example.com", "joe@firm.co [dot] uk", "joe@firm.co dot uk", "john at example.com", "jane at firm dot de", "ann at firm dot co dot uk", "jane dot doe at firm dot com",
    "192 dot 168 dot 0 dot 1", "one nine two dot 168 dot 0 dot one", "+49 one two three four 5 6 7 8",
])
def test_pii_disguises_in_part(span):
    text = f"write; {span}; soon"
    assert any(text[a:b] == span for _, a, b in pii.find(text)[1])
    assert re.fullmatch(r"write; \[(email|ip|phone)\]; soon", pii.redact(text))


def test_pii_query_rows_equal_plain_patterns(spark):
    texts = ["write to ann.lee@mail.example.org or 10.0.0.255, not 10.0.0.256", "card 4532 0151 1283 0366 and +49 (30) 1234-5678", "x@y @z a@b-.c +1 1.2.3.4.5", "ｊｏｅ＠ｆｉｒｍ．ｃｏｍ", "𝐚𝐧𝐧@𝐦𝐚𝐢𝐥.com", "host ᠑᠐.0.0.᠑", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t, base = texts[r.doc_id] or "", []
        for kind, form in PII_FORMS.items():
            for m in form.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                    base.append((kind, *m.span()))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in PII_FORMS]
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(",") if r.spans else [])
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(base) and (r.n_added > 0) == (r.doc_id in (3, 4, 5))


def test_pii_rows(docs, empty):
    got = pii.spans(docs)
    assert got.count() == len(ROWS) and got.filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert pii.spans(empty).count() == 0 and pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == len(ROWS)


# quality


def test_quality_features_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(3000):
        t = "".join(rnd.choice(["a", "b", " ", "\n", "é", "#", "a b ", "\t", "\r\n", "|", "b a\n"]) for _ in range(rnd.randrange(0, 60)))
        d = quality.Document(t.encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        cover = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
        assert (d.n_words, d.word_chars, d.n_dup_lines, d.n_repeat_words) == (len(words), sum(map(len, words)), dup, len(cover))
        assert d.n_symbols == len(re.findall(r"[#*$%&|<>]", t))


def test_quality_order_never_changes_verdicts(docs, empty):
    rules = quality.default_rules()
    d = [quality.Document((t or "").encode()) for _, t, _ in ROWS]
    assert all(quality.passes(x, rules) == quality.passes(x, rules[::-1]) for x in d)
    sample = quality.sampled(docs)
    assert len(sample) == len([t for _, t, _ in ROWS if len(t or "") <= 20_000]) and len(quality.sampled(docs, rows=1)) <= 2
    assert {r.name for r in quality.order_rules(sample, rules)} == {r.name for r in rules}
    assert quality.measured(docs).filter("kept AND base_failed").count() == 0
    out = quality.verdicts(docs)
    assert out.columns == [*docs.columns, "kept_1"] and out.count() == len(ROWS)
    assert quality.filter_quality(docs).columns == docs.columns
    assert quality.measured(empty).count() == 0 and quality.filter_quality(empty).count() == 0


def test_quality_cascade_stops_early_and_orders_by_what_is_left(spark):
    now, ran = [0.0], []

    def rule(name, cost, rejects):
        def check(d):
            ran.append(name)
            if name not in d.__dict__:  # a feature: paid for once a document
                now[0] += cost
                d.__dict__[name] = True
            return rejects(d.raw)

        return quality.Rule(name, check)

    texts = [bytes([65 + i % 10]) for i in range(100)]
    # costly rejects most; cheap pays best; after it, overlap finds nothing more and rest is worth more than costly
    rules = [rule("costly", 8.0, lambda x: x < b"F"), rule("overlap", 1.5, lambda x: x < b"D"), rule("cheap", 1.0, lambda x: x < b"D"), rule("rest", 1.0, lambda x: x > b"I")]
    order = [r.name for r in quality.order_rules(texts, rules, lambda: now[0])]
    assert order[0] == "cheap" and order.index("rest") < order.index("costly") < order.index("overlap")
    ran.clear()
    assert quality.judge(quality.Document(b"A"), [rules[2], rules[0]]) == (1, "cheap") and ran == ["cheap"]
    rows = [(i, "word " * n) for i, n in enumerate([3, 80, 10, 200, 0])] + [(9, " ".join(f"w{i}" for i in range(90)))]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), trace=True).collect()}
    assert [i for i, r in got.items() if r.kept] == [9] and got[9].rules_run == 7 and got[9].rejected_by is None
    assert all(r.rules_run < 7 and r.rejected_by for i, r in got.items() if i != 9)


def test_capitals_of_few_latin_words_are_no_shouting():
    russian = "Это обычный русский текст о двадцатом веке. " * 20 + "XX"
    assert quality.passes(quality.Document(russian.encode()), [r for r in quality.default_rules() if r.name == "shouting"])
    assert not quality.passes(quality.Document(b"BUY NOW CHEAP " * 30), [r for r in quality.default_rules() if r.name == "shouting"])


# line windows


def test_line_windows(docs, empty):
    got = {r.doc_id: r for r in linededup.deduplicated(docs.filter("doc_id IN (14, 15)")).collect() if "l1" in r.text}
    assert got[14].text == "l1 a b\nl2 a b\nl3 a b\nl4\nend" and got[14].n_removed == 3
    assert 15 not in got  # its passage is a later occurrence
    full = linededup.deduplicated(docs)
    assert full.columns == [*docs.columns, "n_lines_1", "n_removed"] and full.count() == len(ROWS)
    assert rows_of(full.filter("doc_id = 15"), "text") == [("another text of a repeated id",), ("top",)]
    assert rows_of(full.filter("doc_id = 9"), "text", "n_removed") == [(None, 0)]
    assert linededup.deduplicated(empty).count() == 0


def test_line_windows_inside_long_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 7)))
    passage, free = [word() for _ in range(55)], lambda n: " ".join(word() for _ in range(n))
    once = free(40) + "\t " + " ".join(passage) + "  " + free(9)
    texts = [once, free(70) + " " + "\t ".join(passage) + " \r" + free(60) + "\nshort", free(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, " ".join(passage)), (None, "x " * 90), (7, "y " * 90 + "\n"), (8, " ".join(passage[:20]))]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(rows) and all((i, t) in by for i, t in rows if i in (0, 2, 7, 8)) and (None, "x " * 90) in by
    left = next(r.text for r in got if r.doc_id == 1)
    words, before = left.split(), texts[1].split()
    assert 40 <= len(before) - len(words) <= 55 and words[:70] == before[:70] and words[-61:] == before[-61:] and left.endswith("\nshort")
    assert texts[1].startswith(left[:200]) and min(len(r.text.split()) for r in got if r.doc_id is None) < 55 / 2  # but for a part at either end


@pytest.mark.parametrize("seed", range(20))
def test_parts_are_the_plain_rule(seed):
    rng = random.Random(seed)
    words = [rng.choice(["of", "the", "é", *(str(rng.random()) for _ in range(9))]).encode() for _ in range(rng.randint(25, 90))]
    h = [int.from_bytes(w[:8].ljust(8, b"\0")) * 6364136223846793005 % 2**64 for w in words]
    want = [0, *(i for i in range(4, len(h) - 4) if h[i] < min(h[i - 4 : i]) and h[i] <= min(h[i + 1 : i + 5])), len(h)]
    got, hashes = linededup.parts([None, b"", b"\n \t\n  " + b" \x0b".join(words) + b"\na  b", b" ".join(words), b"a b"])
    cut, n = list(zip(want, want[1:], strict=False)), len(want) - 1
    assert got == [*((2, 2, a, b) for a, b in cut), (2, 3, 0, 2), *((3, 0, a, b) for a, b in cut), (4, 0, 0, 2)]
    assert hashes[: n + 1].tolist() == hashes[n + 1 :].tolist()
    at, keys = linededup.window_keys(np.array([x.text for x in got]), hashes, 3)
    windows = max(0, n - 2)  # of the same line alone, in text 3; text 2 has a line more
    assert at.tolist() == [*range(n - 1), *range(n + 1, n + 1 + windows)] and keys.shape[1] == linededup.KEY
    assert keys[:windows].tolist() == keys[len(keys) - windows :].tolist() and len({bytes(k) for k in keys[: n - 1]}) == n - 1


# token files


def overlapping_free_counts(x):
    """Occurrences of each pair that don't overlap, counted from the left."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(x, x[1:], strict=False)):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            counts[pair], last[pair] = counts.get(pair, 0) + 1, i
    return counts


def test_repair_is_lossless_and_addressable():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000, 200_000):
        ids = (rnd.zipf(1.3, n) % 500).astype("<u4")
        starts = np.arange(0, n, 37)
        s = tokenbin.Segment(tokenbin.pack_segment(ids, starts, 500))
        assert (s.ids() == ids).all() and (s.starts == starts).all() and s.n_ids == n
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, min(n, n // 2 + 5)), (max(0, n - 3), n)):
            assert (s.slice(a, b) == ids[a:b]).all()
    same = tokenbin.Segment(tokenbin.pack_segment(np.full(5000, 7, "<u4"), np.array([0]), 500))
    assert same.n_symbols < 10 and (same.ids() == 7).all()


def test_repair_ends_when_no_pair_occurs_twice():
    rnd = np.random.default_rng(6)
    texts = [rnd.zipf(1.5, 30_000) % 90, np.tile(rnd.integers(0, 50, 700), 60), rnd.integers(0, 3, 20_000), np.repeat(rnd.integers(0, 4, 900), rnd.integers(1, 40, 900))]
    for ids in texts:
        rules, symbols = repair.compress(ids.astype("<u4"), 100)
        assert max(overlapping_free_counts(symbols.tolist()).values(), default=0) < 2
        assert len({tuple(r) for r in rules.tolist()}) == len(rules)
        sizes = repair.lengths(rules, 100)
        assert (repair.expand(symbols, rules, sizes, 100) == ids).all() and sizes.sum() >= 2 * len(rules)
    rules, symbols = repair.compress(np.tile(np.arange(64), 64).astype("<u4"), 100)  # one passage repeated collapses
    assert len(symbols) + len(rules) < 80


def test_a_slice_reads_the_blocks_that_it_needs():
    ids = (np.random.default_rng(7).zipf(1.2, 300_000) % 5000).astype("<u4")
    data, seen = tokenbin.pack_segment(ids, np.array([0]), 5000), []
    s = tokenbin.Segment(lambda at, size: seen.append(size) or data[at : at + size])
    assert (s.slice(150_000, 150_010) == ids[150_000:150_010]).all()
    block = s.width * tokenbin.BLOCK // 8
    assert s.n_symbols > 10 * tokenbin.BLOCK and max(seen) < s.n_symbols * s.width // 8 and {block, 2 * block} & set(seen)


def test_token_files_round_trip(docs, empty):
    t = Tokenizer.from_file(WORDS)
    folder = common.scratch(docs.sparkSession, "tokens")
    manifest = tokenbin.write(docs, folder, WORDS, segment_ids=50)
    got = tokenbin.read(manifest, folder)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want, everything = 0, [], []
    for i, text, _ in order:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        everything.append(ids)
        at += len(ids)
    key = lambda r: (r[1],)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()), key=key) == sorted(want, key=key)
    everything, base = np.concatenate(everything), 0
    for r in sorted(manifest.collect(), key=lambda r: (r.part, r.segment)):
        assert (tokenbin.read_range(folder, r.file, r.at, 3, 9) == everything[base + 3 : base + min(9, r.n_ids)]).all()
        base += r.n_ids
    assert tokenbin.round_trip(empty, WORDS).count() == 0


def test_word_encoder_equals_the_library():
    t, e, rnd = Tokenizer.from_file(WORDS), wordids.WordEncoder(WORDS, cached=500), random.Random(8)
    parts = [*" \n\t\r\x0b\x1c\x85\u00a0\u3000ab'sé1²٣!𝒳ΣσςİẖH̱́E<|>Kﬁ×÷ÉÿÀ", "'ll", "'re", "''s", "s's", "<|endoftext|>", "don't", "THE"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 25))) for _ in range(8000)] + [None, "", "x" * 5000, "é" * 3000, "a1" * 2000]
    for special in (True, False):
        part = [x for x in texts if special or "<|endoftext|>" not in (x or "")]
        for at in range(0, len(part), 1000):
            ids, sizes = e.encode(pa.array(part[at : at + 1000]), 1)
            got = np.split(ids, np.cumsum(sizes)[:-1])
            for text, own in zip(part[at : at + 1000], got, strict=True):
                assert own.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1]


# toxicity


def test_toxicity_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    toxic = got["toxic"] == 1
    assert got[toxic]["predicted"].mean() > 0.6 and got[~toxic]["predicted"].mean() < 0.02
    order = got["score"].rank()
    auc = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.93


def test_toxicity_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1), (2, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    assert got.count() == len(ROWS) and got.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.score_toxicity(docs, labels.filter("false")).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0


def sample_of(texts, size):
    """Dense counts and word totals of texts as arrays of word numbers, and the same as a Sample."""
    dense = np.array([np.bincount(t, minlength=size) for t in texts])
    at = [np.flatnonzero(r) for r in dense]
    sizes = np.array([len(x) for x in at])
    return dense, toxicity.Sample(np.concatenate(at), np.concatenate([r[i] for r, i in zip(dense, at, strict=True)]), np.cumsum(sizes) - sizes, np.array([len(t) for t in texts]))


def test_risk_and_its_gradient_equal_brute_force():
    rng = np.random.default_rng(0)
    for prior, shift in ((0.3, 2.0), (0.9, -3.0)):  # the second is over the bound: the term on negatives is below zero
        zp, zu = rng.normal(2, 1, 7), rng.normal(shift, 1, 9)
        plus = lambda z: np.log(1 + np.exp(-z)).mean()
        minus = lambda z: np.log(1 + np.exp(z)).mean()
        risk, negative, by_p, by_u = toxicity.risk_and_slopes(zp, zu, prior)
        assert np.isclose(negative, minus(zu) - prior * minus(zp)) and np.isclose(risk, prior * plus(zp) + max(0, negative))
        assert (negative < 0) == (shift < 0)
        held = (lambda p, u: prior * plus(p) + minus(u) - prior * minus(p)) if negative >= 0 else (lambda p, u: prior * minus(p) - minus(u))
        for i, (z, slope) in enumerate(((zp, by_p), (zu, by_u))):
            for k in range(len(z)):
                step = np.zeros(len(z))
                step[k] = 1e-5
                up, down = ((z + step, zu), (z - step, zu)) if i == 0 else ((zp, z + step), (zp, z - step))
                assert np.isclose((held(*up) - held(*down)) / 2e-5, slope[k], atol=1e-6)


def test_fit_equals_a_dense_version():
    rng = np.random.default_rng(1)
    toxic, other = [rng.integers(0, 25, 20) for _ in range(30)], [rng.integers(10, 40, 30) for _ in range(90)] + [rng.integers(0, 25, 20) for _ in range(5)]
    (dp, p), (du, u) = sample_of(toxic, 40), sample_of(other, 40)
    s = toxicity.Settings(models=1, epochs=5, batches=1)
    model = toxicity.fit(p, u, np.arange(1, 41, dtype=np.uint64), 0.1, s)
    xp, xu = (10 * np.log1p(d) / np.sqrt(d.sum(1, keepdims=True)) for d in (dp, du))
    w, b, g2, b2 = np.zeros(40), np.log(0.1 / 0.9), np.full(40, 1e-8), 1e-8
    for _ in range(5):
        sp, su = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        negative = -np.log(1 - su).mean() + 0.1 * np.log(1 - sp).mean()
        ep, eu = -0.1 * sp / len(sp), su / len(su)
        ep, eu = (-ep, -eu) if negative < 0 else (ep + 0.1 * (sp - 1) / len(sp), eu)
        g, gb = xp.T @ ep + xu.T @ eu + s.decay * w, ep.sum() + eu.sum()
        g2, b2 = g2 + g * g, b2 + gb * gb
        w, b = w - s.rate * g / np.sqrt(g2), b - s.rate * gb / np.sqrt(b2)
    assert np.allclose(model.weights, w) and np.isclose(model.bias, b)


def test_scores_and_training_rows_equal_plain_counts(spark):
    long = "vile " * 3000 + " ".join(f"w{i}" for i in range(4000))  # long texts are in the sample
    rows = [(i, "vile foul Foul, words here") for i in range(1, 30)] + [(i, "kind words and more") for i in range(30, 120)] + [(201, long), (201, long + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(1, 20), 201]] + [(i, 0) for i in range(40, 60)], "doc_id long, toxic int")
    s = toxicity.Settings(least_z=2.0)
    chosen = toxicity.chosen_texts(docs, labels, s)
    assert sorted((r.positive, r.words) for r in chosen.filter("doc_id = 201").collect()) == [(False, 7000), (True, 7000)]
    vocabulary = toxicity.telling_words(chosen, s)
    assert {toxicity.word_hash(w) for w in (b"vile", b"foul", b"kind")} <= set(vocabulary.tolist())
    whole, few = (sum(len(x.words) for x in toxicity.training_sample(chosen, vocabulary, toxicity.Settings(entries=n))) for n in (10**9, 60))
    assert whole == chosen.count() and 0 < few < whole
    model = toxicity.train(docs, labels, s)
    weight = dict(zip(model.words.tolist(), model.weights, strict=True))
    for r in toxicity.scored(docs, model).join(docs, "doc_id").collect():
        counts, words = {}, r.text.split()
        for w in words:
            h = toxicity.word_hash(w.encode())
            counts[h] = counts.get(h, 0) + 1
        z = model.bias + 10 * sum(weight.get(h, 0) * np.log1p(n) for h, n in counts.items()) / np.sqrt(len(words))
        if r.doc_id != 201:  # twice there
            assert np.isclose(r.score, 1 / (1 + np.exp(-z))) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
