"""The pipeline against a brute-force version of its stages."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from sonolith.llm import bpe, queries

from .test_operators import ROWS, SCHEMA, near_brute

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.OP8_SQL}) WHERE kept").fetchall()}
    rows = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    near = near_brute([(i, rows[i]) for i in first.values()], 5, 80)
    stays = {i for i, (_, c) in near.items() if i == c}
    con.sql("DROP VIEW documents")
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{DATA}/documents.parquet' WHERE doc_id IN ({', '.join(map(str, stays))})")
    copies = {i: t // s if s else None for i, s, t in con.sql(f"SELECT doc_id, size, taken FROM ({queries.ORACLE_SQL['op3_pareto_mix']})").fetchall()}
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "ids").collect()
    counts = {i: sum(r.doc_id == i for r in got) for i in copies}
    assert {r.doc_id for r in got} <= stays and counts == {i: c for i, c in copies.items()}
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert all(np.array(r.ids).tolist() == enc.encode_ordinary(rows[r.doc_id]) for r in got)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def _words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


#: Rows that pass the quality rules: repeated, equal but for white space, near copies, without ids or source, very long.
CLEAN = [
    (1001, _words("a", 60), "a"), (1001, _words("a", 60), "a"), (1002, _words("a", 60).replace(" ", " \n\t"), "b"), (1003, _words("a", 60) + " tail", None),
    (None, _words("c", 60), "c"), (None, _words("c", 60), "c"), (None, _words("a", 60), "c"), (1006, _words("b", 60_000), "b"),
]
CLASHING = ["'k' AS kept", "1 AS recipe", "2 AS set_key", "3 AS KEY", "4 AS times", "5 AS size", "6 AS component_id", "7 AS _set"]


def _ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS + CLEAN, SCHEMA).selectExpr("*", *CLASHING).repartition(3)


def test_stages_on_odd_rows(spark, edge):
    got = {name: stage(spark, edge, DATA) for name, stage in corpus_pipeline.STAGES}
    for name in list(got)[:-1]:
        assert got[name].columns == edge.columns, name
    assert _ids(got["quality_rules"]) == [1001, 1001, 1002, 1003, 1006, None, None, None]
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows, least = ROWS + CLEAN, {}
    for i, t, _ in rows:
        least[plain(t)] = min(least.get(plain(t), np.inf), np.inf if i is None else i)
    assert _ids(got["exact_dedup"]) == sorted((None if i == np.inf else i for i in least.values()), key=lambda x: (x is None, x))
    near = _ids(got["near_dedup"])
    assert [i for i in near if i is not None and i > 1000] == [1001, 1006]
    wordless = lambda texts: sorted(t or "" for t in texts if not (t or "").split())
    assert wordless(r.text for r in got["near_dedup"].select("text").collect()) == wordless(t for _, t, _ in rows)
    # of rows without an id: two texts of their own, and one without words
    assert near.count(None) == 3
    sizes = {}
    for _, t, source in rows:
        sizes[source] = sizes.get(source, 0) + len((t or "").split())
    taken = {}
    for r in got["mix_sources"].select("text", "source").collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    assert all(taken[s] <= 3 * sizes[s] for s in taken) and None in taken
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = [(r.doc_id, codec.decode(np.array(r.ids, "<u4").tobytes()).decode()) for r in got["encode"].select("doc_id", "ids").collect()]
    assert sorted(decoded, key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)


def test_stages_of_an_empty_table(spark, edge):
    none = edge.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_run_on_odd_rows(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    # left for the mix: 60 words of a, 60 of c and 60,000 of b; a and c are taken three times, the long text doesn't fit
    assert _ids(corpus_pipeline.run(spark, str(tmp_path))) == [1001] * 3 + [None] * 3
