"""Registered queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, exact, linededup, mixing, nearjoin, packing, pii, quality, spelling, tokenbin, toxicity, warc, whitening


def op1_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(common.table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(common.table(spark, sf_dir, "documents"))


def _op3_sql(rounds: int = 2) -> str:
    fill = ""
    for r in range(rounds):
        fill += f"""
, c{r} AS (
  SELECT key, v, sum(size) OVER (PARTITION BY key ORDER BY v) AS upto, gap
  FROM k JOIN s{r} USING (key) WHERE p > 0 AND v > low AND size <= gap
), t{r} AS (
  SELECT key, max(v) FILTER (WHERE upto <= gap) AS high, max(upto) FILTER (WHERE upto <= gap) AS used FROM c{r} GROUP BY key
), s{r + 1} AS (
  SELECT s{r}.key, gap - coalesce(used, 0) AS gap, coalesce(high, low) AS low,
         low AS low{r}, coalesce(high, low) AS high{r}, gap AS most{r}
  FROM s{r} LEFT JOIN t{r} USING (key)
)"""
    hit = " OR ".join(f"(v > low{r} AND v <= high{r} AND size <= most{r})" for r in range(rounds))
    joins = " ".join(f"JOIN (SELECT key, low{r}, high{r}, most{r} FROM s{r + 1}) USING (key)" for r in range(rounds))
    return r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), z AS (
  SELECT key, sum(size)::BIGINT AS source_size, sum(size)::BIGINT / count(*) AS mean,
         [5, 2, 1][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY key
), y AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM z
), x AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM y WINDOW b AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT key, source_size, mean, least((SELECT arg_min(level, (ratio, key)) FROM x WHERE level <= ratio) * w,
                                 3.0::DOUBLE * source_size) AS target FROM x
), h AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM g
), goals AS (
  SELECT key, source_size, mean, target, floor(times)::INT AS copies, times - floor(times) AS p FROM h
), k AS (
  SELECT d.*, source_size, target, copies, p, q / (1 + q) AS v
  FROM (SELECT d.*, goals.* EXCLUDE (key), (u / (1 - u)) / ((p / (1 - p)) * (2 * mean / (mean + size))) AS q FROM d JOIN goals USING (key)) d
), s0 AS (
  SELECT key, CASE WHEN p > 0 THEN target - copies * source_size ELSE 0 END AS gap, -1.0::DOUBLE AS low FROM goals
)""" + fill + f"""
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN p > 0 AND ({hit}) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k {joins}
"""


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT page_id, strlen(body) AS payload_bytes, from_hex(sha1(body))::BIT::VARCHAR AS bits,
         min(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
          + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_texts(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


def op6_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(common.table(spark, sf_dir, "documents"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM d
), tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT w.doc_id, body, len(ws)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS upper,
         length(body) - length(regexp_replace(body, '[a-z]', '', 'g')) AS lower,
         length(body) - length(replace(body, '!', '')) AS bangs
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR (upper > 2 * lower AND 4 * upper > word_chars)
         OR 2 * bangs > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.deduplicated(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(body, chr(10)) AS ls FROM d)
), t AS (
  SELECT doc_id, i, unnest(range(1, len(ts) + 1)) AS j, len(ts) AS n, unnest(ts) AS token
  FROM (SELECT doc_id, i, regexp_extract_all(line, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ts FROM l)
), h AS (
  SELECT *, (('0x' || rpad(substr(hex(encode(word)), 1, 16), 16, '0'))::UBIGINT::HUGEINT * 6364136223846793005) % 18446744073709551616 AS h FROM (SELECT *, regexp_replace(token, '[\x20\x09-\x0D]+', '', 'g') AS word FROM t)
), c AS (
  SELECT *, n > 24 AND j > 4 AND j <= n - 4
         AND h < min(h) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
         AND h <= min(h) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS cut
  FROM h
), s AS (
  SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY j) AS part FROM c
), nb AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS p
  FROM (SELECT doc_id, i, part, string_agg(word, ' ' ORDER BY j) AS plain, string_agg(token, '' ORDER BY j) AS written FROM s GROUP BY ALL)
), w AS (
  SELECT doc_id, p, plain || chr(10) || lead(plain) OVER o || chr(10) || lead(plain, 2) OVER o AS k
  FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth, count(*) OVER (PARTITION BY k) AS n
  FROM w WHERE k IS NOT NULL
), cover AS (
  SELECT doc_id, p + s AS p, bool_or(nth = 1) AS stays FROM r, (SELECT unnest([0, 1, 2]) AS s) WHERE n > 1 GROUP BY ALL
), gone AS (
  SELECT doc_id, p FROM cover WHERE NOT stays
), kept AS (
  SELECT doc_id, i, line FROM l ANTI JOIN nb USING (doc_id, i)
  UNION ALL
  SELECT doc_id, i, string_agg(written, '' ORDER BY part) FROM nb ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id, i
), rest AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM kept GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT i) AS n_lines FROM nb GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest.body, '')) AS text_sha256
FROM d LEFT JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op10_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.table(spark, sf_dir, "documents"))


#: crc32 by its table of 256 numbers, folded over the bytes of "doc_id:run". Near words share a copy with one letter left
#: out at the same place, or one is the other's copy.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
), r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), b AS (
  SELECT run, hex(encode(id || ':' || run)) AS x FROM r
), h AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
         lambda c, y: xor(c // 256, tab[xor(c % 256, y) + 1]))) AS h FROM b, t
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h
), v AS (
  SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), c AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word AS u, b.word AS v, b.n AS n FROM c a JOIN c b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, v.word, v.n FROM c a JOIN v ON a.short = v.word
  UNION
  SELECT v.word, a.word, a.n FROM c a JOIN v ON a.short = v.word
), g AS (
  SELECT u AS word, count(*) AS n_near, max(n) AS top, arg_min(v, (-n, v)) AS best FROM p GROUP BY u
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN best END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN g USING (word)
), o AS (
  SELECT word, word AS at, form AS onward FROM f
  UNION ALL
  SELECT o.word, f.word, f.form FROM o JOIN f ON o.onward = f.word
)
SELECT f.word, f.form, o.at AS root, f.n, f.n_near, f.form_n FROM f JOIN o ON f.word = o.word AND o.onward IS NULL
"""


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(common.table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_nonnegative_pu": op1_nonnegative_pu,
    "op2_chosen_path": op2_chosen_path,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_chunk_recipes": op6_chunk_recipes,
    "op7_pii_spans": op7_pii_spans,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_line_windows": op9_line_windows,
    "op10_repair_tokens": op10_repair_tokens,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_retrieval_packing": op12_retrieval_packing,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {
    "op3_pareto_mix": _op3_sql(),
    "op4_warc_round_trip": OP4_SQL,
    "op6_chunk_recipes": OP6_SQL,
    "op8_quality_cascade": OP8_SQL,
    "op9_line_windows": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
}
